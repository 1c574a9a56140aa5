"""Bounded per-worker memo of what a tokenizer makes of a white-space delimited chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence


class ChunkCache:
    """get(chunks) -> values, computing those not held by compute(list of distinct chunks) -> list of values.

    At most `limit` chunks are held; the memo is emptied when it is full, so memory does not grow with the corpus.
    Chunks longer than `longest` are computed but not held.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence], limit: int = 300_000, longest: int = 200):
        self.compute, self.limit, self.longest, self.held = compute, limit, longest, {}

    def get(self, chunks: list[str]) -> list:
        held = self.held
        try:
            return [held[c] for c in chunks]
        except KeyError:
            pass
        missing = [c for c in dict.fromkeys(chunks) if c not in held]
        made = dict(zip(missing, self.compute(missing)))
        if len(held) + len(made) > self.limit:
            out = [held[c] if c in held else made[c] for c in chunks]
            held.clear()
            return out
        for c, v in made.items():
            if len(c) <= self.longest:
                held[c] = v
        return [made[c] if c in made else held[c] for c in chunks]
