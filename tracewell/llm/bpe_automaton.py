"""BPE encoding and decoding through a tokenization automaton (operator 10).

The automaton reads *tokens*: it starts as one state with a loop for every base symbol and accepts every spelling of
a word.  The merges are then compiled in, in order, one gadget each.  The gadget of u + v -> w

* splits the state that u leads to from the other labels that lead there,
* cuts the arc v from u's own state (u v is no longer a spelling), and
* adds an arc w, to the state that v leads to, wherever an arc u leaves.

After the last merge exactly one spelling of every word is left: the one the merge procedure gives.  A state is kept
as what its gadget did to the state it was split from, and an arc of the transition table is worked out from that
chain when it is first asked for, then held; a full table of states times labels would take hundreds of megabytes.

A pre-split word is encoded by table-driven transitions: from the state reached, the longest arc that the table allows
is taken, and given up for the next shorter one where no arc leads on.  Whatever has been read along the way is itself
spelled in the only way there is, so no place is reached twice and the steps are linear in the word's length.  Decoding walks the arcs and emits their labels.

Edge cases: a null text is encoded as an empty one (no ids, decoded ''); texts of any length are encoded whole;
repeated rows give repeated rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkcache import ChunkCache
from .common import WHITE


class TokenAutomaton:
    """labels: token strings by id; base: ids of the base symbols; merges: (left id, right id, made id) in order."""

    def __init__(self, labels: list[str], base: list[int], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels, self.start = labels, 0
        self.target = [-1] * n
        self.born, self.left = [-1] * n, [-1] * n  # of a label: the merge that made it, and its left part
        self.parent, self.since = [-1], [-1]  # of a state: what it was split from, and when
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}  # by state << 20 | label
        for b in base:
            self.target[b] = 0
        shared = [len(base) + 1]  # labels that lead to a state; the start counts for one
        for time, (u, v, w) in enumerate(merges):
            old = self.target[u]
            if old < 0 or self.target[v] < 0 or not self.arc(old, v, time):
                continue  # u v spells nothing any more: the merge never applies
            if self.target[w] >= 0:
                raise ValueError(f"two merges make {labels[w]!r}")
            own = old
            if u == v or shared[old] > 1:
                own = len(self.parent)
                self.parent.append(old)
                self.since.append(time)
                shared[old] -= 1
                shared.append(1)
                self.target[u] = own
            self.target[w] = old if u == v else self.target[v]
            shared[self.target[w]] += 1
            self.cut[own, v] = time
            self.born[w], self.left[w] = time, u
        self.ever = len(merges)

    def arc(self, state: int, label: int, time: int) -> bool:
        """Whether an arc `label` leaves `state` after the merges up to `time`."""
        while True:
            if self.cut.get((state, label), time + 1) <= time:
                return False
            if self.since[state] > self.born[label]:  # split off later: as in the state it was split from
                time, state = self.since[state], self.parent[state]
            elif self.born[label] >= 0:  # made later: wherever its left part left then
                time, label = self.born[label], self.left[label]
            else:
                return True

    def leaves(self, state: int, label: int) -> bool:
        key = state << 20 | label
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 1_500_000:
                self.table.clear()
            found = self.table[key] = self.target[label] >= 0 and self.arc(state, label, self.ever)  # some labels are never made
        return found

    def spell(self, word: str, inner: dict[str, int], final: dict[str, int], longest: int) -> list[int]:
        """The arcs of a word.  inner: labels inside a word, and -1 for what only begins one, by their characters;
        final: labels that may only end a word, at most `longest` characters."""
        n, table, target, leaves, step = len(word), self.table, self.target, self.leaves, inner.get
        path: list[int] = []  # the arcs so far; every way from the start is the spelling of what it reads
        open_: list[list[tuple[int, int]]] = []  # for each of them, the shorter arcs not yet tried at its place
        state = at = 0
        while at < n:
            arcs = []
            for i in range(at + 1, n):
                t = step(word[at:i])
                if t is None:
                    break
                if t >= 0:
                    arcs.append((t, i))
            if n - at <= longest and (t := final.get(word[at:])) is not None:
                arcs.append((t, n))
            while True:
                while not arcs:  # no way on from here: the last arc was no part of the spelling
                    arcs = open_.pop()
                    path.pop()
                    state = target[path[-1]] if path else 0
                t, i = arcs.pop()
                ok = table.get(state << 20 | t)
                if ok if ok is not None else leaves(state, t):
                    break
            path.append(t)
            open_.append(arcs)
            state, at = target[t], i
        return path


class WordBpe:
    """Encoder and decoder of a tokenizers file: BPE with a word-end suffix, byte-level symbols, split by a pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in [*vocab.items(), *added.items()]:
            labels[i] = t
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {m[2] for m in merges}
        self.automaton = TokenAutomaton(labels, [i for i in vocab.values() if i not in made], merges)
        self.labels, self.special = labels, added
        self.inner = dict.fromkeys((t[:i] for t in vocab for i in range(1, len(t))), -1) | vocab
        self.final = {t[: -len(self.suffix)]: i for t, i in vocab.items() if t.endswith(self.suffix)} if self.suffix else vocab
        self.longest = max(map(len, self.final))
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter; the merging is the automaton's
        self.splits = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.words: dict[str, tuple[int, str, str]] = {}  # count, ids and labels of a word
        # Chunks of plain Latin-1 letters and a tail of plain punctuation need no library: lower case, two words.
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)").fullmatch
        self.symbols = {i: self.library.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
        self.chunks = re.compile(f"[^{WHITE}]+").findall
        self.cache = ChunkCache(lambda chunks: [self.written(c) for c in chunks], 250_000)

    def word_ids(self, word: str) -> list[int]:
        return self.automaton.spell(word, self.inner, self.final, self.longest)

    def parts(self, chunk: str) -> Iterator[int | str]:
        """The special ids and the pre-split words of a chunk."""
        for part in self.splits.split(chunk) if self.splits and "<|" in chunk else [chunk]:
            if part in self.special:
                yield self.special[part]
            elif part and (m := self.plain(part)):
                letters, tail = m.groups()
                if letters:
                    yield letters.lower().translate(self.symbols)
                if tail:
                    yield tail
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield word

    def chunk_ids(self, chunk: str) -> list[int]:
        return [i for p in self.parts(chunk) for i in ([p] if isinstance(p, int) else self.word_ids(p))]

    def written(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal and the labels of a chunk."""
        got, words = [], self.words
        for p in self.parts(chunk):
            v = words.get(p)
            if v is None:
                ids = [p] if isinstance(p, int) else self.word_ids(p)
                v = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                if len(words) > 400_000:
                    words.clear()
                words[p] = v
            got.append(v)
        if len(got) == 1:
            return got[0]
        return sum([v[0] for v in got]), " ".join([v[1] for v in got]), " ".join([v[2] for v in got])

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text or "") for i in self.chunk_ids(c)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, a space between two (the file names no decoder)."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])

    def both(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids written in decimal, and the decoded text.  Chunks between white space are
        independent: the splitter drops white space and no match spans it."""
        got = [v for v in self.cache.get(self.chunks(text or "")) if v[0]]
        return sum([v[0] for v in got]), " ".join([v[1] for v in got]), " ".join([v[2] for v in got])


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, n_tokens, ids (decimal, joined by one space) and decoded, of every whole text."""
    schema = df.select(*keep).select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n, ids, decoded = zip(*map(c.both, b.column(b.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*keep, "n_tokens", "ids", "decoded"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and decoded, from ids written in decimal; a null list decodes to ''."""
    schema = df.select(*keep).withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            decoded = [c.decode([int(i) for i in (x or "").split()]) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(decoded, pa.string())], names=[*keep, "decoded"])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def op10_bpe_codec(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every whole document."""
    import public_tokenizers

    from .common import read

    out = encode_decode(read(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id",))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
