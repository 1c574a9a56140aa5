"""Token counts by prefix dynamic programming (operator 7).

For byte-pair merging, the tokens of a string are the only sequence of vocabulary entries in which every entry is
itself stable and every two neighbours are a *valid pair*: merged alone, the two give just these two.  So the
last token of every prefix follows from the last tokens of shorter prefixes, and with it the exact count at
every prefix: count[i] = count[i - len(t)] + 1, t being the one entry that ends at i and pairs with the last token
at i - len(t).  No prefix is ever encoded twice; truncation and budget questions read the table.

Merges never cross the start of a run of blanks (no entry holds a blank after another character), a line feed, or any
two characters that no entry holds side by side, so a text is cut there and a part's table is computed once per worker.

Edge cases: a null text counts as empty (0 tokens, 0 bytes, not over the limit); whole texts of any length are
counted; repeated rows give repeated rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkcache import ChunkCache

BLANK = "▁"
_CHUNK = re.compile(" *[^ \n]+|\n| +")


class PrefixCounter:
    """Exact counts for a sentencepiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("an entry holds a blank after another character: chunks can't be cut at blanks")
        self.names = [""]  # number 0 is the start of a chunk
        self.numbers: dict[str, int] = {}
        for p in self.rank:
            self.numbers[p] = len(self.names)
            self.names.append(p)
        self.entries = len(self.names)
        self.begins = dict.fromkeys((p[:i] for p in self.rank for i in range(1, len(p))), 0) | self.numbers
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.valid: dict[int, bool] = {}
        self.parts = ChunkCache(lambda parts: [self.table(c)[-1] for c in parts], 400_000)
        self.cache = ChunkCache(lambda chunks: [sum(self.parts.get(self.cut(c))) for c in chunks], 400_000)

    def merged(self, text: str) -> list[str]:
        """Plain merging, best entry first and leftmost on ties; used on pairs of entries only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pairs(self, left: int, right: int) -> bool:
        """Whether the two entries, merged alone, stay as they are."""
        a, b = self.names[left], self.names[right]
        ok = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.valid) > 1_500_000:
            self.valid.clear()
        self.valid[left << 32 | right] = ok
        return ok

    def cut(self, chunk: str) -> list[str]:
        """The chunk in parts between characters that no entry holds side by side: no merge joins them."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inside:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def number(self, character: str) -> int:
        """The number of a lone character that is no entry: it stands for its UTF-8 bytes."""
        n = self.numbers.get(character)
        if n is None:
            n = self.numbers[character] = len(self.names)
            self.names.append(character)
        return n

    def table(self, chunk: str) -> list[int]:
        """Ids of every prefix of a chunk (blanks written as U+2581); entry 0 is the empty prefix."""
        n, begins, valid = len(chunk), self.begins.get, self.valid.get
        last, count = [0] * (n + 1), [-1] * (n + 1)
        count[0] = 0
        for j in range(n):
            before, base = last[j], count[j]
            for i in range(j + 1, n + 1):
                t = begins(chunk[j:i])
                if not t and i == j + 1:
                    lone = self.number(chunk[j:i])
                    if count[i] < 0 and self.pairs(before, lone):
                        last[i], count[i] = lone, base + len(chunk[j:i].encode("utf-8", "surrogatepass"))
                elif t and count[i] < 0:
                    ok = valid(before << 32 | t)
                    if ok if ok is not None else self.pairs(before, t):
                        last[i], count[i] = t, base + 1
                if t is None:
                    break
        return count

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The model's chunks: a blank is put before the text, blanks are written U+2581 and open a chunk."""
        return _CHUNK.findall(" " + text.replace(BLANK, " ")) if text else []

    def count(self, text: str | None) -> int:
        return sum(self.cache.get([c.replace(" ", BLANK) for c in self.chunks(text)])) if text else 0

    def prefix_counts(self, text: str | None) -> list[int]:
        """Ids of the model for text[:i], for every i from 0 to len(text)."""
        if not text:
            return [0]
        out, base = [], 0
        for c in self.chunks(text):
            t = self.table(c.replace(" ", BLANK))
            out += [base + x for x in t[1:]]
            base += t[-1]
        return [0, *out[1:]]

    def truncate(self, text: str | None, budget: int) -> int:
        """Length in characters of the longest prefix such that it and all shorter ones take at most `budget` ids."""
        counts, most = self.prefix_counts(text), 0
        running = [most := max(most, c) for c in counts]
        return bisect_right(running, budget) - 1


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def count_tokens(df: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of df and `out`, the exact number of ids of every whole text."""
    schema = df.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            counts = pa.array([c.count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def truncation_points(df: DataFrame, model_file: str, budget: int, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, n_tokens and cut: how many characters of the text fit `budget` ids (see PrefixCounter.truncate)."""
    schema = df.select(*keep).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("cut", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.count(t) for t in texts], pa.int64()), pa.array([c.truncate(t, budget) for t in texts], pa.int64())], names=[*keep, "n_tokens", "cut"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir: str, model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole document."""
    import public_tokenizers

    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = count_tokens(docs, model_file or public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "n_bytes"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
