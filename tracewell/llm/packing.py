"""Packing documents into fixed-length sequences, shortest pack first over the length histogram (operator 2).

Every document is encoded and closed with an end id.  It is cut into full pieces of `capacity` ids, which fill a
sequence each, and one rest.  The rests are packed by their histogram alone: lengths are placed longest first, each
into the open pack with the most room left (the shortest pack) that fits, and packs with the same content are held as
one pattern with a count.  A pattern's slots are then joined back to the rests by rank: the r-th rest of a length
takes the r-th slot of that length.

Ranks are counted in (length, bucket, part) groups, with buckets and parts by hashes of the document's id and content,
and shifted by the counts of earlier parts and buckets; so a length that a third of all rows share is ranked by many tasks,
the number of parts growing with the input.  The driver sees capacity x BUCKETS counts whatever the input.

Edge cases: a null or empty text is one end id; texts of any length are encoded whole; repeated rows are packed each;
rows without an id are packed like others; an empty table gives no piece; other columns are not
looked at.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialise

BUCKETS = 128
PART = 1 << 20  # rows a (bucket, part) holds on average


# Fixed value: the splitter of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteEncoder:
    """ids of a byte-level BPE tokenizers file, as little-endian bytes.

    Where the file is plain byte-level BPE whose ids follow its merges, tiktoken encodes with the file's own vocabulary,
    which gives the same ids several times faster; texts with very long runs, and other files, go to the library.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.fast = self._fast(json.load(open(path, encoding="utf-8")))
        self.long = re.compile(f"[^{WHITE}]{{2000}}").search

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, split = spec["model"], spec["pre_tokenizer"] or {}
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        odd = model["unk_token"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"]
        if odd or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or any(a >= b for a, b in zip(ids, ids[1:])):
            return None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return None
        symbol = _bytes_of()
        ranks = {bytes(symbol[c] for c in t): i for t, i in model["vocab"].items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.long(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(self.dtype).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> ByteEncoder:
    return ByteEncoder(path, dtype)


def encode(df: DataFrame, path: str, keep: tuple[str, ...], text: str = "text", end_id: int = 0) -> DataFrame:
    """keep, ids (unsigned 16-bit little-endian if the vocabulary allows, else 32) closed with end_id, and n_ids."""
    dtype = "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"
    wide = int(dtype[-1])
    schema = df.select(*keep).select("*", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        e, end = encoder(path, dtype), np.array([end_id], dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [e.encode(t) + end for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(i) // wide for i in ids], pa.int64())], names=[*keep, "ids", "n_ids"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold every length of the histogram as often as it counts it."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by the room left
    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        for free in range(capacity, length - 1, -1):
            while left and free < capacity and room[free]:
                count, pattern = room[free].pop()
                if count > left:
                    room[free].append((count - left, pattern))
                took = min(count, left)
                made.append((free - length, took, pattern + [length]))
                left -= took
        if left:  # as many of this length as fit open a pack together
            per = capacity // length
            if left // per:
                made.append((capacity - per * length, left // per, [length] * per))
            if left % per:
                made.append((capacity - left % per * length, 1, [length] * (left % per)))
        for free, count, pattern in made:
            room[free].append((count, pattern))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for count, pattern in packs:
            merged[tuple(pattern)] += count
    return [(count, list(pattern)) for pattern, count in sorted(merged.items())]


class Slots:
    """For each length, its slots in order of rank: runs of (first rank, first sequence, offset)."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        self.runs: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
        ranks: dict[int, int] = defaultdict(int)
        self.sequences = 0
        for count, lengths in patterns:
            offset = 0
            for n in lengths:
                for held, value in zip(self.runs[n], (ranks[n], self.sequences, offset)):
                    held.append(value)
                ranks[n] += count
                offset += n
            self.sequences += count
        self.runs = dict(self.runs)

    def of(self, length: int, rank: int) -> tuple[int, int]:
        first, sequence, offset = self.runs[length]
        k = bisect_right(first, rank) - 1
        return sequence[k] + rank - first[k], offset[k]


def pack(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = 1024, end_id: int = 0, bucket_by: str = "doc_id") -> DataFrame:
    """One row per piece: keep, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    parts = -(-df.count() // (BUCKETS * PART)) or 1
    where = {"bucket": F.pmod(F.xxhash64(bucket_by, "ids"), F.lit(BUCKETS)).cast("int"), "part": F.pmod(F.xxhash64(F.lit(1), bucket_by, "ids"), F.lit(parts)).cast("int")}
    tokens = encode(df, path, keep, text, end_id).withColumn("rest", (F.col("n_ids") % capacity).cast("int")).withColumns(where)
    group = Window.partitionBy("rest", "bucket", "part")
    order = group.orderBy(*keep, "n_ids").rowsBetween(Window.unboundedPreceding, -1)
    full = F.floor(F.col("n_ids") / capacity)
    ranked = tokens.withColumn("rank", F.count(F.lit(1)).over(order)).withColumn("full_before", F.coalesce(F.sum(full).over(order), F.lit(0)))
    ranked = materialise(ranked, "pack")
    sizes = ranked.groupBy("rest", "bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("f"))
    if parts > 1:  # ranks go on from part to part
        sizes = materialise(sizes, "sizes")
        earlier = Window.partitionBy("rest", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        shift = sizes.select("rest", "bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("f0"))
        ranked = ranked.join(shift, ["rest", "bucket", "part"]).withColumn("rank", F.col("rank") + F.col("n0")).withColumn("full_before", F.col("full_before") + F.col("f0"))
    counts = np.zeros((capacity, BUCKETS), np.int64)
    fulls = np.zeros((capacity, BUCKETS), np.int64)
    for r in sizes.groupBy("rest", "bucket").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect():  # capacity x BUCKETS rows at most
        counts[r.rest, r.bucket], fulls[r.rest, r.bucket] = r.n, r.f
    histogram = {n: int(c) for n, c in enumerate(counts.sum(1)) if n and c}
    slots = Slots(shortest_pack_first(histogram, capacity))
    base = np.cumsum(counts, 1) - counts  # of a (length, bucket): rests of the length in earlier buckets
    full_base = (np.cumsum(fulls.ravel()) - fulls.ravel()).reshape(fulls.shape) + slots.sequences
    schema = df.select(*keep).select("*", *(F.lit(0).cast("long").alias(c) for c in ("start", "length")), F.lit(b"").alias("ids"), *(F.lit(0).cast("long").alias(c) for c in ("doc_tokens", "sequence_id", "offset"))).schema
    narrow = "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"
    nk = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows, source = [], []
                for k, (ids, rest, bucket, rank, before) in enumerate(zip(*(b.column(nk + i).to_pylist() for i in range(5)))):
                    wide = np.frombuffer(ids, narrow).astype("<u4")
                    n, sequence = len(wide), int(full_base[rest, bucket]) + before
                    for start in range(0, n - rest, capacity):
                        rows.append((start, capacity, wide[start : start + capacity].tobytes(), n, sequence + start // capacity, 0))
                        source.append(k)
                    if rest:
                        where, offset = slots.of(rest, int(base[rest, bucket]) + rank)
                        rows.append((n - rest, rest, wide[n - rest :].tobytes(), n, where, offset))
                        source.append(k)
                take = pa.array(source, pa.int64())
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:nk]), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())))], names=schema.names)

    return ranked.select(*keep, "ids", "rest", "bucket", "rank", "full_before").mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str, path: str | None = None, capacity: int = 1024) -> DataFrame:
    """One row per piece of every whole document, with a digest of its ids."""
    import public_tokenizers

    from .common import read

    pieces = pack(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"), capacity=capacity)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
