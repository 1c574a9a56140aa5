"""Repeated passages by a sparse suffix array (operator 6).

Only suffixes at content-selected positions are kept: of every window of WINDOW consecutive K-word runs, the position
of the run with the smallest hash (its minimiser).  With K + WINDOW - 1 = `min_words`, every passage of `min_words`
words holds at least one, at the same place wherever the passage stands, with K words of the passage from it on and at
most WINDOW - 1 before it.  Suffixes whose first K words occur once repeat nothing and are dropped.

The others carry the words of a passage: the next `min_words` from the position on, and the WINDOW - 1 before it, nearest
first.  They are dealt by the hash of their first K words and sorted by the words that follow (each partition is a part of
the sorted suffix array), neighbours are compared, and the matches are extended to the left:  all suffixes that share at
least r following words are neighbours in a run; sorted by the words before them, a suffix shares most of these with a
neighbour in that order.  So for each number r of following words that some neighbours share, the longest extension to
the left among all partners is found from neighbours alone, and a passage is reported if and only if its words, compared
as text, stand elsewhere too.  A repeated span is the union of such passages of `min_words` words.

Suffixes with the same words around them fold into one row with their number before they are sorted, so a passage that
very many texts share is one row, but for the positions near its ends, where the texts differ.  A group of more than GROUP
different rows there would be one task; its passages are told apart by 128-bit hashes of their words instead, counted by
(partial) aggregation.

Suffixes of a text are found once for all of its copies, which fold into one node (a 128-bit content id) with the number
of rows; a text with copies repeats wholly if it has `min_words` words.

Edge cases: null, empty and short texts have no span; texts of any length are used whole; repeated rows are copies of
each other; rows without an id take part; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MIN_WORDS, K = 50, 20
GROUP = 1024
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PLACE = _U((1 << 28) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _folded(text: str) -> str:
    """Lower case, character by character where the length would change, so that places stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """For each code point, whether words hold it."""
    out = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


class Words:
    """The words of texts: begin and end (code points in their text), hash (64 bits), and the first word of each text (and
    the end)."""

    def __init__(self, texts: list[str | None]):
        folded = [_folded(t or "") for t in texts]
        size = np.array([len(t) + 1 for t in folded], np.int64)
        offset = np.cumsum(size) - size
        codes = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = _is_word()[codes]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        self.first = np.append(np.searchsorted(begin, offset), len(begin))
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        length = end - begin
        at = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(at, length)
        power = np.full(int(length.max(initial=0)), _BASE, _U)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        letters = _mix(codes[inside].astype(_U) + _U(_BASE)) * power[place]
        self.hash = _mix(np.add.reduceat(letters, at) + length.astype(_U)) if len(at) else np.empty(0, _U)
        self.begin, self.end = begin - offset[text], end - offset[text]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: a run is two runs of half the length."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    done, out, power, size = 0, np.zeros(len(h) - n + 1, np.uint64), h, 1
    left = n
    while left:
        if left & 1:
            out = _mix(out * _U(_BASE) + power[done : done + len(out)] + _U(size))
            done += size
        left >>= 1
        if left:
            power = _mix(power[:-size] * _U(_BASE) + power[size:] + _U(3))
            size *= 2
    return out


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """For every window, the position of its smallest run, the first on ties (the same in equal windows): the leading bits
    of the hash with the place behind them, least of two parts of blocks as long as the window."""
    n = len(grams) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    if len(grams) > int(_PLACE):
        raise ValueError("too many words at once")
    value = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
    blocks = np.append(value, np.full(-len(value) % window, ~_U(0))).reshape(-1, window)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[window - 1 : window - 1 + n]) & _PLACE).astype(np.int64)


def suffix_positions(texts: list[str | None], min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept suffixes of texts: how many each text has, their positions in words and the hashes of their first words."""
    w = Words(texts)
    grams = runs(w.hash, k)
    least = minimisers(grams, min_words - k + 1)
    # windows that begin in a text and end in another are none
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))[: len(least)]
    least, text = (x[np.arange(len(least)) + min_words <= w.first[text + 1]] for x in (least, text))
    new = np.flatnonzero(np.diff(least, prepend=-1))
    at, text = least[new], text[new]
    return np.bincount(text, minlength=len(texts)), at - w.first[text], grams[at]


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about a million characters each, and their texts."""
    texts = b.column(column).to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size > 1_000_000 or i == len(texts) - 1:
            yield b.slice(first, i + 1 - first), texts[first : i + 1]
            first, size = i + 1, 0


def _list(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _suffixes(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in _batches(whole, 1):
                n, pos, key = suffix_positions(texts, min_words, k)
                yield pa.RecordBatch.from_arrays([b.column(0), _list(n, key.astype(np.int64), pa.int64()), _list(n, pos.astype(np.int32), pa.int32())], names=["node", "keys", "pos"])

    return run


def _contexts(min_words: int, k: int):
    """A row for each kept suffix whose first words occur again: node, pos (in words), key, right, left, ctx (their hash).

    Every word of right and left is closed by a blank, so that equal beginnings end between words.
    """
    before = min_words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                right, left, ctx = [], [], []
                at = b.column(2)
                for text, places in zip(b.column(1).to_pylist(), at.to_pylist()):
                    found = _WORD.findall(_folded(text))
                    n, forth, back = len(found), " ".join([*found, ""]), " ".join([*found[::-1], ""])
                    to = [0, *accumulate(len(w) + 1 for w in found)]
                    fro = [0, *accumulate(len(w) + 1 for w in found[::-1])]
                    for p in places:
                        r, f = forth[to[p] : to[min(p + min_words, n)]], back[fro[n - p] : fro[min(n - p + before, n)]]
                        right.append(r)
                        left.append(f)
                        ctx.append(xxhash.xxh3_128_digest(f"{r}\0{f}".encode("utf-8", "replace")))
                source = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source)), at.flatten(), b.column(3).flatten(), pa.array(right, pa.string()), pa.array(left, pa.string()), pa.array(ctx, pa.binary())], names=["node", "pos", "key", "right", "left", "ctx"])

    return run


def shared_words(a: str, b: str) -> int:
    """How many words two lists of words, each closed by a blank, have in common from the start."""
    if a == b:
        return a.count(" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a.count(" ", 0, lo)


def left_extensions(group: list[tuple[str, str, int]], min_words: int, k: int) -> list[list[tuple[int, int]]]:
    """For each suffix (right, left, number of rows) of a group sorted by right, ranges (least, most) of d such that the
    passage from d words before it on stands elsewhere too."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    before = min_words - k
    for i, (right, left, n) in enumerate(group):
        if n > 1:
            least, most = max(min_words - right.count(" "), 0), min(left.count(" "), before)
            if least <= most:
                out[i].append((least, most))
    follow = [shared_words(a[0], b[0]) for a, b in zip(group, group[1:])]
    levels = sorted({r for r in follow if r >= k}, reverse=True)
    for level, lower in zip(levels, [*levels[1:], k - 1]):
        least, most = min_words - level, min_words - lower - 1
        i = 0
        while i < len(follow):
            if follow[i] < level:
                i += 1
                continue
            j = i
            while j < len(follow) and follow[j] >= level:
                j += 1
            run = sorted(range(i, j + 1), key=lambda x: group[x][1])
            near = [shared_words(group[x][1], group[y][1]) for x, y in zip(run, run[1:])]
            for at, x in enumerate(run):
                d = min(max(near[at - 1] if at else 0, near[at] if at < len(near) else 0), most)
                if d >= least:
                    out[x].append((least, d))
            i = j
    return out


def _neighbours(min_words: int, k: int):
    """Over suffixes sorted by (key, right, left): ctx and the passages found from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = pa.list_(pa.struct([("least", pa.int32()), ("most", pa.int32())]))

        def done(ends: list[int]) -> pa.RecordBatch:
            ctx, found = [], []
            for i, j in zip(ends, ends[1:]):
                for row, ranges in zip(held[i:j], left_extensions([x[1:4] for x in held[i:j]], min_words, k)):
                    if ranges:
                        ctx.append(row[4])
                        found.append([{"least": a, "most": b} for a, b in ranges])
            return pa.RecordBatch.from_arrays([pa.array(ctx, pa.binary()), pa.array(found, kind)], names=["ctx", "ranges"])

        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(5)))
            cut = [0, *(i for i in range(1, len(held)) if held[i][0] != held[i - 1][0])]
            yield done(cut)
            held = held[cut[-1] :]
        if held:
            yield done([0, len(held)])

    return run


def _windows(min_words: int, k: int):
    """All passages of `min_words` words around the suffixes of large groups: ctx, n, d, hash of the words and d.

    A passage of a text is hashed from each suffix in it; d tells these apart, so that it does not meet itself."""
    before = min_words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx, n, ds, hashes = [], [], [], []
            for right, left, c, count in zip(*(b.column(i).to_pylist() for i in range(4))):
                r, before_ = right.split(), left.split()
                for d in range(max(min_words - len(r), 0), min(len(before_), before) + 1):
                    ctx.append(c)
                    n.append(count)
                    ds.append(d)
                    hashes.append(xxhash.xxh3_128_digest(" ".join([str(d), *before_[:d][::-1], *r[: min_words - d]]).encode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.binary()), pa.array(n, pa.int64()), pa.array(ds, pa.int32()), pa.array(hashes, pa.binary())], names=["ctx", "n", "d", "hash"])

    return run


def spans_of(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the passages [s, s + length) of all s of the ranges (first, last); ones that touch are one span."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(begin) else np.empty(0, np.int64)
    return begin[new], end[np.append(new[1:], len(end)) - 1] if len(begin) else end


def _spans(min_words: int):
    """starts: ranges of passages, first << 32 | last; whole: the text has copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())]
        for all_ in batches:
            for b, texts in _batches(all_, 1):
                w = Words(texts)
                starts, whole = b.column(2), b.column(3).to_pylist()
                at, packed = starts.offsets.to_numpy(), starts.flatten().to_numpy()
                at = at - at[0]
                cols: list[list[np.ndarray]] = [[], [], []]
                n = np.zeros(len(texts), np.int64)
                for i in range(len(texts)):
                    lo, size = w.first[i], w.first[i + 1] - w.first[i]
                    some = packed[at[i] : at[i + 1]]
                    first, last = (some >> 32, some & 0xFFFFFFFF) if not whole[i] else (np.zeros(int(size >= min_words), np.int64), np.full(int(size >= min_words), size - min_words))
                    s, e = spans_of(first, last, min_words)
                    n[i] = len(s)
                    for col, x in zip(cols, (w.begin[lo + s], w.end[lo + e - 1], e - s)):
                        col.append(x)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], fields=[pa.field(*f) for f in kind])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)], names=["node", "spans"])

    return run


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words: every maximal span of passages of at least `min_words`
    words (lower-cased runs of letters and digits) that occur elsewhere; no row for a text without one."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null").withColumn("node", F.unhex(F.md5("text")))
    copies = docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    keys = materialise(docs.select("node", "text").mapInArrow(_suffixes(min_words, k), "node binary, keys array<long>, pos array<int>"), "suffixes")
    flat = keys.select("node", F.explode(F.arrays_zip("keys", "pos")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.pos").alias("pos"))
    # first words that occur again: in another text, or twice in one (copies of a text count once)
    shared = flat.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    inside = keys.where(F.size("keys") > F.size(F.array_distinct("keys"))).select(F.explode("keys").alias("key")).distinct()
    shared = materialise(shared.union(inside).distinct(), "shared")
    wanted = flat.distinct().join(shared, "key", "left_semi").groupBy("node").agg(F.collect_list(F.struct("pos", "key")).alias("at"))
    wanted = materialise(wanted.join(copies, "node"), "wanted")

    def one_text_each(nodes: DataFrame) -> DataFrame:
        """A text for each node, from the row of the smallest id of its copies."""
        n = nodes.withColumnRenamed("node", "n")
        return docs.join(n, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("first"))).drop("n", "doc_id", "first").dropDuplicates(["node"])

    kept = one_text_each(wanted.select("node", "first", "at")).select("node", "text", "at.pos", "at.key")
    kept = materialise(kept.mapInArrow(_contexts(min_words, k), "node binary, pos int, key long, right string, left string, ctx binary"), "contexts")
    rows = materialise(kept.groupBy("key", "right", "left", "ctx").agg(F.count(F.lit(1)).alias("n")), "rows")
    large = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group).select("key"), "large")
    ordered = rows.join(large, "key", "left_anti").select("key", "right", "left", "n", "ctx").repartition("key").sortWithinPartitions("key", "right", "left")
    found = ordered.mapInArrow(_neighbours(min_words, k), "ctx binary, ranges array<struct<least:int,most:int>>")
    hashed = materialise(rows.join(large, "key", "left_semi").select("right", "left", "ctx", "n").mapInArrow(_windows(min_words, k), "ctx binary, n long, d int, hash binary"), "windows")
    again = hashed.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    more = hashed.join(again, "hash", "left_semi").groupBy("ctx").agg(F.transform(F.collect_set("d"), lambda d: F.struct(d.alias("least"), d.alias("most"))).alias("ranges"))
    found = materialise(found.union(more), "found")
    packed = F.transform("ranges", lambda r: F.shiftleft((F.col("pos") - r["most"]).cast("long"), 32) + (F.col("pos") - r["least"]))
    starts = kept.select("node", "pos", "ctx").join(found, "ctx").select("node", packed.alias("s"))
    hit = starts.groupBy("node").agg(F.flatten(F.collect_list("s")).alias("starts"))
    marked = hit.join(copies.where("copies > 1").select("node", F.lit(True).alias("whole")), "node", "full").join(copies.select("node", "first"), "node")
    spans = one_text_each(materialise(marked, "marked")).select("node", "text", F.coalesce("starts", F.array().cast("array<long>")).alias("starts"), F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(_spans(min_words), "node binary, spans array<struct<start:long,end:long,n_words:long>>")
    spans = materialise(spans.where(F.size("spans") > 0), "spans")
    return docs.select("doc_id", "node").join(spans, "node").select("doc_id", F.inline("spans"))


def op6_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Every repeated span of every whole document."""
    from .common import read

    return repeated_passages(read(spark, sf_dir, "documents"))
