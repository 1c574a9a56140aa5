"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap (operator 3).

A document is the multiset of its runs of five words (lower-cased runs of letters and digits; a document of one to four
words is one run).  Two are near-duplicates when the Jaccard similarity of the multisets is at least 0.8.

Signature.  The weight (count) axis of every shingle is cut at the powers of two, and each block (2^(k-1), 2^k] of it
carries a Poisson process whose rate is the block's length, seeded by shingle and block; each of its points
carries a register and a level within the block.  A document takes the points whose level its count reaches, and a
register keeps the time of the first.  Two registers agree with probability equal to the weighted Jaccard similarity.
Only the earliest points matter: processes are followed up to a time by which all registers are expected to be filled,
which is raised (doubled) for a document where one is not, so the work is about (shingles + registers x log registers).

Candidates.  Registers form bands; documents that agree in a band share a bucket.  Every member of a bucket is compared
with CENTRES members of it, picked as if at random and others in each band (stars: at most CENTRES pairs a member), by
the exact overlap of the multisets.  Then buckets that hold several components so far are searched for the links a star
cannot see: their members are dealt into blocks of bounded size, and in each pair of blocks the exact overlaps of
members of different components are computed; a task returns one link for each two components that meet in it.  So
every pair that shares a band is verified unless its documents are linked already, and what is emitted stays linear.

Copies of a text fold into one node (a 64-bit content id) before anything is compared.

Edge cases: null texts, empty texts and texts without a letter or digit link with nothing, each its own class; texts
of any length are used whole; repeated rows fall into one class; rows without an id take part, and a class is named
after its smallest id; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkcache import ChunkCache
from .common import components, materialise, text_id

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
BLOCK = 512
CENTRES = 3
_WORD = re.compile(r"[^\W_]+").findall
_U = np.uint64


@lru_cache(maxsize=1)
def _word_hashes() -> ChunkCache:
    return ChunkCache(lambda words: [xxhash.xxh64_digest(w.encode("utf-8", "replace")) for w in words], 300_000)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles_of(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of `words` words of all texts, repeats included, and where each text's begin (and end)."""
    hashes = [b"".join(_word_hashes().get(_WORD((t or "").lower()))) for t in texts]
    size = np.array([len(h) // 8 for h in hashes], np.int64)
    n = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    # a short text is padded to one run by zeros, which mix in nothing
    h = np.frombuffer(b"".join(x + b"\0" * (8 * max(words - len(x) // 8, 0)) if x else x for x in hashes), ">u8").astype(np.uint64)
    padded = np.where(size > 0, np.maximum(size, words), 0)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    runs = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        part = h[k : k + len(runs)]
        runs = np.where(part == 0, runs, mix(runs + part + _U(0x9E3779B97F4A7C15)))
    begin = np.cumsum(padded) - padded
    ends = np.cumsum(n)
    at = np.repeat(begin - (ends - n), n) + np.arange(ends[-1])
    return runs[at], np.concatenate([[0], ends])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return shingles_of([text], words)[0]


def numbered(shingle: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: each repeat is mixed with its number.  |set intersection| = sum of minima."""
    found, counts = np.unique(shingle, return_counts=True)
    if counts.size and counts.max() > 1:
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        found = np.repeat(found, counts)
        again = number > 0
        found[again] = mix(found[again] + number[again].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        found = np.unique(found)
    return found


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(shingle: np.ndarray, ends: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """First times per register, a row of float64 for each document (infinite for one without shingles).

    shingle[ends[d]:ends[d + 1]] are document d's.
    """
    docs = len(ends) - 1
    doc = np.repeat(np.arange(docs), np.diff(ends))
    order = np.lexsort((shingle, doc))
    found, doc = shingle[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])])) if len(found) else np.empty(0, np.int64)
    counts = np.diff(np.append(edge, len(found)))
    found, doc = found[edge], doc[edge]
    parts = []
    for k in range(int(counts.max(initial=1) - 1).bit_length() + 1):
        begin, length = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        has = counts > begin
        parts.append((mix(found[has] + _U((k + 1) * 0xA0761D6478BD642F % (1 << 64))), doc[has], np.full(has.sum(), float(length)), np.full(has.sum(), begin), counts[has]))
    seed, owner, rate, low, weight = map(np.concatenate, zip(*parts))
    total = np.bincount(doc, counts, docs)
    until = registers / np.maximum(total, 1) * (np.log(registers) + 2)
    out = np.full((docs, registers), np.inf)
    flat = out.reshape(-1)
    open_ = total > 0
    while open_.any():
        out[open_] = np.inf
        use = np.flatnonzero(open_[owner])
        expected = until[owner[use]] * rate[use]
        size = np.maximum(np.ceil(np.log2(expected + 3 * np.sqrt(expected) + 2)), 1).astype(int)
        for k in np.unique(size):  # processes that need about as many points are drawn together
            some = use[size == k]
            for at in range(0, len(some), max(1 << 16 >> k, 1)):
                part = some[at : at + max(1 << 16 >> k, 1)]
                s, d, r, lo, w, t, step = seed[part], owner[part], rate[part], low[part], weight[part], np.zeros(len(part)), 0
                while len(s):
                    point = mix(s[:, None] + np.arange(step + 1, step + (1 << k) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                    times = -np.log(_uniform(point)) / r[:, None]
                    times[:, 0] += t  # one running sum: times do not depend on how many points are drawn at once
                    times = np.cumsum(times, 1)
                    row, col = np.nonzero(times <= until[d][:, None])
                    other = mix(point[row, col] ^ _U(0xE7037ED1A0B428DB))
                    where = d[row] * registers + ((other >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
                    level = lo[row] + np.floor((other & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * r[row]) + 1
                    hit = level <= w[row]
                    np.minimum.at(flat, where[hit], times[row, col][hit])
                    on = times[:, -1] <= until[d]
                    s, d, r, lo, w, t, step = s[on], d[on], r[on], lo[on], w[on], times[on, -1], step + (1 << k)
        open_ &= ~np.isfinite(out).all(1)
        until[open_] *= 2
    return out


def signature(shingle: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    return signatures(shingle, np.array([0, len(shingle)]), registers)[0]


def bands(sig: np.ndarray) -> np.ndarray:
    bits = mix(sig.view(np.uint64)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + bits[:, k])
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            b = whole.slice(first, 256)
            shingle, ends = shingles_of(b.column(1).to_pylist())
            has = np.flatnonzero(np.diff(ends))
            sig = signatures(shingle, ends)[has]
            keys = np.array([bands(x) for x in sig], np.uint64).reshape(-1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), lists], names=["node", "bands"])


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            b = whole.slice(first, 256)
            shingle, ends = shingles_of(b.column(1).to_pylist())
            sets = [numbered(shingle[i:j]).astype(np.int64) for i, j in zip(ends[:-1], ends[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "grams"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with similarity, the exact weighted Jaccard similarity of their multisets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity"))


def _residual(threshold: float):
    """Links between different components in a pair of blocks, found by exact overlaps: one for each two components met.

    The shingles of the blocks are numbered; a document's are flagged, and the flags of every other document summed.
    """

    def run(table: pa.Table) -> pa.Table:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        root = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        grams = table.column("grams").combine_chunks()
        begin = grams.offsets.to_numpy()
        number = np.unique(grams.flatten().to_numpy(), return_inverse=True)[1]
        begin = begin - begin[0]
        size, flags = np.diff(begin), np.zeros(len(number) + 1, bool)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ib = np.flatnonzero(own == j)
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(own == i):
            may = ib[(root[ib] != root[k]) & (np.minimum(size[ib], size[k]) >= threshold * np.maximum(size[ib], size[k]))]
            if len(may):
                mine = number[begin[k] : begin[k + 1]]
                flags[mine] = True
                common = np.add.reduceat(flags[number].astype(np.int32), begin[:-1])[may]
                flags[mine] = False
                for hit in may[common / (size[may] + size[k] - common) >= threshold]:
                    if root[hit] != root[k]:
                        out.append((int(min(node[k], node[hit])), int(max(node[k], node[hit]))))
                        root[root == root[hit]] = root[k]
        cols = list(zip(*out)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the texts that are near to another, and (class, class_id, kept_node) of every class
    of texts with a word; a text near to no other is the class of its own node."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("node", text_id(F.col("text")))
    sig = materialise(docs.select("node", "text").where("text is not null").mapInArrow(_signatures, "node long, bands array<long>"), "signatures")
    keyed = sig.select("node", F.explode("bands").alias("band"))
    # CENTRES members of a bucket, as good as random ones and others in every band: the smallest under an exclusive or
    other = [F.col("band") if k == 0 else F.xxhash64(F.lit(k), "band") for k in range(CENTRES)]
    picked = [F.min(F.col("node").bitwiseXOR(x)).bitwiseXOR(x).alias(f"c{k}") for k, x in enumerate(other)]
    buckets = keyed.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), *picked).where("lo <> hi")
    buckets = materialise(buckets.select("band", F.array_distinct(F.array(*(f"c{k}" for k in range(CENTRES)))).alias("centres")), "buckets")
    members = materialise(keyed.join(buckets, "band").select("band", "centres", "node").distinct(), "members")

    # one row per text that shares a bucket
    wanted = members.select("node").distinct()
    first = docs.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node")
    texts = docs.join(first.select(F.col("node").alias("n"), F.col("doc_id").alias("d")), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    sets = materialise(texts.mapInArrow(_multisets, "node long, grams array<long>").dropDuplicates(["node"]), "multisets")

    star = members.select("node", F.explode("centres").alias("centre")).where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    star = materialise(verified(star, sets), "star")
    links = star.where(F.col("similarity") >= threshold).select("a", "b")
    found = components(links)

    # links a star can't see
    placed = materialise(members.drop("centres").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where(f"lo <> hi and n > {min(CENTRES, 2)}")
    open_ = materialise(open_.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    rest = placed.join(open_, "band").join(sets, "node")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.select("band", "node", "component", "grams", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.select("band", "node", "component", "grams", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    late = materialise(rest.groupBy("band", "i", "j").applyInArrow(_residual(threshold), "a long, b long").distinct(), "late")
    if not late.isEmpty():
        found = components(links.union(late))
    placed = materialise(found, "classes")

    rows = docs.where(_worded("text")).select("doc_id", "node").join(placed, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = rows.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("least")).select("class", F.col("least.doc_id").alias("class_id"), F.col("least.node").alias("kept_node"))
    return placed, materialise(smallest, "smallest")


def _worded(text: str):
    return F.coalesce(F.col(text).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: doc_id, class_id (smallest id of its class), kept.

    kept is true for one id of each class, the smallest (and the smallest text id, if texts share it); rows that repeat
    both the id and the text are kept alike.
    """
    placed, smallest = classes(df, doc_id, text, threshold)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(_worded(text), text_id(F.col(text))).alias("node"))
    rows = rows.join(placed, "node", "left").withColumn("class", F.coalesce("component", "node"))
    out = rows.join(smallest, "class", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("class").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df with one document of each class, the one of the smallest id, once; texts without a word all stay."""
    _, smallest = classes(df, doc_id, text, threshold)
    worded = df.where(_worded(text)).withColumn("__node", text_id(F.col(text)))
    kept = worded.join(smallest.select(F.col("class_id").alias("__id"), F.col("kept_node").alias("__kept")), (F.col("__node") == F.col("__kept")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates([doc_id, "__node"]).drop("__node").unionByName(df.where(~_worded(text)))


def op3_bagminhash(spark, sf_dir: str) -> DataFrame:
    """One row per document of the whole table with its near-duplicate class."""
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"))
