"""Exact BM25 top-k search with block-max dynamic pruning, per shard, merged exactly (operator 4).

Queries are dealt into blocks of at most about TERMS terms, or QUERIES rows if those are fewer; a block goes to all
tasks, and each task reads its part of the table once, as shards of at most SHARD rows or POSTINGS postings, so neither
documents nor queries are shuffled or repeated.  A shard builds an inverted index.  The postings of a query's rare terms
are added up first; frequent terms stand in a matrix, cut at blocks of BLOCK documents, with the largest impact of each
term in each block.  Like documents share blocks and like queries follow each other, so that bounds are tight and many
queries leave out the same blocks.  A block is evaluated for a query only if the most its rare terms add to a document and
the block's maxima of the frequent ones reach the query's floor, the k-th best score so far in the task; so nothing that
could enter the top k is passed over (block-max WAND, with the pivot moved over a shard's blocks at once).  An evaluation
is a product in single precision, for many queries at once; what it can't place below the floor, by its error's bound, is
summed in double precision, and only such scores are ranked.
Document frequencies, the number of documents and their mean length are those of the whole table, so scores of
different shards compare, and the merge of the tasks' top k is the exact top k.

Terms are 64-bit hashes.  Scores are rounded to six places before they are ranked; ties go to the smaller id.

Edge cases: a null or empty text matches nothing and, as a query, returns no row; texts of any length are used whole;
a row without an id counts in the statistics but can't be returned; rows that repeat an id are all searched, and
queries that repeat id and text are asked once; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunkcache import ChunkCache
from .common import materialise, materialise_blocks, text_id

K1, B = 1.5, 0.75
SHARD, BLOCK, QUERIES, DENSE = 4_096, 256, 32_768, 32
CLUSTERS, CLUSTERED = 8, 256  # groups of like documents in a shard, told apart by so many of its most frequent terms
TOGETHER = 128  # queries that share a product
POSTINGS = 1 << 20  # that a shard holds, unless one document alone has more
CELLS = 1 << 23  # of a shard's matrix of frequent terms
TERMS = 1 << 22  # terms that the queries of a block hold, about: 64 MB, on the driver and in every worker
_WORD = re.compile(r"[^\W_]+").findall


@lru_cache(maxsize=1)
def _hashes() -> ChunkCache:
    return ChunkCache(lambda words: [xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) - (1 << 63) for w in words], 200_000)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(at, 1_000) for b in batches for at in range(0, b.num_rows, 1_000)):
        ids, counts, lengths = [], [], []
        for text in b.column(2).to_pylist():
            found = Counter(_WORD((text or "").lower()))
            ids.append(np.array(_hashes().get(list(found)), np.int64))
            counts.append(np.fromiter(found.values(), np.int32, len(found)))
            lengths.append(int(counts[-1].sum()))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(lengths, pa.int64()), _lists(ids, pa.int64()), _lists(counts, pa.int32())], names=["doc_id", "tid", "length", "terms", "counts"])


class ShardIndex:
    """Postings of a shard by term.  Terms in at least one document of DENSE stand in a matrix instead, by document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """ids: of the documents; sizes: distinct terms of each; terms, impacts: theirs, one after the other."""
        n, order = len(ids), _order(terms)
        terms, self.impact = terms[order], impacts[order]
        self.start = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
        self.size = np.diff(np.append(self.start, len(terms)))
        self.terms = terms[self.start]
        doc = np.repeat(np.arange(n), sizes)[order]
        dense = np.flatnonzero(self.size * DENSE >= n)
        frequent = dense[np.argsort(-self.size[dense], kind="stable")]
        if len(dense) * n > CELLS:  # the most frequent ones
            dense = np.sort(frequent[: CELLS // n])
        moved = np.lexsort((sizes, _alike(self._matrix(frequent[:CLUSTERED], doc, n).astype(np.float32))))  # like documents share blocks
        place = np.empty(n, np.int64)
        place[moved] = np.arange(n)
        self.ids, self.doc = ids[moved], place[doc]
        self.column = np.full(len(self.terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.exact = self._matrix(dense, self.doc, n)
        self.matrix = self.exact.astype(np.float32)
        self.edges = np.arange(0, n, BLOCK)
        self.top = np.array([self.matrix[e : e + BLOCK].max(0) for e in self.edges], np.float32).reshape(len(self.edges), len(dense))  # block maxima
        self.slack = (len(dense) + 16) * 2.0**-23  # twice the bound of a single-precision sum's relative error, all terms being positive

    def _matrix(self, columns: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        posts, out = self._ranges(self.start[columns], self.size[columns]), np.zeros((n, len(columns)))
        out[doc[posts], np.repeat(np.arange(len(columns)), self.size[columns])] = self.impact[posts]
        return out

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among the shard's, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """`search_places` for queries given as (terms, weights)."""
        ends = np.cumsum([0, *(len(t) for t, _ in queries)])
        terms, weights = (np.concatenate([q[x] for q in queries]) for x in (0, 1))
        return self.search_places(self.lookup(terms), weights, ends, k, floor)

    def search_places(self, at: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (places of terms and weights, one query after the other, with their ends), ids and rounded scores of
        the best k by (score, smaller id), but for documents below its floor; and how many (document, query) pairs were
        evaluated."""
        n, q = len(self.ids), len(ends) - 1
        who, has = np.repeat(np.arange(q), np.diff(ends)), at >= 0
        at, weights, who = at[has], weights[has], who[has]
        column = self.column[at]
        common = column >= 0
        dense = np.zeros((q, self.matrix.shape[1]))
        dense[who[common], column[common]] = weights[common]
        at, weights, who = at[~common], weights[~common], who[~common]
        rare, cut = np.empty((q, n)), np.searchsorted(who, np.append(np.arange(0, q, 16), q))
        for first, a, b in zip(range(0, q, 16), cut, cut[1:]):  # few at once, so that arrays stay in the cache
            size = self.size[at[a:b]]
            posts = self._ranges(self.start[at[a:b]], size)
            cells = self.doc[posts] + np.repeat((who[a:b] - first) * n, size)
            part = rare[first : first + 16]
            part[:] = np.bincount(cells, self.impact[posts] * np.repeat(weights[a:b], size), part.size).reshape(part.shape)
        scores, single = rare.astype(np.float32), dense.astype(np.float32)
        least = ((floor - 1e-6) * (1 - self.slack)).astype(np.float32)
        bound = np.maximum.reduceat(scores, self.edges, 1) + single @ self.top.T
        open_ = (bound >= least[:, None]) & (bound > 0)
        for e, block in zip(self.edges, open_.T):
            if block.mean() > 0.8:  # rows of closed blocks then are whole sums, below the floor too
                scores[:, e : e + BLOCK] += single @ self.matrix[e : e + BLOCK].T
            elif block.any():
                scores[block, e : e + BLOCK] += single[block] @ self.matrix[e : e + BLOCK].T
        seen = int((open_.sum(0) * np.diff(np.append(self.edges, n))).sum())
        wanted = (scores >= least[:, None]) & (scores > 0)  # a closed block's sums lack frequent terms, but are below the floor
        for i in np.flatnonzero(wanted.sum(1) > 2 * k):
            kth = float(np.partition(scores[i], n - k)[n - k])
            wanted[i] &= scores[i] >= (kth * (1 - self.slack) - 1e-6) * (1 - self.slack)
        rows, found = np.nonzero(wanted)
        score = rare[rows, found]
        cut = np.searchsorted(rows, np.arange(q + 1))
        out = []
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            for x in range(a, b, 512):
                some = slice(x, min(x + 512, b))
                score[some] += np.einsum("ij,j->i", self.exact[found[some]], dense[i])
            out.append(_best(self.ids[found[a:b]], np.round(score[a:b], 6), k) if b > a else (self.ids[:0], score[:0]))
        return out, seen


def _order(terms: np.ndarray) -> np.ndarray:
    """An order that sorts the terms.  Keys of a term's upper bits and its place sort much faster than places by terms."""
    low = (1 << len(terms).bit_length()) - 1
    order = np.sort(terms & ~low | np.arange(len(terms))) & low
    sorted_ = terms[order]
    return np.argsort(terms) if (sorted_[1:] < sorted_[:-1]).any() else order  # terms that differ in lower bits only


def _by_likeness(ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order of queries (numbers of terms and weights, one after the other) in which like ones follow each other, so that they leave
    out the same blocks."""
    times = np.bincount(terms)
    column = np.full(len(times), -1)
    frequent = np.argsort(-times, kind="stable")[:CLUSTERED]
    column[frequent] = np.arange(len(frequent))
    sizes, column = np.diff(ends), column[terms]
    matrix, has = np.zeros((len(sizes), len(frequent)), np.float32), column >= 0
    matrix[np.repeat(np.arange(len(sizes)), sizes)[has], column[has]] = np.log1p(weights[has])
    return np.lexsort((sizes, _alike(matrix)))


def _alike(matrix: np.ndarray) -> np.ndarray:
    """A group for each row: of the nearest by cosine of CLUSTERS centres, which start far from each other."""
    if not matrix.size:
        return np.zeros(len(matrix), np.int64)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    unit = matrix / np.maximum(length, 1e-30)[:, None]
    usual = length >= np.median(length)
    centres, near = unit[[length.argmax()]], np.full(len(unit), -1, np.float32)
    for _ in range(CLUSTERS - 1):
        near = np.maximum(near, unit @ centres[-1])
        centres = np.concatenate([centres, unit[[np.where(usual, near, 2).argmin()]]])
    for _ in range(3):
        group = (unit @ centres.T).argmax(1)
        sums = np.eye(CLUSTERS, dtype=np.float32)[group].T @ unit
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-30)[:, None]
    return (unit @ centres.T).argmax(1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.Table]:
    """The rows of (doc_id, length, terms, counts), in tables of at most `shard` rows and, with over one row, POSTINGS terms."""
    held: list[pa.RecordBatch] = []
    rows = posts = 0
    for b in batches:
        ends, at = b.column("terms").offsets.to_numpy(), 0
        while at < b.num_rows:
            fit = int(np.searchsorted(ends, ends[at] + POSTINGS - posts, "right")) - 1
            upto = min(max(fit, at if rows else at + 1), at + shard - rows, b.num_rows)
            if upto > at:
                held.append(b.slice(at, upto - at))
                rows, posts, at = rows + upto - at, posts + int(ends[upto] - ends[at]), upto
            if at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, posts = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search(asked, k: int, mean: float, shard: int):
    """asked: a broadcast of ids, content ids, ends of the lists, distinct terms, places in these and weights of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tids, ends, vocabulary, place, all_weights = asked.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        floor = np.zeros(len(ids))
        for docs in _shards(batches, shard) if len(ids) else ():
            terms, counts = docs.column("terms").combine_chunks(), docs.column("counts").combine_chunks().flatten().to_numpy()
            sizes = np.diff(terms.offsets.to_numpy())
            norm = K1 * (1 - B + B * docs.column("length").to_numpy() / mean)
            index = ShardIndex(docs.column("doc_id").to_numpy(), sizes, terms.flatten().to_numpy(), counts / (counts + np.repeat(norm, sizes)))
            del docs, terms, counts
            places = index.lookup(vocabulary)
            for at in range(0, len(ids), TOGETHER):
                cut = ends[at : at + TOGETHER + 1]
                part = slice(cut[0], cut[-1])
                found, _ = index.search_places(places[place[part]], all_weights[part], cut - cut[0], k, floor[at : at + TOGETHER])
                for i, (d, s) in enumerate(found, at):
                    if len(d):
                        best[i] = _best(np.concatenate([best[i][0], d]), np.concatenate([best[i][1], s]), k)
                        if len(best[i][0]) == k:
                            floor[i] = best[i][1][-1]
            del index
        many = np.array([len(d) for d, _ in best], np.int64)
        if many.sum():
            columns = [np.repeat(ids, many), np.repeat(tids, many), np.concatenate([d for d, _ in best]), np.concatenate([s for _, s in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "tid", "doc_id", "score"])

    return run


def top_k(df: DataFrame, is_query, k: int = 10, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, doc_id, score: the best k documents of df for every row of df that `is_query` (a condition) selects."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_id(F.col(text)).alias("tid"), F.col(text).alias("text"))
    docs = materialise(rows.mapInArrow(_terms, "doc_id long, tid long, length long, terms array<long>, counts array<int>"), "terms")
    n, total, asked, held = docs.agg(F.count(F.lit(1)), F.sum("length"), F.count_if(is_query), F.sum(F.when(is_query, F.size("terms")))).first()
    mean = (total or 0) / max(n, 1) or 1.0
    df_ = materialise(docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    found = docs.where(is_query).dropDuplicates(["doc_id", "tid"]).select(F.col("doc_id").alias("query_id"), "tid", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    found = found.select("query_id", "tid", F.col("x.terms").alias("term"), F.col("x.counts").alias("qtf")).join(df_, "term")
    weight = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
    vectors = found.groupBy("query_id", "tid").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("v"))
    groups = max(math.ceil(asked / queries), math.ceil((held or 0) / TERMS), 1)
    part = F.pmod(F.xxhash64("query_id", "tid"), F.lit(groups)).cast("int")
    vectors = vectors.select("query_id", "tid", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"), part.alias("part"))
    vectors = materialise(vectors.sortWithinPartitions("part"), "queries")  # sorted, so that a block reads few row groups
    searched = docs.where("doc_id is not null and length > 0").select("doc_id", "length", "terms", "counts")
    rank = F.row_number().over(Window.partitionBy("query_id", "tid").orderBy(F.col("score").desc(), "doc_id"))

    def blocks() -> Iterator[DataFrame]:
        for p in range(groups):
            block = vectors.where(F.col("part") == p).toArrow().combine_chunks()
            terms, weights = (pa.concat_arrays(block.column(c).chunks or [pa.array([], block.schema.field(c).type)]) for c in ("terms", "weights"))
            ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
            vocabulary, place = np.unique(terms.flatten().to_numpy(), return_inverse=True)
            order = _by_likeness(ends, place, weights.flatten().to_numpy())
            sizes, places = np.diff(ends)[order], ShardIndex._ranges(ends[:-1][order], np.diff(ends)[order])
            sent = df.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy()[order], block.column("tid").to_numpy()[order], np.concatenate([[0], np.cumsum(sizes)]), vocabulary, place[places].astype(np.int32), weights.flatten().to_numpy()[places]))
            hits = searched.mapInArrow(_search(sent, k, mean, shard), "query_id long, tid long, doc_id long, score double")
            yield hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
            sent.destroy()

    return materialise_blocks(df.sparkSession, blocks(), "query_id long, rank long, doc_id long, score double", "hits")


def op4_bm25_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, its whole text being the query."""
    from .common import read

    return top_k(read(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


OP4_SQL = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 AS w FROM tf JOIN df USING (term), corpus WHERE doc_id % 100 = 0),
s AS (
  SELECT query_id, doc_id, round(sum(w * tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN len USING (doc_id), corpus GROUP BY 1, 2
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
