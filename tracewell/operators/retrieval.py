"""Lexical, dense and hybrid top-k retrieval, the evidence gate and retrieval metrics, for all questions in one plan.

Questions are the stated query set.  They are dealt into blocks of bounded size; every chunk is scored against a block in
one pass, as a product of matrices, and a task hands on the best of each of its batches only, so what is exchanged grows
with tasks x questions x k, not with the pairs.  A text is cut into terms, or embedded, once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUESTION_WORDS, STOP_WORDS, gate_variants, tokenize

K1, B = 1.5, 0.75
RRF_K, POOL, TOP_K = 60, 20, 5
OVERFETCH = 4
DIM = 512
MIN_SCORE, MIN_HITS, MIN_LEXICAL, MIN_COVERAGE, MIN_AGREEMENT = 0.10, 1, 0.25, 0.30, 0.0
FILTERABLE = ("document_name", "version", "section_no", "chunk_type", "sha256", "page_in")
BLOCK = 1024  # questions scored in one pass
CELLS = 1 << 23  # numbers a block of questions may hold on a worker (64 MB)
_STOP = frozenset(STOP_WORDS)
_TERM = re.compile("[a-z0-9]+")
Write = Callable[[DataFrame], DataFrame]


def keep(df: DataFrame) -> DataFrame:
    return df


def token_stats(chunks: DataFrame) -> DataFrame:
    t = chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens"))
    return t.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, term, qtf: repeats in a question count as often as they occur."""
    return questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


# --- the index: terms of each chunk, and what is known of all ------------------------------------------------------------


TEXTS = 512  # texts whose words are held at once, however many rows a batch has


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _cut(batches):
        counted = [Counter(t for t in _TERM.findall((x or "").lower()) if t not in _STOP) for x in b.column("text").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int32)
        terms = pa.array([t for c in counted for t in c], pa.string())
        tf = pa.array([n for c in counted for n in c.values()], pa.int32())
        dl = pa.array([sum(c.values()) for c in counted], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), dl, pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tf)], names=["chunk_id", "document_name", "dl", "terms", "tf"])


def lexical_index(chunks: DataFrame, write: Write = keep) -> DataFrame:
    """chunk_id, document_name, dl, terms, tf: a row a chunk, written once; all lexical operators read it."""
    kinds = dict(chunks.dtypes)
    return write(chunks.select("chunk_id", "document_name", "text").mapInArrow(_terms, f"chunk_id {kinds['chunk_id']}, document_name {kinds['document_name']}, dl long, terms array<string>, tf array<int>"))


def corpus_stats(index: DataFrame) -> tuple[int, float]:
    row = index.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return row["n"], row["avgdl"] or 1.0


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weights(index: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """terms (question_id, term, ...) with df and idf over the whole corpus; a term that no chunk holds has df 0."""
    asked = terms.select("term").distinct()
    df = index.select(F.explode("terms").alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return out.withColumn("idf", idf(n, F.col("df")))


def _blocks(df: DataFrame, key: str, n: int, size: int) -> Iterator[DataFrame]:
    """df in parts of about `size` of its n keys."""
    parts = max(-(-n // size), 1)
    for k in range(parts):
        yield df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)


def _best(scores: np.ndarray, k: int, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each column, the rows of its k largest values over `above` and those that tie with the last of them."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k, 0)[len(scores) - k]
        return np.nonzero((scores >= floor) & (scores > above))
    return np.nonzero(scores > above)


def _hits(b: pa.RecordBatch, ids: pa.Array, scores: np.ndarray, k: int, above: float = 0.0) -> pa.RecordBatch:
    row, col = _best(np.round(scores, 6), k, above)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(col)), b.column("chunk_id").take(pa.array(row)), b.column("document_name").take(pa.array(row)), pa.array(np.round(scores[row, col], 6))], names=["question_id", "chunk_id", "document_name", "score"])


def _slices(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(min(CELLS // max(width, 1), 4096), 1)
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def _score_terms(weights: list, ids: list, kind: pa.DataType, avgdl: float, k: int):
    """weights: (position of the question in ids, term, weight)."""
    terms = {t: i for i, t in enumerate(sorted({t for _, t, _ in weights}))}
    matrix = np.zeros((len(terms), len(ids)))
    for q, t, w in weights:
        matrix[terms[t], q] = w
    names = pa.array(ids, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(terms) + len(ids)):
                lists = b.column("terms")
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                col = np.fromiter((terms.get(t, -1) for t in lists.flatten().to_pylist()), np.int64)
                tf, dl = b.column("tf").flatten().to_numpy(), b.column("dl").to_numpy()
                row, col, tf = row[col >= 0], col[col >= 0], tf[col >= 0]
                seen = np.zeros((b.num_rows, len(terms)))
                seen[row, col] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                yield _hits(b, names, seen @ matrix, k)

    return run


def _hit_schema(questions: DataFrame, index: DataFrame) -> str:
    kinds = dict(index.dtypes)
    return f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {kinds['chunk_id']}, document_name {kinds['document_name']}, score double"


def _arrow_kind(questions: DataFrame) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(dict(questions.dtypes)["question_id"], pa.string())


def top(scored: DataFrame, k: int, *order: Column, by: str = "question_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top(hits, k, F.col("score").desc(), F.col("document_name"), F.col("chunk_id"))


def lexical_topk(index: DataFrame, questions: DataFrame, k: int = POOL, stats: tuple[int, float] | None = None) -> DataFrame:
    """question_id, chunk_id, document_name, score (BM25, six places), rank, similarity (the score bounded to [0, 1)).

    Ties go by document name and chunk id.  index: see `lexical_index`.
    """
    n, avgdl = stats or corpus_stats(index)
    terms = query_terms(questions)
    weighted = term_weights(index, terms, n).where("df > 0").select("question_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    asked, vocabulary = weighted.agg(F.count_distinct("question_id"), F.count_distinct("term")).first()
    size = max(min(BLOCK, CELLS // max(vocabulary, 1)), 1)
    schema, parts = _hit_schema(questions, index), []
    for block in _blocks(weighted, "question_id", asked, size):
        rows = block.collect()  # a block of questions, bounded
        ids = sorted({r["question_id"] for r in rows})
        at = {q: i for i, q in enumerate(ids)}
        kind = _arrow_kind(questions)
        parts.append(index.mapInArrow(_score_terms([(at[r["question_id"]], r["term"], r["w"]) for r in rows], ids, kind, avgdl, k), schema))
    hits = _ranked(reduce(DataFrame.union, parts), k)
    return hits.withColumn("similarity", F.bround(F.col("score") / (F.col("score") + K1), 6))


# --- filters -----------------------------------------------------------------------------------------------------------


def split_filters(filters: dict) -> tuple[dict, tuple[int, int] | None]:
    """Equality filters, and the page range that is applied after the top k; an unknown key is an error."""
    unknown = set(filters) - set(FILTERABLE)
    if unknown:
        raise ValueError(f"unknown filter {sorted(unknown)}")
    pages = filters.get("page_in")
    return {k: v for k, v in filters.items() if k != "page_in"}, (pages, pages) if isinstance(pages, int) else pages


def equal(df: DataFrame, filters: dict) -> DataFrame:
    for name, value in filters.items():
        df = df.where(F.col(name) == value)
    return df


def on_pages(df: DataFrame, pages: tuple[int, int] | None) -> DataFrame:
    """Rows whose span of pages meets [lo, hi]."""
    return df.where((F.col("page_start") <= pages[1]) & (F.col("page_end") >= pages[0])) if pages else df


def _metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", *[c for c in ("version", "section_no", "chunk_type", "sha256", "page_start", "page_end") if c in chunks.columns])


def lexical_filtered(chunks: DataFrame, questions: DataFrame, filters: dict, k: int = TOP_K, prefilter: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Top k after filters: by default the pool is cut before they apply, so fewer than k may remain."""
    where, pages = split_filters(filters)
    if prefilter:
        return lexical_topk(lexical_index(on_pages(equal(chunks, where), pages)), questions, k)
    pool = lexical_topk(index if index is not None else lexical_index(chunks), questions, max(POOL, k)).drop("rank").join(_metadata(chunks), "chunk_id")
    return _ranked(on_pages(equal(pool, where), pages), k)


# --- dense -------------------------------------------------------------------------------------------------------------


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, same_label: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity, rank over all vectors, or over those of the query's label (a filter on the pairs).

    Queries are dealt into blocks; each block is one pass over the vectors as a product of matrices.  A vector that is
    null, of another length, zero or not finite meets nothing.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    parts = []
    n = q.count()
    for part in _blocks(q, "query_id", n, block):
        rows = [r for r in part.collect() if r["embedding"]]  # a block of queries, bounded
        matrix = np.array([r["embedding"] for r in rows], np.float64) if rows else np.zeros((0, 1))
        size = np.sqrt((matrix * matrix).sum(1))
        good = np.isfinite(size) & (size > 0)
        matrix, ids, labels = (matrix[good] / size[good][:, None]).T, [r["query_id"] for r, g in zip(rows, good) if g], np.array([r["label"] if r["label"] is not None else -1 for r, g in zip(rows, good) if g])
        parts.append(vectors.select("vec_id", "embedding", F.coalesce("label", F.lit(-2)).alias("label")).mapInArrow(_score_vectors(matrix, ids, labels if same_label else None, k), "query_id long, vec_id long, similarity double"))
    return top(reduce(DataFrame.union, parts), k, F.col("similarity").desc(), F.col("vec_id"), by="query_id")


def _score_vectors(matrix: np.ndarray, ids: list, labels: np.ndarray | None, k: int):
    names, dim = np.array(ids, np.int64), matrix.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, dim + len(ids)):
                column = b.column("embedding")
                use = np.flatnonzero(np.diff(column.offsets.to_numpy()) == dim) if len(ids) else np.empty(0, np.int64)
                use = use[np.array(column.is_valid())[use]] if len(use) else use
                v = column.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(use), dim)
                size = np.sqrt((v * v).sum(1))
                good = np.isfinite(size) & (size > 0)
                v, use = v[good] / size[good][:, None], use[good]
                scores = np.round(v @ matrix, 6)
                if labels is not None:
                    scores[np.array(b.column("label"))[use][:, None] != labels[None, :]] = -np.inf
                floor = np.partition(scores, len(scores) - k, 0)[len(scores) - k] if len(scores) > k else -np.inf
                row, col = np.nonzero((scores >= floor) & np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(names[col]), b.column("vec_id").cast(pa.int64()).take(pa.array(use[row])), pa.array(scores[row, col])], names=["query_id", "vec_id", "similarity"])

    return run


@lru_cache(maxsize=400_000)
def _place(feature: str) -> int:
    """The bucket of a feature, and its sign in the lowest bit."""
    h = hashlib.md5(feature.encode("utf-8", "replace")).digest()
    return (int.from_bytes(h[:4], "little") % DIM) << 1 | h[4] & 1


def embed(text: str | None) -> np.ndarray:
    """The signed feature-hashing embedding of words and character trigrams, of unit length (zero for a text without)."""
    tokens = _TERM.findall((text or "").lower())
    joined = " ".join(tokens)
    found = Counter(joined[i : i + 3] for i in range(len(joined) - 2))
    out = np.zeros(DIM)
    for prefix, counts in (("w:", Counter(tokens)), ("c:", found)):
        at = np.fromiter((_place(prefix + f) for f in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        out += np.bincount(at >> 1, np.where(at & 1, -n, n), DIM)
    size = np.sqrt(out @ out)
    return out / size if size else out


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _cut(batches):
        v = np.concatenate([embed(t) for t in b.column(1).to_pylist()] or [np.empty(0)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * DIM, pa.int32()), pa.array(v))], names=["key", "vector"])


def hash_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, vector (array of 512): a row stays where it is."""
    return df.select(key, text).mapInArrow(_embed, f"key {dict(df.dtypes)[key]}, vector array<double>").withColumnRenamed("key", key)


def _score_texts(matrix: np.ndarray, ids: list, kind: pa.DataType, k: int):
    names = pa.array(ids, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, DIM + len(ids)):
                v = np.array([embed(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, DIM)
                yield _hits(b, names, v @ matrix, k, -np.inf)

    return run


def dense_topk(chunks: DataFrame, questions: DataFrame, k: int = POOL, filters: dict | None = None) -> DataFrame:
    """question_id, chunk_id, document_name, similarity, rank by the cosine of hashed embeddings.

    Equality filters apply before the search; a page range after the best 4 k of it.  Ties go by document name and chunk id.
    """
    where, pages = split_filters(filters or {})
    searched = equal(chunks, where).select("chunk_id", "document_name", "text")
    fetch = k * OVERFETCH if pages else k
    schema = _hit_schema(questions, chunks)
    kind = _arrow_kind(questions)
    q = hash_vectors(questions, "question_id", "question")
    parts = []
    for block in _blocks(q, "question_id", questions.count(), BLOCK):
        rows = block.collect()  # a block of questions, bounded
        parts.append(searched.mapInArrow(_score_texts(np.array([r["vector"] for r in rows]).reshape(len(rows), DIM).T, [r["question_id"] for r in rows], kind, fetch), schema))
    hits = _ranked(reduce(DataFrame.union, parts), fetch).withColumnRenamed("score", "similarity")
    if not pages:
        return hits
    kept = on_pages(hits.drop("rank").join(_metadata(chunks), "chunk_id"), pages).select("question_id", "chunk_id", "document_name", "similarity")
    return top(kept, k, F.col("similarity").desc(), F.col("document_name"), F.col("chunk_id"))


# --- fusion ------------------------------------------------------------------------------------------------------------


def rrf(lexical: DataFrame, dense: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: question_id, chunk_id, document_name, lexical_rank, dense_rank, lexical_score, similarity,
    sources, rrf_score, rank.

    A hit of both legs keeps the lexical similarity.  Ties go by document name and chunk id.
    """
    key = ["question_id", "chunk_id", "document_name"]
    lex = lexical.select(*key, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"), F.col("similarity").alias("ls"))
    fused = lex.join(dense.select(*key, F.col("rank").alias("dense_rank"), F.col("similarity").alias("ds")), key, "full_outer")
    score = F.coalesce(1 / (rrf_k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("dense_rank")), F.lit(0.0))
    sources = F.when(F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull(), "dense+lexical").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("dense")
    out = fused.select("question_id", "chunk_id", "document_name", "lexical_rank", "dense_rank", "lexical_score", F.coalesce("ls", "ds").alias("similarity"), sources.alias("sources"), F.bround(score, 6).alias("rrf_score"))
    return top(out, k, F.col("rrf_score").desc(), F.col("document_name"), F.col("chunk_id"))


MODES = ("hybrid", "dense", "lexical")


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, filters: dict | None = None, mode: str = "hybrid", index: DataFrame | None = None) -> DataFrame:
    """The best k chunks of every question in a mode, in the columns of `rrf`.

    Lexical hits are cut to the pool before filters; dense ones are filtered by equality before the search and by pages after.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    where, pages = split_filters(filters or {})
    none = lambda kind: F.lit(None).cast(kind)
    if mode == "dense":
        d = dense_topk(chunks, questions, k, filters)
        return d.select("question_id", "chunk_id", "document_name", none("long").alias("lexical_rank"), F.col("rank").alias("dense_rank"), none("double").alias("lexical_score"), "similarity", F.lit("dense").alias("sources"), none("double").alias("rrf_score"), "rank")
    index = index if index is not None else lexical_index(chunks)
    pool = lexical_topk(index, questions, max(POOL, k))
    if filters:
        pool = _ranked(on_pages(equal(pool.drop("rank").join(_metadata(chunks), "chunk_id"), where), pages), max(POOL, k))
    if mode == "lexical":
        p = pool.where(F.col("rank") <= k)
        return p.select("question_id", "chunk_id", "document_name", F.col("rank").alias("lexical_rank"), none("long").alias("dense_rank"), F.col("score").alias("lexical_score"), "similarity", F.lit("lexical").alias("sources"), none("double").alias("rrf_score"), "rank")
    return rrf(pool, dense_topk(chunks, questions, max(POOL, k), filters), k)


# --- evaluation --------------------------------------------------------------------------------------------------------


def metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """mode, n_questions, hit_at_k, mrr over questions that have gold; ranked: mode, question_id, chunk_id, rank."""
    asked = gold.select("question_id").distinct()
    modes = ranked.select("mode").distinct()
    first = ranked.join(gold, ["question_id", "chunk_id"]).groupBy("mode", "question_id").agg(F.min("rank").alias("rank"))
    every = asked.join(modes, F.lit(True)).join(first, ["mode", "question_id"], "left")
    hits = [F.bround(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}") for k in ks]
    return every.groupBy("mode").agg(F.count(F.lit(1)).alias("n_questions"), *hits, F.bround(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def page_gold(hits: DataFrame, qa: DataFrame) -> DataFrame:
    """question_id, chunk_id of hits whose pages meet the gold pages (qa: question_id, gold_pages), the rank kept."""
    return hits.join(qa.select("question_id", "gold_pages"), "question_id").where(F.arrays_overlap(F.sequence("page_start", "page_end"), "gold_pages")).drop("gold_pages")


def section_gold(hits: DataFrame, qa: DataFrame) -> DataFrame:
    """The same by section."""
    return hits.join(qa.select("question_id", "gold_sections"), "question_id").where(F.array_contains("gold_sections", F.col("section_no"))).drop("gold_sections")


def retrieval_report(hits: DataFrame, qa: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """n_questions, page and section hit shares at each k, and the mean reciprocal rank by page, in one row.

    hits: question_id, rank, page_start, page_end, section_no; qa: question_id, gold_pages, gold_sections.
    """
    page = page_gold(hits, qa).groupBy("question_id").agg(F.min("rank").alias("p"))
    section = section_gold(hits, qa).groupBy("question_id").agg(F.min("rank").alias("s"))
    every = qa.select("question_id").join(page, "question_id", "left").join(section, "question_id", "left")
    share = lambda c, k: F.bround(F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0)), 4)
    return every.agg(F.count(F.lit(1)).alias("n_questions"), *[share("p", k).alias(f"page_hit_at_{k}") for k in ks], *[share("s", k).alias(f"section_hit_at_{k}") for k in ks], F.bround(F.avg(F.coalesce(1 / F.col("p"), F.lit(0.0))), 4).alias("mrr_page"))


# --- the evidence gate -------------------------------------------------------------------------------------------------


def coverage(index: DataFrame, chunks: DataFrame, questions: DataFrame, hits: DataFrame, evidence: int = 3, stats: tuple[int, float] | None = None) -> DataFrame:
    """question_id, coverage, n_missing, missing: the IDF-weighted share of a question's content terms that its best hits hold.

    A term is covered when one of its variants is a token of the evidence.  Without a content term the share is 1, without a hit 0.
    """
    n, _ = stats or corpus_stats(index)
    content = query_terms(questions).where(~F.col("term").isin(*QUESTION_WORDS)).select("question_id", "term")
    weighed = term_weights(index, content, n)
    shown = hits.where(F.col("rank") <= evidence).select("question_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    seen = shown.select("question_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("stem")).distinct()
    covered = content.select("question_id", "term", F.explode(gate_variants(F.col("term"))).alias("stem")).join(seen, ["question_id", "stem"], "left_semi").select("question_id", "term").distinct().withColumn("hit", F.lit(True))
    per = weighed.join(covered, ["question_id", "term"], "left").groupBy("question_id").agg(F.sum("idf").alias("whole"), F.sum(F.when(F.col("hit"), F.col("idf"))).alias("part"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("term")))).alias("missing"))
    any_hit = hits.select("question_id").distinct().withColumn("any", F.lit(True))
    out = questions.select("question_id").join(per, "question_id", "left").join(any_hit, "question_id", "left")
    share = F.when(F.col("any").isNull(), 0.0).when(F.coalesce("whole", F.lit(0.0)) <= 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0)) / F.col("whole"))
    gone = F.when(F.col("any").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce("missing", F.array().cast("array<string>")))
    return out.select("question_id", F.bround(share, 6).alias("coverage"), F.size(gone).cast("long").alias("n_missing"), F.array_join(gone, ",").alias("missing"))


def gate(questions: DataFrame, hits: DataFrame, covered: DataFrame, min_score: float = MIN_SCORE, min_lexical: float = MIN_LEXICAL, min_coverage: float = MIN_COVERAGE, min_hits: int = MIN_HITS, min_agreement: float = MIN_AGREEMENT, mode: str = "hybrid") -> DataFrame:
    """One decision per question: the first failing test, else 'ok'.  hits: as `retrieve` gives them.

    The best score is that of all hits, a dense one's being its cosine.  Dense results skip the lexical tests; only hybrid
    ones have an agreement.
    """
    per = hits.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max("similarity").alias("best_similarity"),
        F.max("lexical_score").alias("best_lexical"),
        F.count_if(F.col("lexical_score") > 0).alias("lexical_hits"),
        F.bround(F.avg((F.col("sources") == "dense+lexical").cast("double")), 6).alias("agreement"),
    )
    q = questions.select("question_id").join(per, "question_id", "left").join(covered.select("question_id", "coverage"), "question_id", "left").na.fill(0, ["n_hits", "best_similarity", "best_lexical", "lexical_hits", "agreement"])
    reason = F.when(F.col("n_hits") < min_hits, "no_hits").when(F.col("best_similarity") < min_score, "low_score")
    if mode != "dense":
        reason = reason.when((F.col("lexical_hits") == 0) | (F.col("best_lexical") < min_lexical), "low_lexical").when(F.col("coverage") < min_coverage, "low_coverage")
    if mode == "hybrid":
        reason = reason.when(F.col("agreement") < min_agreement, "low_agreement")
    reason = reason.otherwise("ok")
    return q.select("question_id", "n_hits", "best_similarity", "best_lexical", "lexical_hits", "coverage", "agreement", reason.alias("reason"), (reason == "ok").alias("passed"))


def gate_sweep(decisions: DataFrame, answerable: DataFrame, score_grid=(0.10,), lexical_grid=(0.0, 0.15, 0.25, 0.35), coverage_grid=(0.0, 0.15, 0.30, 0.45)) -> DataFrame:
    """False and missed refusals at every cell of the grid of thresholds, with the questions they concern."""
    spark = decisions.sparkSession
    cells = [(float(s), float(x), float(c)) for s in score_grid for x in lexical_grid for c in coverage_grid]
    grid = F.array(*[F.struct(F.lit(s).alias("min_score"), F.lit(x).alias("min_lexical"), F.lit(c).alias("min_coverage")) for s, x, c in cells])
    flags = decisions.join(answerable.select("question_id").distinct().withColumn("has_gold", F.lit(True)), "question_id", "left").select("*", F.inline(grid))
    refused = (F.col("n_hits") < MIN_HITS) | (F.col("best_similarity") < F.col("min_score")) | (F.col("lexical_hits") == 0) | (F.col("best_lexical") < F.col("min_lexical")) | (F.col("coverage") < F.col("min_coverage"))
    false, missed = refused & F.col("has_gold").isNotNull(), ~refused & F.col("has_gold").isNull()
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("question_id")))), lambda x: x.cast("string")), ",")
    found = flags.groupBy("min_score", "min_lexical", "min_coverage").agg(F.count_if(false).alias("false_refusals"), F.count_if(missed).alias("missed_refusals"), names(false).alias("falsely_refused"), names(missed).alias("wrongly_passed"))
    every = spark.createDataFrame(cells, "min_score double, min_lexical double, min_coverage double")
    return every.join(found, ["min_score", "min_lexical", "min_coverage"], "left").na.fill(0, ["false_refusals", "missed_refusals"]).na.fill("", ["falsely_refused", "wrongly_passed"])


def nearest_rank(df: DataFrame, column: str, share: float) -> DataFrame:
    """The value at index min(n - 1, round(share * (n - 1))) of the sorted column, and the median.

    The index is found from counts by distinct value: values are cut into ranges of which only one is looked into.
    """
    n = df.where(F.col(column).isNotNull()).count()
    k = min(n - 1, int(round(share * (n - 1))))
    freq = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    bounds = df.agg(F.min(column), F.max(column)).first()
    lo, hi = float(bounds[0] or 0), float(bounds[1] or 0)
    bins = 4096
    width = (hi - lo) / bins or 1.0
    b = F.floor((F.col(column) - lo) / width)
    per = freq.groupBy(b.alias("bin")).agg(F.sum("c").alias("c")).orderBy("bin").collect()  # bins + 1 rows at most
    before = 0
    for r in per:
        if before + r["c"] > k:
            break
        before += r["c"]
    inside = freq.where(b == (r["bin"] if n else 0)).withColumn("upto", F.sum("c").over(Window.orderBy(column)) + before)
    return inside.where(F.col("upto") > k).agg(F.min(column).alias("nearest")).join(df.agg(F.percentile(column, 0.5).alias("median")), F.lit(True))

