"""Shards of the BM25 search: how rows are dealt, and pruning against every document's score."""

import numpy as np
import pyarrow as pa

from tracewell.llm import bm25_wand
from tracewell.llm.bm25_wand import ShardIndex, _shards


def batch(sizes):
    terms = [list(range(s)) for s in sizes]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int32()))],
        names=["doc_id", "length", "terms", "counts"],
    )


def test_shards_hold_all_rows_within_bounds(monkeypatch):
    monkeypatch.setattr(bm25_wand, "POSTINGS", 10)
    sizes = [1, 2, 30, 3, 3, 3, 3, 0, 11, 10, 1]
    found = [t.column("length").to_pylist() for t in _shards([batch(sizes), batch([4, 4, 4]).slice(1), batch([]), batch([1] * 9)], 4)]
    assert [s for part in found for s in part] == [*sizes, 4, 4, *[1] * 9]
    assert all(len(part) <= 4 and (sum(part) <= 10 or len(part) == 1) for part in found)


def test_pruning_loses_no_document(monkeypatch):
    rng = np.random.default_rng(3)
    for cells in (1 << 23, 40_000):
        monkeypatch.setattr(bm25_wand, "CELLS", cells)
        docs = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 900) for _ in range(2_000)]
        docs += docs[:40] * 2  # ties
        ids = rng.permutation(len(docs)).astype(np.int64)
        impacts = [rng.random(len(d)) for d in docs[:2_000]]
        impacts += impacts[:40] * 2
        index = ShardIndex(ids, np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(impacts))
        weights = rng.random(900) * 5
        queries = [(docs[i], weights[docs[i]]) for i in range(0, 90)] + [(np.array([7777]), np.ones(1)), (docs[0][:0], weights[:0])]
        table = np.zeros((len(docs), 900))
        for row, (d, w) in enumerate(zip(docs, impacts)):
            table[row, d] = w
        floor = np.zeros(len(queries))
        for _ in range(2):  # without floors, then with the best ones
            got, seen = index.search(queries, 5, floor)
            for i, ((terms, w), (d, s)) in enumerate(zip(queries, got)):
                scores = np.round(table[:, terms[terms < 900]] @ w[terms < 900], 6)
                want = [j for j in np.lexsort((ids, -scores))[:5] if scores[j] > 0]
                assert ids[want].tolist() == d.tolist() and np.allclose(scores[want], s, atol=2e-6)
                floor[i] = s[-1] if len(s) == 5 else 0
        assert seen < len(docs) * len(queries)


def tongues(rng, n, words=400, kinds=4):
    """Documents of kinds that share few words, dealt in turn, and their impacts; copies of some, which set high floors."""
    docs = [np.unique(np.append(rng.integers(0, words, 60) + words * (i % kinds), words * kinds + i % 7)) for i in range(n)]
    return docs, [0.2 + 0.6 * rng.random(len(d)) for d in docs]


def test_documents_of_other_kinds_are_not_evaluated():
    rng = np.random.default_rng(4)
    docs, impacts = tongues(rng, 4_096)
    index = ShardIndex(np.arange(4_096), np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(impacts))
    queries = [(docs[i], rng.random(len(docs[i])) + 1) for i in range(64)]
    first, _ = index.search(queries, 10, np.zeros(64))
    got, seen = index.search(queries, 10, np.array([s[-1] for _, s in first]))
    assert seen < 0.4 * 64 * 4_096
    table = np.zeros((4_096, 1_607))
    for row, (d, w) in enumerate(zip(docs, impacts)):
        table[row, d] = w
    for (terms, w), (d, s) in zip(queries, got):
        scores = np.round(table[:, terms] @ w, 6)
        assert np.lexsort((np.arange(4_096), -scores))[:10].tolist() == d.tolist()


def test_scores_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(5)
    n, terms = 700, np.arange(200)
    impacts = np.tile(rng.random(200), (n, 1))
    impacts[:, 3] += rng.permutation(n) * 1e-8  # scores of about 50,000, steps of 1e-5
    index = ShardIndex(np.arange(n)[::-1].copy(), np.full(n, 200), np.tile(terms, n), impacts.ravel())
    weights = np.full(200, 500.0)
    weights[3] = 1_000.0
    scores = np.round(impacts @ weights, 6)[::-1]
    want = np.lexsort((np.arange(n), -scores))[:10]
    for floor in (0.0, scores[want[-1]]):
        (ids, found), *_ = index.search([(terms, weights)], 10, np.array([floor]))[0]
        assert ids.tolist() == want.tolist() and np.allclose(found, scores[want], rtol=0, atol=2e-6)


def test_order_of_terms_and_of_queries():
    rng = np.random.default_rng(6)
    wide = rng.integers(-(1 << 63), 1 << 63, 5_000)
    for terms in (wide, np.append(wide, wide[:900]), np.append(wide, wide[:900] ^ 1), wide[:0], wide[:1]):
        order = bm25_wand._order(terms)
        assert sorted(order) == list(range(len(terms))) and (terms[order] == np.sort(terms)).all()
    docs, weights = tongues(rng, 40)
    docs, weights = [*docs, docs[0][:0]], [*weights, weights[0][:0]]
    order = bm25_wand._by_likeness(np.cumsum([0, *map(len, docs)]), np.concatenate(docs), np.concatenate(weights))
    assert sorted(order) == list(range(41))
    assert sorted(bm25_wand._by_likeness(np.zeros(3, int), docs[0][:0], weights[0][:0])) == [0, 1]
