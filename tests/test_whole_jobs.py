"""Whole jobs without SQL, or of many versions at once, each against brute force."""

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tracewell.operators import diff, findings, graph, retrieval
from tracewell.plans import queries as plans
from tracewell.sources import adapters as A
from tracewell.sources.shared import store


def facts(spark, rows):
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double")
    return df.withColumn("fact_key", F.concat_ws("|", "subject", "predicate", "object", F.lit("")))


def bfs(edges, seeds, directed=False):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    out = set()
    for seed in seeds:
        far, queue = {seed: 0}, deque([seed])
        while queue:
            a = queue.popleft()
            for b in near[a] - set(far):
                far[b] = far[a] + 1
                queue.append(b)
        out |= {(seed, n, d) for n, d in far.items() if d}
    return out


EDGES = [(f"n:{i:02}", f"n:{i + 1:02}") for i in range(9)] + [("n:09", "n:00"), ("n:04", "m:1"), ("m:1", "m:2"), ("m:2", "m:2"), ("far:1", "far:2")]


@pytest.mark.parametrize("directed", [False, True])
def test_shortest_lengths_have_no_limit(spark, directed):
    seeds = ["n:00", "m:2", "lone:1"]
    got = graph.shortest_lengths(facts(spark, [(a, "x", b, 1.0) for a, b in EDGES]), spark.createDataFrame([(s,) for s in seeds], "entity_key string"), store, directed=directed).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == bfs(EDGES, seeds, directed)


def test_shortest_lengths_of_every_version(spark, sf):
    rows = plans.queries()["shortest_path_len"](spark, sf).collect()
    edges, seeds = defaultdict(list), {r.entity_key for r in A.entities(spark, sf).where("entity_type = 'signal'").collect()}
    for r in A.facts(spark, sf).collect():
        edges[r.version].append((r.subject, r.object))
    want = {(v, *x) for v, e in edges.items() for x in bfs(e, seeds & {n for pair in e for n in pair})}
    assert len(rows) == len(want) and {(r.version, r.seed, r.node, r.length) for r in rows} == want and max(r.length for r in rows) > 2


@pytest.mark.parametrize("directed", [False, True])
def test_shortest_paths(spark, directed):
    pairs = [("n:00", "m:2"), ("m:2", "n:07"), ("n:03", "n:03"), ("n:00", "far:2"), ("n:02", "n:08"), ("gone:1", "n:00")]
    got = graph.shortest_paths(facts(spark, [(a, "x", b, 1.0) for a, b in EDGES]), spark.createDataFrame(pairs, "source string, target string"), store, directed=directed).collect()
    near = defaultdict(set)
    for a, b in EDGES:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    nodes = {n for e in EDGES for n in e}
    want = {}
    for s, t in pairs:
        level = {s: [s]} if s in nodes else {}
        seen = dict(level)
        while level and t not in seen:
            level = {b: min(p + [b] for a, p in level.items() if b in near[a]) for b in set().union(*(near[a] for a in level)) - set(seen)}
            seen |= level
        if t in seen:
            want[s, t] = seen[t]
    assert {(r.source, r.target): r.path for r in got} == want and all(r.length == len(r.path) - 1 for r in got)


@pytest.mark.parametrize("block", [2, 64])
def test_cosine_meets_every_label(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([1, 2, 3, None])) for i in range(60)]
    odd = [(90, None, 1), (91, [0.0] * 8, 1), (92, [1.0] * 3, 1), (93, [float("nan")] * 8, 2)]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)
    for same in (False, True):
        got = {(r.query_id, r.vec_id): (r["rank"], r.similarity) for r in retrieval.cosine_topk(v, v.where("vec_id % 10 = 0"), 5, same, block).collect()}
        want = {}
        for q, e, label in rows[::10]:
            best = sorted((-cos(e, f), i) for i, f, other in rows if not same or (label is not None and other == label))[:5]
            want |= {(q, i): (n, -s) for n, (s, i) in enumerate(best, 1)}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_all_versions_are_those_of_each(spark, sf):
    """Graph, findings, diff and components of one month alone give the rows of the job over all months."""
    every, known, e = store(A.facts(spark, sf)), plans._known(spark, sf), A.entities(spark, sf)
    one = A.facts(spark, sf, (A.TARGET,))
    rows = lambda df, *drop: sorted(repr([r[c] for c in sorted(df.columns) if c not in drop]) for r in df.collect())
    here = lambda df: df.where(F.col("version") == A.TARGET)
    assert rows(here(every), "version") == rows(one, "version")
    assert rows(here(graph.build_nodes(every, known, ("version",))), "version") == rows(graph.build_nodes(one, known))
    all_found, found = findings.run(every, known, "version", by=("version",)), findings.run(one, known, A.TARGET)
    assert rows(here(all_found), "version") == rows(found)
    b, t = diff.consecutive(every)
    pair = (F.col("base_version") == A.BASE) & (F.col("target_version") == A.TARGET)
    all_changes = diff.relationship_diff(b, t, diff.PAIR).where(pair)
    assert rows(all_changes, *diff.PAIR) == rows(diff.relationship_diff(A.facts(spark, sf, (A.BASE,)), one, labels=(A.BASE, A.TARGET)))
    be, te = (diff.snapshot_entities(x, e, diff.PAIR) for x in (b, t))
    assert rows(diff.entity_diff(be, te, diff.PAIR).where(pair), *diff.PAIR) == rows(diff.entity_diff(diff.snapshot_entities(A.facts(spark, sf, (A.BASE,)), e), diff.snapshot_entities(one, e), labels=(A.BASE, A.TARGET)))
    near = defaultdict(lambda: defaultdict(set))
    for r in every.collect():
        near[r.version][r.subject].add(r.object)
        near[r.version][r.object].add(r.subject)
    want = set()
    for m, g in near.items():
        left = set(g)
        while left:
            queue = group = {min(left)}
            while queue:
                queue = set().union(*(g[x] for x in queue)) - group
                group = group | queue
            want |= {(m, x, min(group)) for x in group}
            left -= group
    got = plans.queries()["components"](spark, sf).select("version", "entity_key", "component").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_month_reaches_the_scan(spark, sf):
    plan = A.facts(spark, sf, ("1996-12",))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.weak_components(facts(spark, [(a, "x", b, 1.0) for a, b in EDGES]), store, rounds=1)
