"""Jobs whose earlier forms grew faster than their input, or differed from their SQL at size, against the listing or brute force."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import diff, findings, graph, retrieval
from tracewell.sources.shared import store

FACT = "version string, subject string, predicate string, object string, object_value string, confidence double, fact_key string"


def many(spark, types, n=60, versions=4, seed=5):
    """Random facts of some versions, with loops, parallel facts and, where types allow, triangles."""
    rng = random.Random(seed)
    keys = [f"{rng.choice(types)}:{i}" for i in range(14)]
    rows = {(f"v{v}", rng.choice(keys), rng.choice(["requires", "provides", "other"]), rng.choice(keys)) for v in range(versions) for _ in range(n)}
    return spark.createDataFrame([(v, s, p, o, "", 0.9, f"{s}|{p}|{o}|") for v, s, p, o in sorted(rows)], FACT), keys


def rows(df, *drop):
    return sorted(repr([r[c] for c in sorted(df.columns) if c not in drop]) for r in df.collect())


def test_a_node_of_many_edges_is_counted_not_listed(spark):
    f, keys = many(spark, ["component", "interface", "signal"])
    e = spark.createDataFrame([(k, k.split(":")[0], k) for k in keys], "entity_key string, entity_type string, name string")
    b, t = (store(x) for x in diff.consecutive(f))
    be, te = (diff.snapshot_entities(x, e, diff.PAIR) for x in (b, t))
    whole = diff.compare(b, t, be, te, depth=1, by=diff.PAIR, write=store)
    ent, rel = store(diff.entity_changes(diff.named_turnover(f, e))), store(diff.relationship_changes(f))
    assert rows(ent) == rows(whole["entity_changes"]) and rows(rel) == rows(whole["relationship_changes"])
    counts = diff.impact_counts(ent, rel, f, store)
    listed = whole["impacts"].groupBy(*diff.PAIR, F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(counts) == rows(listed)
    of_versions = diff.impact(diff.anchors(ent, rel, diff.PAIR), None, None, 1, diff.PAIR, write=store, facts=f)
    assert rows(of_versions) == rows(whole["impacts"])


def test_versions_beyond_one_number(spark):
    """More versions than a number has bits: pairs at the seam of two spans."""
    has = {"a": {0, 1, 62, 63, 64, 126, 127, 129}, "b": set(range(0, 130, 2)), "c": set(range(130))}
    f = spark.createDataFrame([(f"{v:03}", k) for k, vs in has.items() for v in vs] * 2, "version string, k string")
    got = {(r.base_version, r.k): r.side for r in diff.turnover(f, ("k",), f).collect()}
    want = {(f"{v:03}", k): "both" if {v, v + 1} <= vs else "base" if v in vs else "target" for k, vs in has.items() for v in range(129) if vs & {v, v + 1}}
    assert got == want


def test_more_seeds_than_a_number_has_bits(spark):
    edges = [(f"n:{i:03}", f"n:{(i * 7 + 1) % 150:03}") for i in range(150)]
    f = spark.createDataFrame([("v", a, "x", b, "", 1.0, f"{a}{b}") for a, b in edges], FACT)
    seeds = sorted({n for e in edges for n in e})
    got = graph.shortest_lengths(f, spark.createDataFrame([(s,) for s in seeds], "entity_key string"), store, ("version",)).collect()
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = set()
    for s in seeds:
        far, front = {s: 0}, {s}
        while front:
            front = {b for a in front for b in near[a]} - set(far)
            far |= {b: max(far.values()) + 1 for b in front}
        want |= {("v", s, n, d) for n, d in far.items() if d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_names_that_meet_are_drawn_again(spark):
    """The first names of nodes are made to meet: components and searches go on with others."""
    f = spark.createDataFrame([("v", f"a:{i}", "x", f"b:{i}", "", 1.0, str(i)) for i in range(50)], FACT)
    meet = lambda seed, by, key: F.abs(F.xxhash64(F.lit(seed), key)) % (10 if seed < 2 else 1 << 62)
    nodes, seed = graph.numbered(f, store, ("version",), meet)
    assert seed == 2 and nodes.select("id").distinct().count() == nodes.count() == 100


def test_long_paths_settle(spark):
    f = spark.createDataFrame([("v", f"n:{i:04}", "x", f"n:{i + 1:04}", "", 1.0, str(i)) for i in range(400)] + [("w", "n:0007", "x", "n:0009", "", 1.0, "w")], FACT)
    got = {(r.version, r.entity_key): r.component for r in graph.weak_components(f, store, by=("version",)).collect()}
    assert got == {("v", f"n:{i:04}"): "n:0000" for i in range(401)} | {("w", "n:0007"): "n:0007", ("w", "n:0009"): "n:0007"}


def test_short_ids_that_meet_are_no_repeats(spark):
    """40-bit ids of different findings, or of different impacts, that are equal by chance."""
    e = spark.createDataFrame([(k, k.split(":")[0], k) for k in ("component:A", "component:B")], "entity_key string, entity_type string, name string")
    f = spark.createDataFrame([], FACT)
    found = findings.run(f, e, "1").withColumn("finding_id", F.lit("M6-ORPHAN-0123456789"))
    n = lambda df: {r.rule: r.n for r in findings.validate(df, f, e).collect()}["duplicate_finding_id"]
    assert found.count() == 2 and n(found) == 0 and n(found.unionByName(found)) == 2
    g, keys = many(spark, ["component", "interface"], n=10, versions=2)
    b, t = diff.consecutive(g)
    ent = diff.relationship_changes(g)
    imp = diff.impact(diff.anchors(ent.select(*diff.PAIR, "change_id", F.col("subject").alias("entity_key"), F.lit("entity_added").alias("change_type")), None, diff.PAIR), b, t, 1, diff.PAIR).where("depth = 1")
    bent = store(imp.withColumn("impact_id", F.lit("M7-IMP-0123456789")).withColumn("path", F.transform("path", lambda s: s.withField("fact_key", F.lit("none")))))
    assert diff.invalid_paths(bent, b, t, diff.PAIR).count() == bent.select(*diff.PAIR, "change_id", "node").distinct().count() > 1


@pytest.mark.parametrize("types", [["component"], ["component", "interface"]])
def test_presence_agrees_with_rows(spark, types):
    f, keys = many(spark, types, versions=70, n=5)
    e = spark.createDataFrame([(k, "x", k) for k in [*keys[::2], "component:lone"]], "entity_key string, entity_type string, name string")
    named = {(r.version, k) for r in f.collect() for k in (r.subject, r.object)}
    known = {r.entity_key for r in e.collect()}
    assert {tuple(r) for r in graph.implicit_nodes(f, e, ("version",)).collect()} == {x for x in named if x[1] not in known}
    lone = graph.untouched(f, e, ("version",)).select("version", "entity_key").collect()
    assert len(lone) == len(set(lone)) and {tuple(r) for r in lone} == {(v, k) for v in {v for v, _ in named} for k in known} - named


def test_evidence_of_facts_without_provenance_reads_no_facts(spark):
    f, keys = many(spark, ["component", "interface"], n=8, versions=2)
    e = spark.createDataFrame([(k, k.split(":")[0], "same") for k in keys], "entity_key string, entity_type string, name string")
    found = store(findings.run(f, e, "version", by=("version",)))
    rows_ = findings.evidence(found, f.unionByName(f), e, ("version",)).where("kind = 'fact'")
    assert rows_.count() == found.select(F.explode("fact_keys")).count() > 0 and rows_.where("provenance is not null").isEmpty()


def test_words_of_few_texts_are_held_at_once():
    texts = [f"word{i} and again word{i} {i % 7}" for i in range(1_300)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(1_300)), pa.array(["d"] * 1_300), pa.array(texts)], names=["chunk_id", "document_name", "text"])
    out = list(retrieval._terms(iter([whole])))
    assert max(b.num_rows for b in out) <= retrieval.TEXTS and [x for b in out for x in b.column("chunk_id").to_pylist()] == list(range(1_300))
    assert out[-1].column("terms").to_pylist()[-1] == ["word1299", "again", "4"] and out[-1].column("tf").to_pylist()[-1] == [2, 1, 1]
    vectors = list(retrieval._embed(iter([whole.select([0, 2])])))
    assert max(b.num_rows for b in vectors) <= retrieval.TEXTS and sum(b.num_rows for b in vectors) == 1_300
