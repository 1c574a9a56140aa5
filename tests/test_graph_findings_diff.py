import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph, registry
from tracewell.sources.shared import store

ENTITIES = [("component:C-01", "component", "Door"), ("component:C-02", "component", "Lock"), ("interface:IF-01", "interface", "LockIF"), ("signal:SG-001", "signal", "lock"), ("interface:IF-02", "interface", "lockif")]
FACTS = [("component:C-01", "provides", "interface:IF-01", 0.9), ("component:C-02", "requires", "interface:IF-01", 0.8), ("interface:IF-01", "carries", "signal:SG-001", 0.9)]


def entities(spark, rows=ENTITIES):
    return spark.createDataFrame(rows, "entity_key string, entity_type string, name string")


def facts(spark, rows=FACTS):
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double")
    return df.withColumn("fact_key", F.concat_ws("|", "subject", "predicate", "object"))


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nodes_and_degrees(spark):
    f = facts(spark, FACTS + [("component:C-01", "depends_on", "component:C-09", 0.5)])
    assert keys(graph.implicit_nodes(f, entities(spark)), "entity_key") == [("component:C-09",)]
    assert ("component:C-01", 0, 2, 2) in keys(graph.degrees(f), "entity_key", "in_degree", "out_degree", "degree")
    loop = facts(spark, [("a:1", "x", "a:1", 1.0)])
    assert keys(graph.degrees(loop), "entity_key", "degree") == [("a:1", 2)]


def test_k_hop_and_components(spark):
    seeds = spark.createDataFrame([("signal:SG-001",)], "entity_key string")
    assert keys(graph.k_hop(facts(spark), seeds, 2), "node", "depth") == [("component:C-01", 2), ("component:C-02", 2), ("interface:IF-01", 1), ("signal:SG-001", 0)]
    chain = facts(spark, [(f"n:{i:02}", "x", f"n:{i + 1:02}", 1.0) for i in range(12)] + [("m:2", "x", "m:1", 1.0), ("l:1", "x", "l:1", 1.0)])
    got = dict(keys(graph.weak_components(chain, store), "entity_key", "component"))
    assert {got[f"n:{i:02}"] for i in range(13)} == {"n:00"} and got["m:2"] == "m:1" and got["l:1"] == "l:1"


def test_facade_and_lookups(spark):
    g = graph.Graph(facts(spark, FACTS + [("component:C-01", "depends_on", "component:C-09", 0.5)]), entities(spark), store)
    assert g.shortest_path("component:C-02", "signal:SG-001") == ["component:C-02", "interface:IF-01", "signal:SG-001"]
    assert g.shortest_path("signal:SG-001", "component:C-02") is None and g.shortest_path("signal:SG-001", "component:C-02", directed=False) is not None
    assert [g.resolve(x) for x in ("c-02", "component:c-02", "component:C-02", "Door", "lockif", "LockIF", "none", "Door:1")] == ["component:C-02", "component:C-02", "component:C-02", "component:C-01", None, None, None, None]
    assert keys(g.related("interface:IF-01"), "direction", "neighbour", "neighbour_name") == [("in", "component:C-01", "Door"), ("in", "component:C-02", "Lock"), ("out", "signal:SG-001", "lock")]
    assert keys(g.filter(predicate="provides").facts, "predicate") == [("provides",)] and g.filter(predicate="provides").nodes.count() == 6
    assert g.filter(node="component:C-02", depth=1).nodes.count() == 2 and g.filter(node="component:C-02", depth=2).facts.count() == 3
    assert g.filter(node="component:C-02", depth=2, entity_type="interface").nodes.count() == 2
    assert g.filter(min_confidence=0.9, endpoints_only=True).nodes.count() == 3
    n = {r.rule: r.n for r in g.validate().collect()}
    assert n["unregistered"] == 1 and n["orphan"] == 1 and not any(n[r] for r in graph.ERRORS)
    assert keys(graph.dangling_references(g.facts, entities(spark)), "fact_key") == [("component:C-01|depends_on|component:C-09",)]
    assert keys(graph.search_entities(entities(spark), " LOCK "), "entity_key") == [("component:C-02",), ("interface:IF-01",), ("interface:IF-02",), ("signal:SG-001",)]
    assert graph.facts_of_id(g.facts, "if-01").count() == 3
    node, out, into = graph.entity_detail(g.facts, g.nodes, "interface:IF-01")
    assert (node.count(), out.count(), into.count()) == (1, 1, 2)
    doc = graph.node_link(g.facts, g.nodes).first().document
    assert '"edge_count":4' in doc and '"node_count":6' in doc
    assert keys(graph.component_sizes(graph.weak_components(g.facts, store)), "component", "size") == [("component:C-01", 5)]
    with pytest.raises(ValueError):
        g.filter(node="no:1")


def test_registry(spark):
    aliases = spark.createDataFrame([("component:door", "component:C-01")], "alias string, entity_key string")
    f = facts(spark, [("component:door", "provides", "interface:IF-01", 0.9), ("component:C-01", "provides", "interface:IF-01", 0.95), ("component:C-01", "provides", "signal:SG-001", 0.9), ("component:C-01", "provides", "interface:IF-77", 0.9), ("component:C-02", "requires", "interface:IF-01", 0.1)])
    out = registry.validate(entities(spark).withColumn("confidence", F.lit(1.0)), f, aliases, 0.5)
    assert keys(out["facts"], "fact_key", "n_candidates", "confidence") == [("component:C-01|provides|interface:IF-01", 2, 0.95)]
    assert sorted(r.issue for r in out["issues"].collect()) == ["domain_range", "low_confidence", "unresolved_reference"]


def test_scores_of_nothing_are_zero(spark):
    none = facts(spark, []).select("predicate", "fact_key")
    assert keys(registry.scores(none, facts(spark), "fact_key", "predicate"), "predicate", "precision", "recall", "f1") == [("carries", 0.0, 0.0, 0.0), ("provides", 0.0, 0.0, 0.0), ("requires", 0.0, 0.0, 0.0)]
