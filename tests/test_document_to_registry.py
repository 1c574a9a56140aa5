"""The known architecture from the text of its documents: chunks, candidates, registry, findings."""

import json

import pytest
from pyspark.sql import functions as F

from tests.fixtures import architecture as arch
from tracewell.operators import chunking, extract, findings
from tracewell.sources.shared import store

DOCUMENT = "document_name string, version string, sha256 string, pages array<struct<page_no:int,lines:array<string>>>, tables array<struct<page_no:int,table_index:int,headers:array<string>,rows:array<array<string>>>>"


def frame(spark, *documents):
    return spark.createDataFrame([(d["document_name"], d["version"], d["sha256"], [(p["page_no"], p["lines"]) for p in d["pages"]], [(t["page_no"], t["table_index"], t["headers"], t["rows"]) for t in d["tables"]]) for d in documents], DOCUMENT)


@pytest.fixture(scope="module")
def chunks(spark):
    return store(chunking.chunk(frame(spark, arch.document(arch.first(), arch.V1), arch.document(arch.second(), arch.V2))))


@pytest.fixture(scope="module")
def registry(chunks):
    out = extract.run(chunks, write=store)
    return {k: store(v) for k, v in out.items()}


def test_registry_is_the_architecture(registry):
    for version, model in ((arch.V1, arch.first()), (arch.V2, arch.second())):
        here = {k: v.where(F.col("version") == version) for k, v in registry.items()}
        want = {(s, p, o) for s, p, o in arch.triples(model)}
        assert {(r.subject, r.predicate, r.object) for r in here["facts"].collect()} == want
        assert {r.entity_key for r in here["entities"].collect()} == {k for k, _, _ in arch.entities(model)}
        names = {k: n for k, _, n in arch.entities(model) if n}
        assert {r.entity_key: r.attributes["name"] for r in here["entities"].collect() if r.entity_type in ("component", "interface", "signal", "functional_flow")} == names
    assert registry["issues"].count() == 0
    assert registry["facts"].where("provenance.document_name is null or provenance.page_start is null").count() == 0
    found = findings.run(registry["facts"], registry["entities"].withColumn("name", F.coalesce(F.col("attributes")["name"], F.lit(""))), "version", by=("version",)).collect()
    assert [(f.version, f.entity_keys) for f in found] == [(arch.V2, ["component:C-05"])]


def test_chunks(spark, chunks):
    rows = chunks.where(F.col("version") == arch.V1).orderBy("chunk_seq").collect()
    assert [r.chunk_seq for r in rows] == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows)
    assert not any(r.text.startswith("Page ") for r in rows)
    catalogue = next(r for r in rows if r.text.startswith("Table columns: ID | Component"))
    assert (catalogue.section_no, catalogue.chunk_type, catalogue.page_start) == ("2", "table", 3)
    title = next(r for r in rows if r.section_no == "3.4")
    assert title.section_title == "Component C-04: LightControlSWC" and title.page_start == title.page_end == 7
    again = chunking.chunk(frame(spark, arch.document(arch.first(), arch.V1)).repartition(3))
    assert sorted(r.chunk_id for r in again.collect()) == sorted(r.chunk_id for r in rows)
    s = chunking.summary(chunks).where(F.col("version") == arch.V1).first()
    assert (s.n_chunks, s.n_prose + s.n_tables) == (len(rows), len(rows))
    pages = {r.section_no: r.page_no for r in chunking.section_pages(frame(spark, arch.document(arch.first(), arch.V1))).collect()}
    assert pages["1"] == 2 and pages["3.1"] == 4 and pages["4.1"] == 24


def one(lines_by_page, tables=(), **kw):
    pages = [{"page_no": i, "lines": lines} for i, lines in enumerate(lines_by_page, 1)]
    return chunking.chunk_document("doc_v2.1", None, "a" * 64, pages, list(tables), **kw)


def test_chunk_rules():
    got = one([["Front line here", "1 First", "Body of the first.", "IF-01", "C-01 (Name)", "uint8", "12 ms"], ["goes on here.", "1.1 Deep", "Deep text."]])
    assert [(r[2], r[4], r[6], r[7], r[10]) for r in got] == [("2.1", "", 1, 1, "Front line here"), ("2.1", "1", 1, 2, "1 First Body of the first. goes on here."), ("2.1", "1.1", 2, 2, "1.1 Deep Deep text.")]
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    parts = one([["1 Long", long]], target=50, overlap=10)
    assert len(parts) > 4 and all(r[11] <= 110 for r in parts) and all(any(f"number {i} " in r[10] for r in parts) for i in range(40))
    blocks = [(f"block {i} " + "x" * 30, i, i) for i in range(9)]
    filled = list(chunking.fill(blocks, 30, 12))
    assert filled[0][1:] == (0, 2) and filled[1][0].startswith("block 2 ")
    table = {"page_no": 2, "table_index": 0, "headers": ["Anchor", "B"], "rows": [["x", "y"]]}
    lines = [["1 A", "text."], ["2 B", "text.", "Anchor", "3 C"]]
    assert [r[4] for r in one(lines, [table]) if r[9] == "table"] == ["2"]
    assert [r[4] for r in one(lines, [table | {"headers": ["Gone"], "rows": [["no"]]}]) if r[9] == "table"] == ["3"]
    assert len([r for r in one(lines, [table, table | {"table_index": 1}]) if r[9] == "table"]) == 1
    assert one([]) == [] and one([["", "  ", "7"]]) == []


def test_bad_documents(spark):
    df = spark.createDataFrame([("d", None, None, None, None), (None, "1", "s", [(1, ["a line", None])], [(1, 0, None, None), (1, 1, ["h"], [["c"], None])])], DOCUMENT)
    assert {(r.document_name, r.version, r.chunk_type) for r in chunking.chunk(df).collect()} == {("", "1", "prose"), ("", "1", "table")}


def test_prose_patterns():
    e, f, a, s = extract.prose_candidates("Component C-01: Door (SWC, Application layer) x. DoorIF (IF-07) It is a S-R interface. Provider: C-01 (Door). Consumers: C-02 (Lock), c-03 (Key). 2  Next Provider: C-09 (No).", [])
    assert ("component", "Door", {"id": "C-01", "name": "Door", "type": "SWC", "layer": "Application"}, 0.9) in e
    assert [(x[0], x[1], x[2]) for x in f] == [("component:C-01", "provides", "interface:IF-07"), ("component:C-02", "requires", "interface:IF-07"), ("component:C-03", "requires", "interface:IF-07")]
    assert ("interface", "DoorIF", "IF-07") in a and len(s) == 3
    pairs = lambda text: [(x[0], x[2]) for x in extract.prose_candidates(text, ["Door", "Door Lock", "Key"])[1]]
    assert pairs("The Door Lock requires the Key.") == [("component:door lock", "component:key")]
    assert pairs("The Door never requires the Key.") == [] and pairs("Door requires Door.") == [] and pairs("requires Key") == []


def test_replies_of_a_generator(spark, chunks):
    one_chunk = chunks.where(F.col("version") == arch.V1)
    reply = {"entities": [{"type": "Component", "name": "C-77", "attributes": {"id": "C-77"}, "evidence_id": "E1"}, {"type": "alien", "name": "x", "evidence_id": "E1"}, 3, {"type": "signal", "name": " ", "evidence_id": "E1"}, {"type": "signal", "name": "s", "evidence_id": "E9999"}, {"type": "signal", "name": "s"}], "facts": [{"subject": "component:c-77", "predicate": "requires", "object": "interface:if-01", "evidence_id": "E2", "confidence": 0.4}, {"subject": "a", "predicate": "likes", "object": "b"}, {"subject": "a", "predicate": "requires", "object": "b", "confidence": "high", "evidence_id": "E1"}]}
    generate = lambda asked: asked.select("question_id", F.lit("Here:\n```json\n" + json.dumps(reply) + "\n```").alias("response"))
    out = extract.run(one_chunk, generate=generate, write=store)
    issues = sorted(r.issue for r in out["issues"].collect())
    assert issues == sorted(["invalid_entity_type", "construction_error", "construction_error", "unknown_evidence_id", "missing_evidence", "invalid_predicate", "construction_error"])
    assert out["entities"].count() == 166 and out["facts"].count() == 201
    floor = extract.run(one_chunk, floor=0.5, generate=generate, write=store)
    assert floor["facts"].count() == 200 and floor["issues"].where("issue = 'below_min_confidence'").count() == 1
    broken = extract.run(one_chunk, generate=lambda asked: asked.select("question_id", F.lit("no json").alias("response")), write=store)
    assert broken["facts"].count() == 200 and [r.issue for r in broken["issues"].collect()] == ["parse_error"]


def test_validation_refuses(spark):
    facts = [("component:a", "requires", "interface:b", 0.9), ("interface:b", "requires", "component:a", 0.9), ("component:a", "requires", "component:a", 0.9), ("component:a", "requires", "interface:zz", 0.9), ("component:A", "requires", "interface:b", 0.95), ("component:a", "adores", "interface:b", 0.9)]
    found = {
        "entities": spark.createDataFrame([("1", "x", 1, "component", "a", {}, 0.9), ("1", "y", 2, "component", "A", {"id": ""}, 0.95), ("1", "x", 3, "interface", "b", {}, 0.9), ("1", "x", 4, "interface", "zz", {}, 0.1)], extract.ENTITY),
        "facts": spark.createDataFrame([("1", "x", i, s, p, o, "", c) for i, (s, p, o, c) in enumerate(facts)], extract.FACT),
        "aliases": spark.createDataFrame([], "version string, alias string, entity_key string"),
    }
    out = extract.validate(found, floor=0.5)
    assert sorted((r.entity_key, r.confidence) for r in out["entities"].collect()) == [("component:a", 0.95), ("interface:b", 0.9)]
    assert sorted(r.issue for r in out["issues"].collect()) == ["below_min_confidence", "domain_violation", "domain_violation", "range_violation", "unresolvable_reference"]
    assert sorted(r.fact_key for r in out["facts"].collect()) == ["component:A|requires|interface:b|", "component:a|requires|interface:b|"]
