from pyspark.sql import functions as F

from tracewell.operators import extract, ingest
from tracewell.sources.io import KeyedStore, html_lines
from tracewell.streaming import events


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lines_sections_paragraphs(spark):
    d = docs(spark, "Intro text.\n1. First\nbody of it\nends here.\n\nPage 7\n1.1 Deep\nmore e.g.\nlast", None, "")
    lines = ingest.clean(ingest.lines(d))
    assert len(rows(lines, "line")) == 7
    assert [r[1] for r in rows(ingest.with_sections(lines), "line_no", "section_no")] == ["", "1", "1", "1", "1.1", "1.1", "1.1"]
    assert rows(ingest.headings(lines), "section_no", "level") == [("1", 1), ("1.1", 2)]
    assert [r[1] for r in rows(ingest.paragraphs(lines), "para", "text")] == ["Intro text.", "1. First body of it ends here.", "1.1 Deep more e.g. last"]


def test_packing_fills_to_the_target_and_repeats_a_tail(spark):
    blocks = spark.createDataFrame([(1, "", i, f"block {i} " + "x" * 72) for i in range(10)], "doc_id long, section_no string, para long, text string")
    out = ingest.pack(blocks, target=60, overlap=20).orderBy("chunk_seq").collect()
    assert [r.chunk_seq for r in out] == list(range(len(out))) and all(r.token_count <= 60 for r in out)
    for i in range(10):
        assert any(f"block {i} " in r.text for r in out)
    assert out[1].text.startswith("block 2 ")


def test_as_of_and_range_joins(spark):
    sections = spark.createDataFrame([(1, 0, "1"), (1, 5, "10"), (1, 8, "2")], "doc_id long, line_no int, section_no string")
    anchors = spark.createDataFrame([(1, 7, 70), (1, 9, 90), (2, 1, 10)], "doc_id long, line_no int, table_no long")
    assert rows(ingest.table_sections(anchors, sections), "table_no", "section_no") == [(10, ""), (70, "10"), (90, "2")]
    assert rows(ingest.deepest_sections(anchors.select("doc_id", "line_no"), sections), "line_no", "section_no") == [(7, "10"), (9, "10")]


def test_extraction(spark):
    d = spark.createDataFrame([(1, "The Door requires the Lock. Lock does not requires Door. Door depends on Window.")], "chunk_id long, text string")
    assert rows(extract.name_pairs(d, ["Door", "Lock", "Window"]), "subject", "object") == [("Door", "Lock"), ("Door", "Window")]
    assert extract.longest_spans("State Management Unit", ["State", "State Management"]) == [(0, 16, "State Management")]
    t = spark.sql("select 1 as source, array('Dep. ID','Source','Target','Type') as headers, array(array('DEP-01','c-01','c-02','uses'), array('ragged')) as rows")
    assert rows(extract.dependency_facts(t), "subject", "object") == [("component:C-01", "component:C-02")]


def test_html(spark):
    p = spark.createDataFrame([(1, "<html><script>x</script><h1>Top</h1><p>a <b>b</b></p></html>"), (2, None)], "page_id long, html string")
    assert rows(html_lines(p), "line_no", "line") == [(0, "Top"), (1, "a b")]


def test_keyed_store(spark, tmp_path):
    s = KeyedStore(spark, f"file://{tmp_path}/store", ["id"])
    assert s.read() is None
    s.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    s.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"))
    assert rows(s.read(), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    s.clear("id = 1")
    assert rows(s.read(), "id") == [(2,), (3,)]


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    table = f"{sf}/events.parquet"
    spark.read.parquet(table).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.tumbling(spark.read.parquet(table))
    assert rows(spark.table("tumbling"), "start", "event_type", "n") == rows(batch, "start", "event_type", "n")
    d = events.deduped(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    d.awaitTermination(120)
    assert spark.table("deduped").count() == spark.read.parquet(table).select("event_id").distinct().count()


def test_stream_sink_is_idempotent(spark, sf, tmp_path):
    table = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{sf}/events.parque[t]")
    events.upsert_sink(stream, f"{tmp_path}/out", "event_id", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == spark.read.parquet(table).select("event_id").distinct().count()
    assert F is not None
