"""The driver's tables seen as chunks, questions, vectors, entities and facts.

Every adapter is a projection or a join over a whole table; a revision is a ship month, chosen by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE, TARGET = "1996-03", "1996-04"
BULK = 25  # a supplier provides a part in a month if it shipped at least so many at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("doc_id") % 50 + 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_name"),
        F.col("lang").alias("version"),
        F.when(F.col("doc_id") % 5 == 0, "table").otherwise("prose").alias("chunk_type"),
        first.alias("page_start"),
        (first + F.col("doc_id") % 3).cast("int").alias("page_end"),
        "text",
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("token_count"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _holds(questions: list[tuple]):
    """Which question texts each chunk holds: one automaton over all of them, one pass over a text."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        same: dict[str, list] = {}
        for ident, text in questions:
            same.setdefault(text, []).append(ident)
        for text, idents in same.items():
            found.add_word(text, idents)
        if same:
            found.make_automaton()
        for b in batches:
            pairs = [(q, c) for c, t in zip(*(b.column(i).to_pylist() for i in (0, 1))) for q in (sorted({q for _, idents in found.iter(t or "") for q in idents}) if same else [])]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.int64()), pa.array([c for _, c in pairs], pa.int64())], names=["question_id", "chunk_id"])

    return run


def gold(spark: SparkSession, sf_dir: str, least: int = 40, block: int = 4096) -> DataFrame:
    """(question_id, chunk_id): the chunks that hold a question's text of at least `least` characters.

    Questions are taken in blocks; a block is one pass over the chunks.
    """
    q = questions(spark, sf_dir).where(F.length("question") >= least)
    c = chunks(spark, sf_dir).select("chunk_id", "text")
    parts = max(-(-q.count() // block), 1)
    out = None
    for k in range(parts):
        rows = [tuple(r) for r in q.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == k).collect()]  # a block, bounded
        part = c.mapInArrow(_holds(rows), "question_id long, chunk_id long")
        out = part if out is None else out.union(part)
    return out


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def _key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_key, entity_type, name: suppliers and customers are components, parts interfaces, brands signals."""
    t = lambda name: table(spark, sf_dir, name)
    kinds = [
        t("supplier").select(_key("component:S-", "s_suppkey").alias("entity_key"), F.lit("component").alias("entity_type"), F.col("s_name").alias("name")),
        t("customer").select(_key("component:C-", "c_custkey"), F.lit("component"), F.col("c_name")),
        t("part").select(_key("interface:P-", "p_partkey"), F.lit("interface"), F.col("p_name")),
        t("part").select(F.concat(F.lit("signal:"), F.col("p_brand")), F.lit("signal"), F.col("p_brand")).distinct(),
        t("nation").select(_key("component:N-", "n_nationkey"), F.lit("component"), F.col("n_name")),
        t("region").select(_key("component:R-", "r_regionkey"), F.lit("component"), F.col("r_name")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out


def _in_month(version: str) -> F.Column:
    year, month = map(int, version.split("-"))
    after = f"{year + month // 12}-{month % 12 + 1:02d}-01"
    return (F.col("l_shipdate") >= F.lit(f"{version}-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(after).cast("timestamp_ntz"))


def facts(spark: SparkSession, sf_dir: str, versions: tuple[str, ...] = ()) -> DataFrame:
    """version, subject, predicate, object, object_value, confidence, fact_key over all line items; a version is a ship month.

    Named versions become ranges of dates, which reach the scan.
    """
    lines = table(spark, sf_dir, "lineitem")
    if versions:
        lines = lines.where(reduce(lambda a, b: a | b, map(_in_month, versions)))
    # numbers and days are exchanged; keys are spelled out after what repeats is gone
    lines = lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", F.trunc("l_shipdate", "month").alias("month"))
    version = F.date_format("month", "yyyy-MM").alias("version")
    provides = lines.where(F.col("l_quantity") >= BULK).select("month", "l_suppkey", "l_partkey").distinct().select(version, _key("component:S-", "l_suppkey").alias("subject"), F.lit("provides").alias("predicate"), _key("interface:P-", "l_partkey").alias("object"), F.lit(0.95).alias("confidence"))
    orders = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey")
    required = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("month", "o_custkey", "l_partkey").distinct()
    requires = required.select(version, _key("component:C-", "o_custkey").alias("subject"), F.lit("requires").alias("predicate"), _key("interface:P-", "l_partkey").alias("object"), F.lit(0.9).alias("confidence"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    carries = lines.select("month", "l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select(version, _key("interface:P-", "p_partkey").alias("subject"), F.lit("carries").alias("predicate"), F.concat(F.lit("signal:"), F.col("p_brand")).alias("object"), F.lit(0.85).alias("confidence"))
    out = provides.union(requires).union(carries).withColumn("object_value", F.lit(""))
    return out.withColumn("fact_key", F.concat_ws("|", "subject", "predicate", "object", "object_value"))


def cluster_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the second vocabulary: a part's brand is a functional cluster; by its size a shipped part belongs to the
    foundation or to the services."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("version")).distinct()
    parts = table(spark, sf_dir, "part").where("p_size <= 6").select("p_partkey", "p_brand", "p_size")
    side = F.when(F.col("p_size") <= 3, "autosar:platform_foundation:adaptive_platform_foundation").otherwise("autosar:platform_service:adaptive_platform_services")
    cluster = F.concat(F.lit("autosar:functional_cluster:"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    out = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("version", cluster.alias("subject"), F.lit("belongs_to").alias("predicate"), side.alias("object"), F.lit("").alias("object_value"), F.lit(0.85).alias("confidence")).distinct()
    return out.withColumn("fact_key", F.concat_ws("|", "subject", "predicate", "object"))


def cluster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters but those of brands that begin with a one, and both partitions."""
    cluster = F.concat(F.lit("autosar:functional_cluster:"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    known = table(spark, sf_dir, "part").where("p_brand not like 'Brand#1%'").select(cluster.alias("entity_key"), F.lit("functional_cluster").alias("entity_type"), F.col("p_brand").alias("name")).distinct()
    parents = [("autosar:platform_foundation:adaptive_platform_foundation", "platform_foundation", "Adaptive Platform Foundation"), ("autosar:platform_service:adaptive_platform_services", "platform_service", "Adaptive Platform Services")]
    return known.union(spark.createDataFrame(parents, known.schema))


# The same adapters in SQL, for the oracles.
CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS document_name, lang AS version, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'prose' END AS chunk_type,
 CAST(doc_id % 50 + 1 AS INTEGER) AS page_start, CAST(doc_id % 50 + 1 + doc_id % 3 AS INTEGER) AS page_end, text, greatest(1, n_chars // 4) AS token_count FROM documents)"""
ENTITIES = """entities AS (SELECT 'component:S-' || s_suppkey AS entity_key, 'component' AS entity_type, s_name AS name FROM supplier
 UNION ALL SELECT 'component:C-' || c_custkey, 'component', c_name FROM customer UNION ALL SELECT 'interface:P-' || p_partkey, 'interface', p_name FROM part
 UNION ALL SELECT DISTINCT 'signal:' || p_brand, 'signal', p_brand FROM part UNION ALL SELECT 'component:N-' || n_nationkey, 'component', n_name FROM nation
 UNION ALL SELECT 'component:R-' || r_regionkey, 'component', r_name FROM region)"""
FACTS = """lines AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m') AS version FROM lineitem),
facts AS MATERIALIZED (SELECT *, '' AS object_value, subject || '|' || predicate || '|' || object || '|' AS fact_key FROM (
 SELECT DISTINCT version, 'component:S-' || l_suppkey AS subject, 'provides' AS predicate, 'interface:P-' || l_partkey AS object, CAST(0.95 AS DOUBLE) AS confidence FROM lines WHERE l_quantity >= 25
 UNION ALL SELECT DISTINCT version, 'component:C-' || o_custkey, 'requires', 'interface:P-' || l_partkey, CAST(0.9 AS DOUBLE) FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT'
 UNION ALL SELECT DISTINCT version, 'interface:P-' || p_partkey, 'carries', 'signal:' || p_brand, CAST(0.85 AS DOUBLE) FROM lines JOIN part ON l_partkey = p_partkey))"""
CLUSTERS = """cf AS (SELECT *, subject || '|' || predicate || '|' || object AS fact_key FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS version, 'autosar:functional_cluster:' || replace(lower(p_brand), '#', '_') AS subject, 'belongs_to' AS predicate,
 CASE WHEN p_size <= 3 THEN 'autosar:platform_foundation:adaptive_platform_foundation' ELSE 'autosar:platform_service:adaptive_platform_services' END AS object FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 6)),
ce AS (SELECT DISTINCT 'autosar:functional_cluster:' || replace(lower(p_brand), '#', '_') AS entity_key FROM part WHERE p_brand NOT LIKE 'Brand#1%' UNION ALL SELECT unnest(['autosar:platform_foundation:adaptive_platform_foundation', 'autosar:platform_service:adaptive_platform_services']))"""
