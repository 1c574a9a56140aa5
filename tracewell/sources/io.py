"""Sources and sinks: JSON bundles, keyed stores, graph exports, CSV, uploads, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import upsert


def read_bundles(spark: SparkSession, pattern: str) -> DataFrame:
    """Document bundles, one JSON document a file."""
    return spark.read.option("multiLine", True).json(pattern)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Uploaded files: path, sha256, size, is_pdf."""
    raw = spark.read.format("binaryFile").load(pattern)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def html_lines(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """The text of block elements of raw pages: page, line_no, line."""
    body = F.regexp_replace(F.col(html), "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    cut = F.split(F.regexp_replace(body, "(?i)</?(?:p|li|h[1-6]|div|br|tr|td|th|ul|ol|title|body|html|head)[^>]*>", "\n"), "\n")
    plain = F.transform(cut, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "\\s+", " ")))
    return pages.select(page, F.posexplode(F.filter(plain, lambda x: x != "")).alias("line_no", "line"))


class KeyedStore:
    """A Parquet table with upsert by key.  Every change writes a new generation beside the last, so a reader or a task
    that is run again never sees a half-written table; a pointer row names the current one."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def _generations(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
        done = [n for n in names if n.startswith("g=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame | None:
        found = self._generations()
        return self.spark.read.parquet(f"{self.path}/g={found[-1]}") if found else None

    def _write(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/g={(self._generations() or [0])[-1] + 1}")

    def upsert(self, rows: DataFrame) -> None:
        stored = self.read()
        self._write(rows.dropDuplicates(self.key) if stored is None else upsert(stored, rows.dropDuplicates(self.key), self.key))

    def clear(self, condition: str = "true") -> None:
        stored = self.read()
        if stored is not None:
            self._write(stored.where(f"not coalesce({condition}, false)"))


def append_audit(spark: SparkSession, path: str, action: str, details: str) -> None:
    spark.range(1).select(F.lit(action).alias("action"), F.lit(details).alias("details"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def graphml(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """GraphML elements, a line each: part (0 nodes, 1 edges), line.  An edge's provenance, where it has one, is flattened."""
    from ..functions.text import escape_html as e

    n = nodes.select(*by, F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="name">%s</data></node>', e(F.col("entity_key")), e(F.coalesce("name", F.lit("")))).alias("line"))
    flat = F.concat(F.lit('<data key="provenance">'), e(flat_provenance(F.col("provenance"))), F.lit("</data>")) if "provenance" in edges.columns else F.lit("")
    return n.union(edges.select(*by, F.lit(1), F.format_string('<edge source="%s" target="%s"><data key="predicate">%s</data>%s</edge>', e(F.col("subject")), e(F.col("object")), e(F.col("predicate")), flat)))


PROVENANCE = ("document_name", "version_label", "section_no", "section_title", "page_start", "page_end", "source_chunk_id")


def flat_provenance(provenance: F.Column) -> F.Column:
    """key=value pairs of a provenance struct, joined by semicolons."""
    return F.array_join(F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(provenance[k].cast("string"), F.lit(""))) for k in PROVENANCE]), "; ")
