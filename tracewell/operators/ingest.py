"""Lines to pages, headings, sections, paragraphs, tables and budgeted chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no (from 0), line: blank lines dropped, the order kept."""
    out = docs.select(doc, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return out.withColumn("line", F.rtrim("line")).where(F.trim("line") != "")


def clean(df: DataFrame, banners: tuple[str, ...] = ()) -> DataFrame:
    return df.where(~(T.is_page_number(F.col("line")) | T.is_banner(F.col("line"), banners)))


def headings(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first line of each section number of a document: doc, section_no, title, line_no, level."""
    found = df.withColumn("h", T.heading(F.col("line"))).where("h is not null").select(doc, F.col("h.no").alias("section_no"), F.col("h.title").alias("title"), "line_no")
    first = Window.partitionBy(doc, "section_no").orderBy("line_no")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("level", T.heading_level(F.col("section_no")))


def with_sections(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every line with the section of the last heading at or above it ('' before the first)."""
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    no = T.heading(F.col("line"))["no"]
    return df.withColumn("section_no", F.coalesce(F.last(no, ignorenulls=True).over(order), F.lit("")))


def paragraphs(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, para, text: a short line that ends a sentence ends its paragraph."""
    line = F.col("line")
    ends = (F.length(line) < 80) & F.rtrim(line).rlike("[.:!?]$") & ~line.rlike("(?:e\\.g\\.|i\\.e\\.|etc\\.)$")
    order = Window.partitionBy(doc).orderBy("line_no")
    marked = df.withColumn("__e", ends.cast("int"))
    numbered = marked.withColumn("para", F.coalesce(F.sum("__e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return numbered.groupBy(doc, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))


def not_cells(df: DataFrame, cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines that are no cell of a table of their document (cells: doc, cell)."""
    return df.join(cells.select(doc, F.col("cell").alias("line")).distinct(), [doc, "line"], "left_anti")


def table_sections(anchors: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """As-of join: each table anchor (doc, table_no, line_no) with the last heading at or above it (doc, section_no, line_no)."""
    both = anchors.select(doc, "line_no", "table_no", F.lit(None).cast("string").alias("section_no")).unionByName(sections.select(doc, "line_no", F.lit(None).cast("long").alias("table_no"), "section_no"))
    order = Window.partitionBy(doc).orderBy("line_no", F.col("table_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_no", F.last("section_no", ignorenulls=True).over(order)).where("table_no is not null").select(doc, "table_no", F.coalesce("section_no", F.lit("")).alias("section_no"))


def deepest_sections(points: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Range join with a maximum: the numerically largest section that starts at or above each point."""
    met = points.join(sections.select(doc, F.col("line_no").alias("start"), "section_no"), doc).where("start <= line_no")
    return met.groupBy(doc, "line_no").agg(F.max_by("section_no", T.section_key(F.col("section_no"))).alias("section_no"))


def pack(blocks: DataFrame, target: int = 500, overlap: int = 75, doc: str = "doc_id") -> DataFrame:
    """Blocks (doc, section_no, para, text) packed in order into chunks of about `target` tokens that repeat a tail of about
    `overlap` tokens: doc, section_no, chunk_seq, text, token_count.  A block over one and a half targets is cut at
    sentences first.  The fill is a scan that no aggregate expresses; a group is one section."""
    import re

    size = lambda s: max(1, len(s) // 4)
    kind = dict(blocks.dtypes)[doc]

    def fill(parts: list[str]) -> Iterator[str]:
        held: list[str] = []
        for part in parts:
            if held and sum(map(size, held)) + size(part) > target:
                yield " ".join(held)
                keep = 1
                while keep < len(held) and sum(map(size, held[-keep - 1 :])) <= overlap:
                    keep += 1
                held = held[-keep:]
            held.append(part)
        if held:
            yield " ".join(held)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: list[str] = []
        for t in pdf.sort_values("para")["text"]:
            parts += [s for s in re.split(r"(?<=[.!?])\s+", t) if s] if size(t) > 1.5 * target else [t]
        made = list(fill(parts))
        return pd.DataFrame({doc: pdf[doc].iloc[0], "section_no": pdf["section_no"].iloc[0], "chunk_seq": range(len(made)), "text": made, "token_count": [size(t) for t in made]})

    return blocks.select(doc, "section_no", "para", "text").groupBy(doc, "section_no").applyInPandas(run, f"{doc} {kind}, section_no string, chunk_seq long, text string, token_count long")


def identify(chunks: DataFrame, sha: str, version: str, section: str, seq: str, text: str) -> DataFrame:
    return chunks.withColumn("chunk_id", T.chunk_id(F.col(sha), F.col(version), F.col(section), F.col(seq), F.col(text)))


def document_stats(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    return df.groupBy(doc).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.sum(F.size(F.split(F.trim("line"), "\\s+"))).alias("n_words"), F.count_if(T.is_page_number(F.col("line"))).alias("n_dropped"))


def page_lookup(chunks: DataFrame, page: int, by: str = "document_name") -> DataFrame:
    """The chunks whose span covers a page, in order, per document: by, n_chunks, ids."""
    on = chunks.where((F.col("page_start") <= page) & (F.col("page_end") >= page))
    return on.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("ids"))


def classify(docs: DataFrame, structural: dict[str, tuple[dict[str, str], dict[str, str]]], weights: dict[str, tuple[float, float, float, float]], least: dict[str, float], doc: str = "doc_id", text: str = "text", min_signals: int = 2) -> DataFrame:
    """doc, profile, score, n_signals.  structural: profile -> (structural patterns, prose patterns) by label;
    weights: profile -> (cap, divisor, cap, divisor) of the two families; least: the score a profile needs."""
    out = docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    best = None
    for name in sorted(structural):
        one, two = structural[name]
        hits = lambda p: F.size(F.regexp_extract_all(F.col("__t"), F.lit("(?i)" + p), F.lit(0)))
        counts = [sum((hits(p) for p in family.values()), F.lit(0)) for family in (one, two)]
        labels = sum((F.when(hits(p) > 0, 1).otherwise(0) for p in (*one.values(), *two.values())), F.lit(0))
        a, b, c, d = weights[name]
        score = F.round(F.least(F.lit(a), counts[0] / b) + F.least(F.lit(c), counts[1] / d), 2)
        this = F.struct(score.alias("score"), F.lit(name).alias("name"), labels.cast("long").alias("n_signals"), F.lit(least[name]).alias("least"))
        best = this if best is None else F.greatest(best, this)
    out = out.withColumn("b", best)
    return out.select(doc, F.when((F.col("b.score") >= F.col("b.least")) & (F.col("b.n_signals") >= min_signals), F.col("b.name")).otherwise("generic").alias("profile"), F.col("b.score").alias("score"), F.col("b.n_signals").alias("n_signals"))


def new_uploads(uploads: DataFrame, stored: DataFrame, sha: str = "sha256") -> DataFrame:
    """Uploads whose content is neither stored nor that of an earlier upload (by `upload_id`)."""
    first = uploads.groupBy(sha).agg(F.min("upload_id").alias("upload_id"))
    return uploads.join(first, [sha, "upload_id"], "left_semi").join(stored.select(sha).distinct(), sha, "left_anti")


def unique_labels(versions: DataFrame, document: str = "document_name", label: str = "label", order: str = "version_id") -> DataFrame:
    """Repeats of a label within a document get a suffix -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(document, label).orderBy(order))
    return versions.withColumn("unique_label", F.when(n == 1, F.col(label)).otherwise(F.concat_ws("-", F.col(label), n.cast("string"))))
