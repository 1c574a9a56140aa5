"""Line dedup by distinct-site spread (operator 5).  DataFrame functions only.

A line of a text is boilerplate when it occurs on at least `min_sites` distinct sites (values of `source`).  Each line
is trimmed and hashed to 128 bits; a HyperLogLog sketch of the sites per hash is filled from the lines and merged by
(partial) aggregation, with the number of occurrences, so that a line that a third of all rows share meets nowhere.  An
estimate far above the threshold decides by itself; for lines whose estimate is near it (within half and one and a
half times, far beyond the sketch's error) the distinct sites are counted exactly, from the lines again; lines far below
stay.  So the decisions are those of an exact count.

The flagged lines go back to the texts by hash, to the positions at which a text holds them, keyed by the text's content:
copies share one row, and the texts are moved once.  A text is cut where lines go and joined again, in time linear in its
lines.

A text all of whose lines (but blank ones) are flagged is not a page with boilerplate but a copy of other texts, or
boilerplate alone; it is left as it is, for near-duplicate removal to decide on.  All others lose their flagged lines,
whatever their share.

Edge cases: a null text stays null and counts no line; empty and blank lines are never boilerplate; a null source is
no site; texts of any length are cut at every line feed; repeated rows give repeated rows; an empty table gives an
empty table; other columns are carried whatever their names, but a column named like the result (`out`) is replaced by it
(names that begin with two underscores are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MIN_SITES, MIN_CHARS = 5, 1
LG_K = 10


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _lines(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    exploded = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    exploded = exploded.withColumn("line", _trimmed(F.col("line"))).where(F.length("line") >= MIN_CHARS)
    return exploded.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")).drop("line")


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The 128-bit hashes (h1, h2) of lines on at least `min_sites` distinct sites."""
    lines = _lines(df, text, F.col(site).cast("string").alias("site")).where("site is not null")
    sketched = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = materialise(sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= 0.5 * min_sites)), "sketched")
    sure = sketched.where(F.col("sites") > 1.5 * min_sites).select("h1", "h2")
    near = sketched.where(F.col("sites") <= 1.5 * min_sites).select("h1", "h2")
    seen = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))  # a row per line and site
    exact = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return materialise(sure.union(exact), "boilerplate")


def remove_boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, out: str = "n_removed") -> DataFrame:
    """df with boilerplate lines taken out of the text, and `out`, the number of lines taken out."""
    flagged = boilerplate(df, text, site, min_sites)
    key = (F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"))
    hits = _lines(df, text, *key).join(flagged, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    hits = materialise(hits, "hits")
    found = df.withColumn("__t1", key[0]).withColumn("__t2", key[1]).join(hits.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("gone").alias("__gone")), ["__t1", "__t2"], "left")
    # the lines come out of a generator, so that they are split once and not for every slice
    lines = F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n", -1))
    found = found.select("*", F.explode(F.array(lines)).alias("__lines"))
    begin, end = F.concat(F.array(F.lit(-1)), F.col("__gone")), F.concat(F.col("__gone"), F.array(F.size("__lines")))
    between = F.arrays_zip(begin.alias("a"), end.alias("b"))
    kept = F.flatten(F.transform(between, lambda x: F.slice("__lines", x["a"] + 2, x["b"] - x["a"] - 1)))
    found = found.withColumn("__cleaned", F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")))
    taken = F.coalesce(F.col("__cleaned").rlike("[^ \n]"), F.lit(False))
    cleaned = [F.when(taken, F.col("__cleaned")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns if c != out]
    return found.select(*cleaned, F.when(taken, F.size("__gone")).otherwise(0).cast("long").alias(out))


def op5_line_spread(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without boilerplate lines and n_removed of every document."""
    from .common import read

    return remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_removed")


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), bad AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE length(trim(line, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON trim(l.line, ' ') = b.line
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS n_removed,
    count(*) FILTER (WHERE NOT gone AND length(trim(line, ' ')) >= 1) AS own
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN k.own > 0 THEN k.text ELSE d.text END AS text, CASE WHEN k.own > 0 THEN k.n_removed ELSE 0 END AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
