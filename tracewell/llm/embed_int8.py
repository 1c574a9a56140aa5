"""Embedding near-duplicates by int8 tile products with error bounds (operator 8).

Vectors of equal label and dimension are compared by cosine.  Exact copies fold into one node with a count first, so
a vector that is repeated very often costs one comparison.  The nodes of a label are dealt into blocks of about
BLOCK rows, and every pair of blocks is one task of bounded size (a tile).  In a tile the unit vectors are quantised
to int8 with a scale each.  With u = u' + e (u' the quantised vector, e its error), the product of two unit
vectors differs from that of the quantised ones by at most |e_u| + |u'| |e_v|; only pairs whose product plus this
bound reaches the threshold are computed again in double precision, so no pair is lost and none is wrong.

A tile returns, per node, how many vectors it links to, and one edge to the smallest node it is connected with in the
tile: a group in which all are linked gives as many rows as it has nodes.  Edges of all tiles go to `components`.

Edge cases: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, links
with nothing and is its own component; copies link with each other; rows without an id count as vectors and are
never kept; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

BLOCK = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scale, the length of the error and the length of the quantised vector."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(np.square(unit - back).sum(1)), np.sqrt(np.square(back).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 512):
    """For each slice of rows of a: (first row, matrix of whether cosine(a, b) >= threshold).  a, b: double vectors."""
    ua, ub = (x / np.sqrt(np.square(x).sum(1))[:, None] for x in (a, b))
    (qa, sa, ea, la), (qb, sb, eb, _) = quantise(ua), quantise(ub)
    fb = qb.astype(np.float32).T  # products of int8 values are exact in float32 up to 2^24 / 127^2 = 1040 components
    exact = np.float32 if a.shape[1] <= 1000 else np.float64
    for at in range(0, len(a), rows):
        part = slice(at, at + rows)
        product = (qa[part].astype(exact) @ fb.astype(exact)) * sa[part, None] * sb[None, :]
        bound = ea[part, None] + la[part, None] * eb[None, :] + 1e-9
        i, j = np.nonzero(product + bound >= threshold)
        hit = np.zeros(product.shape, bool)
        for k in range(0, len(i), 100_000):
            ii, jj = i[k : k + 100_000], j[k : k + 100_000]
            hit[ii, jj] = np.einsum("ij,ij->i", ua[at + ii], ub[jj]) >= threshold
        yield at, hit


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        nodes, counts = table.column("node").to_numpy(), table.column("copies").to_numpy()
        flat = np.array(table.column("embedding").combine_chunks().flatten(), np.float64)
        vectors = flat.reshape(len(nodes), -1)
        one = bool(table.column("i")[0].as_py() == table.column("j")[0].as_py())
        ia = np.arange(len(nodes)) if one else np.flatnonzero(side)
        ib = ia if one else np.flatnonzero(~side)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        if len(ia) and len(ib):
            for at, hit in tile_links(vectors[ia], vectors[ib], threshold):
                if one:
                    hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                links[ia[at : at + len(hit)]] += hit @ counts[ib]
                if not one:
                    links[ib] += counts[ia[at : at + len(hit)]] @ hit
                for k in np.flatnonzero(hit.any(1)):
                    met = np.unique(np.append(root[ib[hit[k]]], root[ia[at + k]]))
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(links, pa.int64()), "to": pa.array(nodes[root], pa.int64())})

    return run


def usable(label: Column, embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def near_duplicates(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.coalesce(usable(F.col("label"), F.col("embedding")), F.lit(False)), F.xxhash64("label", "embedding")))
    nodes = materialise(rows.where("node is not null").groupBy("node", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")), "nodes")
    keyed = nodes.withColumn("dim", F.size("embedding"))
    blocks = materialise(keyed.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")), "blocks")
    dealt = keyed.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.select("node", "label", "dim", "embedding", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("node", "label", "dim", "embedding", "copies", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
    tiles = materialise(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold), "node long, links long, to long"), "tiles")
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(tiles.select(F.col("node").alias("a"), F.col("to").alias("b")))
    nodes = nodes.drop("embedding", "label").join(links, "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialise(nodes, "joined")
    firsts = materialise(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    found = materialise(nodes.join(firsts, "component").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "found")
    out = rows.select("vec_id", "node").join(found, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per vector of the whole table."""
    from .common import read

    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), walk(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
