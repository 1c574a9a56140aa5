"""Candidate validation, canonicalisation, best-confidence dedupe, keyed upserts and scores against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import domain_range_violations, key_type


def canonicalise(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Both ends of every fact replaced by the key their alias stands for, where there is one."""
    a = aliases.select("alias", "entity_key")
    out = facts.join(a.select(F.col("alias").alias("subject"), F.col("entity_key").alias("__s")), "subject", "left").join(a.select(F.col("alias").alias("object"), F.col("entity_key").alias("__o")), "object", "left")
    return out.withColumn("subject", F.coalesce("__s", "subject")).withColumn("object", F.coalesce("__o", "object")).drop("__s", "__o")


def unresolved(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """fact_key, end, key of references that no entity has, not even by the part after the type in any case."""
    each = facts.select("fact_key", F.explode(F.array(F.struct(F.lit("subject").alias("end"), F.col("subject").alias("key")), F.struct(F.lit("object").alias("end"), F.col("object").alias("key")))).alias("x")).select("fact_key", "x.*")
    strict = each.join(entities.select(F.col("entity_key").alias("key")), "key", "left_anti")
    tails = entities.select(F.lower(F.substring_index("entity_key", ":", -1)).alias("tail")).distinct()
    return strict.withColumn("tail", F.lower(F.substring_index("key", ":", -1))).join(tails, "tail", "left_anti").select("fact_key", "end", "key")


def confidence_floor(candidates: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    return candidates.where(F.col("confidence") >= floor), candidates.where(F.col("confidence") < floor).withColumn("issue", F.lit("low_confidence"))


def best(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of highest confidence per key, the first on ties, with the number of rows it stands for."""
    w = Window.partitionBy(*key)
    ranked = candidates.withColumn("__n", F.row_number().over(w.orderBy(F.col("confidence").desc(), *order))).withColumn("n_candidates", F.count(F.lit(1)).over(w))
    return ranked.where("__n = 1").drop("__n")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows of incoming put in place of those of the same key (the last wins)."""
    return stored.join(incoming.select(*key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def validate(entities: DataFrame, facts: DataFrame, aliases: DataFrame, floor: float = 0.0) -> dict[str, DataFrame]:
    """Accepted entities and facts, and the issues: canonical keys, confidence floor, domains, references, best of each key."""
    kept, low = confidence_floor(facts, floor)
    canonical = canonicalise(kept, aliases).withColumn("fact_key", F.concat_ws("|", "subject", "predicate", "object"))
    bad = domain_range_violations(canonical).select("fact_key").distinct()
    loose = unresolved(canonical, entities).select("fact_key").distinct()
    good = canonical.join(bad, "fact_key", "left_anti").join(loose, "fact_key", "left_anti")
    issues = low.select("fact_key", "issue").union(bad.withColumn("issue", F.lit("domain_range"))).union(loose.withColumn("issue", F.lit("unresolved_reference")))
    return {"entities": best(entities, ["entity_key"], [F.col("name")]), "facts": best(good, ["fact_key"], [F.col("subject")]), "issues": issues}


def sole_owner(requires: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relational division: group -> the one component that requires every interface wanted by the group.

    requires: (by, subject, object); wanted: (by, group, object).
    """
    need = wanted.groupBy("group").agg(F.countDistinct("object").alias("need"))
    have = wanted.join(requires, [*by, "object"]).groupBy("group", "subject").agg(F.countDistinct("object").alias("have"))
    owners = have.join(need, "group").where("have = need").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("owner"))
    return owners.where("n = 1").select("group", "owner")


def scores(predicted: DataFrame, gold: DataFrame, key: str, by: str, per: tuple[str, ...] = ()) -> DataFrame:
    """per, by, tp, fp, fn, precision, recall, f1 (0 where undefined, four places)."""
    both = predicted.select(*per, by, key).distinct().withColumn("p", F.lit(1)).join(gold.select(*per, by, key).distinct().withColumn("g", F.lit(1)), [*per, by, key], "full_outer")
    return scores_of(both.withColumn("side", F.when(F.col("g").isNull(), "base").when(F.col("p").isNull(), "target").otherwise("both")), by, per)


def scores_of(sides: DataFrame, by: str, per: tuple[str, ...] = ()) -> DataFrame:
    """`scores` of keys whose side is known: 'base' (predicted only), 'target' (gold only) or 'both'."""
    n = sides.groupBy(*per, by).agg(*[F.count_if(F.col("side") == side).alias(name) for side, name in (("both", "tp"), ("base", "fp"), ("target", "fn"))])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(*per, by, "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(ratio(2 * p * r, p + r), 4).alias("f1"))


def cross_check(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*by, key).distinct().withColumn("a", F.lit(1)), right.select(*by, key).distinct().withColumn("b", F.lit(1))
    return a.join(b, [*by, key], "full_outer").where("a is null or b is null").select(*by, key, F.when(F.col("a").isNull(), "right_only").otherwise("left_only").alias("side"))


def counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    e = entities.groupBy(key_type(F.col("entity_key")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity_type").alias("kind"), "name", "n")
    return e.union(facts.groupBy(F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("predicate").alias("kind"), "name", "n"))
