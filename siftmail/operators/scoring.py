"""From rule ids to findings, combinations, capped categories, score and verdict; nested (one row per message, no
shuffle) and exploded (rows of (entity, rule))."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import let


def combinations(ids: Column, book: R.Book = R.CATALOGUE) -> Column:
    """Ids of the combinations that a set of fired ids completes."""
    some = lambda own: F.arrays_overlap(ids, F.array(*map(F.lit, own)))
    return F.filter(F.array(*(F.when(some(a) & some(b), F.lit(c)) for c, a, b, _ in book.combinations)), lambda x: x.isNotNull())


def findings(fired: Column, book: R.Book = R.CATALOGUE) -> Column:
    """Findings of the fired rules (id, msg) in order, then of the combinations they complete."""
    told = F.create_map(*(F.lit(x) for c, _, _, text in book.combinations for x in (c, text)))
    combined = lambda x: F.transform(combinations(F.transform(x, lambda f: f["id"]), book), lambda i: F.struct(i.alias("id"), F.element_at(told, i).alias("msg")))
    return let(fired, lambda x: F.transform(F.concat(x, combined(x)), lambda f: R.finding(f, book)))


def without_texts(ids: Column) -> Column:
    """Rule ids as fired rules with nothing to tell."""
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("msg")))


def breakdown(found: Column, book: R.Book = R.CATALOGUE) -> Column:
    """array<struct(cat, raw, cap, points, n_rules)>: the categories always, combinations if they have points."""

    def of(cat: str, cap: int) -> Column:
        own = F.filter(found, lambda f: f["cat"] == cat)
        raw = F.aggregate(own, F.lit(0), lambda s, f: s + f["points"])
        return F.struct(F.lit(cat).alias("cat"), raw.alias("raw"), F.lit(cap).alias("cap"), F.least(raw, F.lit(cap)).alias("points"), F.size(own).alias("n_rules"))

    rows = [of(c, n) for c, n in sorted(book.caps, key=lambda x: x[0] == "combinacion")]
    return F.filter(F.array(*rows), lambda r: (r["cat"] != "combinacion") | (r["raw"] > 0))


def total(rows: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(rows, F.lit(0), lambda s, r: s + r["points"]))


def with_score(df: DataFrame, ids: str = "rule_ids") -> DataFrame:
    """``df`` with findings, score_breakdown, score and verdict of its array of rule ids."""
    return with_weights(df.withColumn("findings", findings(without_texts(F.col(ids)))))


def weights(book: R.Book = R.CATALOGUE) -> list[dict[str, Column]]:
    """score_breakdown, score and verdict of findings; where these are null, null."""
    there = F.col("findings").isNotNull()
    return [{"score_breakdown": F.when(there, breakdown(F.col("findings"), book))}, {"score": F.when(there, total(F.col("score_breakdown")))}, {"verdict": R.verdict(F.col("score"))}]


def with_weights(df: DataFrame) -> DataFrame:
    for step in weights():
        df = df.withColumns(step)
    return df


def add_combinations(fired: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows (entity, id) with the completed combinations added. The sets of ids are small: there are few rules."""
    sets = fired.groupBy(entity).agg(F.collect_set("id").alias("ids"))
    return fired.select(entity, "id").unionByName(sets.select(entity, F.explode(combinations(F.col("ids"))).alias("id")))


def capped_breakdown(fired: DataFrame, rules: DataFrame, caps: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows (entity, id) to (entity, cat, raw, cap, points, n_rules); rules and caps are catalogues of fixed size."""
    weighed = fired.join(F.broadcast(rules), "id")
    sums = weighed.groupBy(entity, "cat").agg(F.sum("points").cast("int").alias("raw"), F.count(F.lit(1)).cast("int").alias("n_rules"))
    return sums.join(F.broadcast(caps), "cat").select(entity, "cat", "raw", "cap", F.least("raw", "cap").alias("points"), "n_rules")


def verdicts(rows: DataFrame, entity: str = "entity") -> DataFrame:
    score = F.least(F.lit(100), F.sum("points")).cast("int")
    return rows.groupBy(entity).agg(score.alias("score")).withColumn("verdict", R.verdict(F.col("score")))
