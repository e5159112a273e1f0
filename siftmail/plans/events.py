"""Queries over ``events``: scoring of entities by their rules, and hops (events of a user in time order)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import scoring
from ..operators.sequences import with_places
from .urls import sql_verdict, table

#: event type -> rule
RULE_OF = {"view": "spf-fail", "signup": "dn-brand", "error": "url-ip", "click": "att-container", "purchase": "body-iban"}


def fired(spark, sf_dir):
    """(entity, ord, id): each event fires the rule of its type for the entity of four consecutive events."""
    rule = F.create_map(*(F.lit(x) for pair in RULE_OF.items() for x in pair))
    return table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("entity"), F.col("event_id").alias("ord"), F.try_element_at(rule, F.col("event_type")).alias("id")).where("id IS NOT NULL")


def with_combinations(spark, sf_dir):
    return scoring.add_combinations(fired(spark, sf_dir))


def combos(spark, sf_dir):
    return with_combinations(spark, sf_dir).where("id LIKE 'combo-%'").select("entity", "id")


def capped_breakdown(spark, sf_dir):
    return scoring.capped_breakdown(with_combinations(spark, sf_dir), R.rules(spark), R.caps(spark))


def verdict_by_entity(spark, sf_dir):
    return scoring.verdicts(capped_breakdown(spark, sf_dir))


def verdict_histogram(spark, sf_dir):
    return verdict_by_entity(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def cap_share(spark, sf_dir):
    """Percent of its cap that each category of an entity uses, in whole numbers."""
    return capped_breakdown(spark, sf_dir).select("entity", "cat", F.expr("int(100 * points div cap)").alias("percent"))


def ranked_findings(spark, sf_dir):
    """Findings of each entity by severity, stable."""
    rank = F.create_map(*(F.lit(x) for pair in R.SEVERITY_RANK.items() for x in pair))
    rows = fired(spark, sf_dir).join(F.broadcast(R.rules(spark)), "id")
    order = Window.partitionBy("entity").orderBy(F.element_at(rank, F.col("sev")), "ord")
    return rows.select("entity", "id", "sev", "ord", F.row_number().over(order).cast("long").alias("position"))


def top_findings(spark, sf_dir):
    """The first six findings of high severity of each user's events (a top-k report)."""
    rule = F.create_map(*(F.lit(x) for pair in RULE_OF.items() for x in pair))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.try_element_at(rule, F.col("event_type")).alias("id")).join(F.broadcast(R.rules(spark)), "id").where("sev = 'high'")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where("position <= 6").select("user_id", "event_id", "id", "position")


def hop_delays(spark, sf_dir):
    """Whole seconds since the hop before, in time order."""
    rows = with_places(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    return rows.select("user_id", "event_id", F.col("place").alias("hop"), F.timestamp_diff("SECOND", F.col("previous"), F.col("ts")).alias("delay_seconds"))


def first_long_delay(spark, sf_dir):
    """Each user's first hop of over an hour."""
    return hop_delays(spark, sf_dir).where("delay_seconds > 3600").groupBy("user_id").agg(F.min("hop").alias("hop"), F.min_by("delay_seconds", "hop").alias("delay_seconds"))


def origin_pick(spark, sf_dir):
    """The first event with a value of 50 and more, as the first hop with a public address."""
    good = table(spark, sf_dir, "events").where("value >= 50")
    return good.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("origin_event"))


QUERIES = {f.__name__: f for f in (combos, capped_breakdown, verdict_by_entity, verdict_histogram, cap_share, ranked_findings, top_findings, hop_delays, first_long_delay, origin_pick)}

_CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{i}'" for t, i in RULE_OF.items()) + " END"
_RULES = "rules(id, cat, points, sev) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in R.RULES) + ")"
_CAPS = "caps(cat, cap) AS (VALUES " + ", ".join(f"('{c}', {n})" for c, n in [*R.CAPS.items(), ("combinacion", R.COMBO_CAP)]) + ")"


def _has(ids) -> str:
    return "bool_or(id IN (" + ", ".join(f"'{x}'" for x in ids) + "))"


_FIRED = f"fired AS (SELECT event_id // 4 AS entity, event_id AS ord, {_CASE} AS id FROM events WHERE {_CASE} IS NOT NULL)"
_COMBOS = "combos AS (" + " UNION ALL ".join(f"SELECT entity, '{c}' AS id FROM fired GROUP BY entity HAVING {_has(a)} AND {_has(b)}" for c, (a, b) in R.COMBO_OF.items()) + ")"
_BREAKDOWN = f"""{_RULES}, {_CAPS}, {_FIRED}, {_COMBOS}, both_ AS (SELECT entity, id FROM fired UNION ALL SELECT entity, id FROM combos),
sums AS (SELECT entity, cat, sum(points)::INTEGER AS raw, count(*)::INTEGER AS n_rules FROM both_ JOIN rules USING (id) GROUP BY entity, cat),
breakdown AS (SELECT entity, cat, raw, cap::INTEGER AS cap, least(raw, cap)::INTEGER AS points, n_rules FROM sums JOIN caps USING (cat)),
verdicts AS (SELECT entity, score, {sql_verdict('score')} AS verdict FROM (SELECT entity, least(100, sum(points))::INTEGER AS score FROM breakdown GROUP BY entity))"""
_HOPS = """hops AS (SELECT user_id, event_id, row_number() OVER w AS hop, date_sub('second', lag(ts) OVER w, ts) AS delay_seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_RANK = "CASE sev " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in R.SEVERITY_RANK.items()) + " END"

SQL = {
    "combos": f"WITH {_FIRED}, {_COMBOS} SELECT entity, id FROM combos",
    "capped_breakdown": f"WITH {_BREAKDOWN} SELECT * FROM breakdown",
    "verdict_by_entity": f"WITH {_BREAKDOWN} SELECT * FROM verdicts",
    "verdict_histogram": f"WITH {_BREAKDOWN} SELECT verdict, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM verdicts GROUP BY verdict",
    "cap_share": f"WITH {_BREAKDOWN} SELECT entity, cat, (100 * points // cap)::INTEGER AS percent FROM breakdown",
    "ranked_findings": f"WITH {_RULES}, {_FIRED} SELECT entity, id, sev, ord, row_number() OVER (PARTITION BY entity ORDER BY {_RANK}, ord) AS position FROM fired JOIN rules USING (id)",
    "top_findings": f"""WITH {_RULES}, r AS (SELECT user_id, event_id, id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position
FROM (SELECT user_id, event_id, {_CASE} AS id FROM events) JOIN rules USING (id) WHERE sev = 'high') SELECT * FROM r WHERE position <= 6""",
    "hop_delays": f"WITH {_HOPS} SELECT * FROM hops",
    "first_long_delay": f"WITH {_HOPS} SELECT user_id, min(hop) AS hop, arg_min(delay_seconds, hop) AS delay_seconds FROM hops WHERE delay_seconds > 3600 GROUP BY user_id",
    "origin_pick": "SELECT user_id, event_id AS origin_event FROM events WHERE value >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
}
