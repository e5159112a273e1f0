"""Queries over ``pages``: URL parsing, flags, scores. URLs are perturbed alike in Spark and in the checking SQL, so that
every rule fires on some pages and stays silent on others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import HEX, OCTET, B, E, defang, org_domain, squeezed, url_parts, url_rules_of_columns, with_url_columns
from ..operators import analyze as A
from ..operators.markup import page_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files have fewer splits than there are cores; a larger input stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: page_id modulo 13 -> pattern and replacement (0: none)
CHANGES = {
    1: ("^(https?://)[^/]+", "$1185.199.110.153"), 2: ("^(https?://[^/]+)", "$1:8080"), 3: ("^(https?://)", "$1user@"), 4: (r"^(https?://[^/]+)\.[a-z]+(/|$)", "$1.xyz$2"),
    5: ("$", "/login"), 6: ("^(https?://)", "$1paypal."), 7: ("^(https?://)[^/]+", "$1bit.ly"), 8: ("^(https?://)", "$1xn--"), 9: ("^(https?://)", "$1click."),
    10: ("^(https?://)", "$1a.b.c.d."), 11: ("^(https?://)[^/]+", "$1docs.google.com"), 12: ("^(https?://)[^/]+", "$1login.foo.co.uk"),
}


def hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, original, url."""
    url = F.col("url")
    for k, (a, b) in CHANGES.items():
        if k in (1, 7, 11, 12):  # another host
            changed = F.concat(F.regexp_extract("url", "^(https?://)", 1), F.lit(b[2:]), F.regexp_replace("url", "^https?://[^/]+", ""))
        else:
            changed = F.concat("url", F.lit("/login")) if k == 5 else F.regexp_replace("url", a, b)
        url = F.when(F.col("page_id") % 13 == k, changed).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("original"), url.alias("url"))


def _sql_change(k: int, a: str, b: str) -> str:
    if k in (1, 7, 11, 12):
        return f"WHEN {k} THEN regexp_extract(url, '^(https?://)', 1) || '{b[2:]}' || regexp_replace(url, '^https?://[^/]+', '')"
    if k == 5:
        return "WHEN 5 THEN url || '/login'"
    return f"WHEN {k} THEN regexp_replace(url, '{a}', '{b.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}')"


HOSTILE = "hostile AS (SELECT page_id, url AS original, CASE page_id % 13 " + " ".join(_sql_change(k, *v) for k, v in CHANGES.items()) + " ELSE url END AS url FROM pages)"
IS_IP = rf"^(?:{OCTET}(?:\.{OCTET}){{3}}|(?:{HEX}:){{3,7}}{HEX}|(?:{HEX}:){{1,6}}:{HEX})$"
WHOLE = "(?is)^([a-z][a-z0-9+.-]*)://([^/?#]*)(.*)$"
PARSED = rf"""trimmed AS (SELECT page_id, original, regexp_replace(trim(url), '[)>\]}}.,;:''"]+$', '') AS url FROM hostile),
cut AS (SELECT *, lower(regexp_extract(url, '{WHOLE}', 1)) AS scheme, regexp_extract(url, '{WHOLE}', 2) AS authority, regexp_extract(url, '{WHOLE}', 3) AS path FROM trimmed),
placed AS (SELECT *, regexp_extract(authority, '^(.*)@', 1) AS userinfo, regexp_replace(authority, '^.*@', '') AS place FROM cut),
parsed AS (SELECT page_id, original, url, scheme, lower(regexp_extract(place, '^(\[[^\]]+\]|[^:]+)(?::([0-9]+))?$', 1)) AS host,
                  regexp_extract(place, '^(\[[^\]]+\]|[^:]+)(?::([0-9]+))?$', 2) AS port, userinfo, path FROM placed)"""


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def sql_org(host: str) -> str:
    parts = f"string_split({host}, '.')"
    last = lambda n: f"array_to_string({parts}[-{n}:], '.')"
    return f"(CASE WHEN regexp_matches({host}, '{IS_IP}') OR len({parts}) <= 2 THEN {host} WHEN {last(2)} IN ({quoted(R.SUFFIXES)}) THEN {last(3)} ELSE {last(2)} END)"


def sql_points(rule: str) -> str:
    return "(CASE " + rule + " " + " ".join(f"WHEN '{r}' THEN {p}" for r, _, p, _ in R.RULES) + " ELSE 0 END)"


def sql_verdict(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {n} THEN '{v}'" for n, v in R.THRESHOLDS) + " END"


CREDS = "regexp_matches(lower(path), '" + "|".join(R.CREDENTIAL_WORDS) + "')"
#: rule -> SQL predicate over parsed (with org)
PREDICATES = {
    "url-ip": f"regexp_matches(host, '{IS_IP}')", "url-punycode": r"regexp_matches(host, '(?i)(^|\.)xn--')", "url-userinfo": "userinfo <> ''",
    "url-shortener": f"org IN ({quoted(R.SHORTENERS)})", "url-redirector": f"regexp_matches(host, '{R.REDIRECTORS}')", "url-port": "port NOT IN ('', '80', '443')",
    "url-tld": f"string_split(host, '.')[-1] IN ({quoted(R.RISKY_TLDS)})", "url-creds": CREDS, "url-http": f"scheme = 'http' AND {CREDS}",
    "url-subdomains": "len(string_split(host, '.')) >= 5",
    "url-brand": f"len(list_filter([{quoted(R.BRANDS)}], lambda b: list_contains(string_split_regex(host, '[._-]'), b) AND NOT starts_with(string_split(org, '.')[1], b))) > 0",
    "url-filehost": f"host IN ({quoted(R.FILE_HOSTS)}) OR org IN ({quoted(R.FILE_HOSTS)})",
}
FLAGS = f"""WITH {HOSTILE}, {PARSED}, named AS (SELECT *, {sql_org('host')} AS org, {sql_org("regexp_extract(original, '^https?://([^/]+)', 1)")} AS own_org FROM parsed),
flags AS (""" + " UNION ALL ".join(f"SELECT page_id, host, org, own_org, '{i}' AS id FROM named WHERE {p}" for i, p in PREDICATES.items()) + ")"


def parsed(spark, sf_dir):
    """page_id, original, url and its parts."""
    return with_url_columns(hostile(spark, sf_dir))


def url_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "url", "scheme", "host", "port", "userinfo", "path")


def url_defang(spark, sf_dir):
    return hostile(spark, sf_dir).select("page_id", defang(F.col("url")).alias("defanged"))


def url_org_domain(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "host", "org")


def url_flags(spark, sf_dir):
    """One row per flag of a page's URL."""
    ids = F.array(*(F.when(c, F.lit(i)) for i, c in url_rules_of_columns()))
    return parsed(spark, sf_dir).select("page_id", "original", "org", F.explode(ids).alias("id")).where("id IS NOT NULL").select("page_id", "id", "original", "org")


def flags_of_pages(spark, sf_dir):
    return url_flags(spark, sf_dir).select("page_id", "id")


def flag_histogram(spark, sf_dir):
    return url_flags(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def own_domain_suppression(spark, sf_dir):
    """Weak flags don't count on the sender's own domain, here the original URL's."""
    own = org_domain(F.regexp_extract("original", "^https?://([^/]+)", 1)) == F.col("org")
    return url_flags(spark, sf_dir).where(~(F.col("id").isin(R.WEAK_ON_OWN_DOMAIN) & own)).select("page_id", "id")


def url_score(spark, sf_dir):
    """Every page's URL flags, weighed and capped, with the verdict: one projection over the scan."""
    rules, points = url_rules_of_columns(), {r: p for r, _, p, _ in R.RULES}
    n = sum((c.cast("long") for _, c in rules), F.lit(0).cast("long"))
    score = F.least(F.lit(R.CAPS["enlaces"]), sum((F.when(c, points[i]).otherwise(0) for i, c in rules), F.lit(0)))
    out = parsed(spark, sf_dir).select("page_id", "host", n.alias("n_flags"), score.cast("int").alias("score"))
    return out.withColumn("verdict", R.verdict(F.col("score")))


def group_destinations(spark, sf_dir):
    """Links of one destination (scheme, host and path before the query) together; the first stands for them."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_parts(F.col("url")).alias("p"))
    key = F.concat("p.scheme", F.lit("://"), "p.host", F.regexp_replace("p.path", r"\?.*$", ""))
    return p.groupBy(key.alias("destination")).agg(F.count(F.lit(1)).alias("times"), F.min_by("url", "page_id").alias("first_url"))


def url_top_hosts(spark, sf_dir):
    """The ten most frequent hosts (a top-k report)."""
    hosts = parsed(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return hosts.orderBy(F.col("n").desc(), "host").limit(10)


def external_domains(spark, sf_dir):
    """Each original host's distinct foreign registrable domains."""
    rows = parsed(spark, sf_dir).select(org_domain(F.regexp_extract("original", "^https?://([^/]+)", 1)).alias("own_org"), "org")
    return rows.where("org <> own_org").distinct()


def html_anchors(spark, sf_dir):
    """Anchors of each page, as the engine's scanner finds them."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", page_links(F.col("html")).alias("found"))
    rows = pages.select("page_id", F.posexplode(F.filter("found", lambda x: x["source"] == "html:a")).alias("i", "a"))
    return rows.select("page_id", (F.col("i") + 1).cast("long").alias("ord"), F.col("a.url").alias("href"), F.coalesce(squeezed(F.col("a.text")), F.lit("")).alias("anchor_text"))


SIGNALS = {
    "has_form": f"(?i)<form{E}", "has_script": f"(?i)<script{E}", "has_iframe": f"(?i)<iframe{E}", "has_password": "(?i)type\\s*=\\s*[\"']?password",
    "has_refresh": "(?i)http-equiv\\s*=\\s*[\"']?refresh",
}


def html_signals(spark, sf_dir):
    html = F.concat("html", *(F.when(F.col("page_id") % k == 0, F.lit(x)).otherwise("") for k, x in EXTRA.items()))
    counts = A.html_counts(html)
    return table(spark, sf_dir, "pages").select("page_id", *((c.cast("long") if n.startswith("n_") else c).alias(n) for n, c in counts.items()))


EXTRA = {
    2: '<form action="/x"><input type="password"></form>', 3: "<iframe src=x></iframe>", 5: '<meta http-equiv="refresh" content="0;url=http://a.b/">',
    7: '<p style="display:none">a</p><p style="font-size: 0">b</p>', 11: "&#65;" * 41,
}
_HTML = "html || " + " || ".join(f"CASE WHEN page_id % {k} = 0 THEN '{x}' ELSE '' END" for k, x in EXTRA.items())


def visible_text(spark, sf_dir):
    text = A.visible_text(F.lit(""), F.concat("html", F.lit("<p>&amp;lt;&#233;&#xe9;&quot;&nbsp;</p>")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def _re2(pattern: str) -> str:
    return pattern.replace(E, r"\b").replace(B, r"\b").replace("(?![a-z0-9_])", r"\b").replace("'", "''")


#: An anchor, for the checking SQL alone: the engine has no such pattern.
ANCHOR = r"(?is)<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*>(.*?)</a>"
_NAMED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _NAMED = f"replace({_NAMED}, '{_a}', '{_b}')"
_SQUEEZED = r"trim(regexp_replace({}, '[ \t\n\r\f\v\x{{A0}}\x{{FEFF}}]+', ' ', 'g'))"

QUERIES = {"url_flags": flags_of_pages} | {f.__name__: f for f in (url_score, url_parse, url_defang, url_org_domain, flag_histogram, own_domain_suppression, group_destinations, url_top_hosts, external_domains, html_anchors, html_signals, visible_text)}

SQL = {
    "url_parse": f"WITH {HOSTILE}, {PARSED} SELECT page_id, url, scheme, host, port, userinfo, path FROM parsed",
    "url_defang": f"WITH {HOSTILE} SELECT page_id, replace(replace(regexp_replace(regexp_replace(url, '(?i)https://', 'hxxps://', 'g'), '(?i)http://', 'hxxp://', 'g'), '.', '[.]'), '@', '[@]') AS defanged FROM hostile",
    "url_org_domain": f"WITH {HOSTILE}, {PARSED} SELECT page_id, host, {sql_org('host')} AS org FROM parsed",
    "url_flags": f"{FLAGS} SELECT page_id, id FROM flags",
    "flag_histogram": f"{FLAGS} SELECT id, count(*) AS n FROM flags GROUP BY id",
    "own_domain_suppression": f"{FLAGS} SELECT page_id, id FROM flags WHERE NOT (org = own_org AND id IN ({quoted(R.WEAK_ON_OWN_DOMAIN)}))",
    "url_score": f"""{FLAGS}, s AS (SELECT page_id, count(*) AS n, least(20, sum({sql_points('id')}))::INTEGER AS score FROM flags GROUP BY page_id)
SELECT page_id, host, coalesce(n, 0)::BIGINT AS n_flags, coalesce(score, 0)::INTEGER AS score, {sql_verdict('coalesce(score, 0)')} AS verdict FROM parsed LEFT JOIN s USING (page_id)""",
    "group_destinations": """WITH k AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
  regexp_replace(regexp_extract(url, '://[^/?#]*(.*)$', 1), '\\?.*$', '') AS destination FROM pages)
SELECT destination, count(*) AS times, arg_min(url, page_id) AS first_url FROM k GROUP BY destination""",
    "url_top_hosts": f"WITH {HOSTILE}, {PARSED} SELECT host, count(*) AS n FROM parsed GROUP BY host ORDER BY n DESC, host LIMIT 10",
    "external_domains": f"{FLAGS} SELECT DISTINCT own_org, org FROM named WHERE org <> own_org",
    "html_anchors": rf"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{_re2(ANCHOR)}', 1) AS h, regexp_extract_all(html, '{_re2(ANCHOR)}', 2) AS t FROM pages),
r AS (SELECT page_id, unnest(range(1, len(h) + 1)) AS ord, h, t FROM a)
SELECT page_id, ord, h[ord] AS href, {_SQUEEZED.format("regexp_replace(t[ord], '<[^>]+>', '', 'g')")} AS anchor_text FROM r""",
    "html_signals": f"WITH p AS (SELECT page_id, {_HTML} AS html FROM pages) SELECT page_id, " + ", ".join(f"regexp_matches(html, '{_re2(p)}') AS {n}" for n, p in SIGNALS.items())
    + f", len(regexp_extract_all(html, '(?i){_re2(R.HIDDEN_STYLE)}'))::BIGINT AS n_hidden, len(regexp_extract_all(html, '(?i)&#x?[0-9a-f]{{2,}};'))::BIGINT AS n_entities, len(regexp_extract_all(html, '(?i)<img\\b'))::BIGINT AS n_images FROM p",
    "visible_text": f"WITH v AS (SELECT page_id, {_SQUEEZED.format(chr(34) + 'stripped' + chr(34))} AS t FROM (SELECT page_id, {_NAMED} || ' <éé\" ' AS stripped FROM pages)) SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM v",
}
