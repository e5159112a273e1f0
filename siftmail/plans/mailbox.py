"""The whole analysis over a mailbox made of ``documents`` and ``envelopes``, with SQL that states the results anew."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import defang, entities, exploded, is_ip, is_private_ip, org_domain, url_parts
from ..operators import report
from ..operators.analyze import analyze
from ..operators.store import reports_of, update_reports
from ..sources.scratch import new_folder
from .envelopes import ENVELOPES, sha256
from .urls import spread, table


def mailbox(texts: DataFrame) -> DataFrame:
    """message_id, filename, size_bytes, raw: the text of each row (doc_id, text) in the envelope that its id picks. The
    envelopes are a table of fixed size."""
    rows = [(i, e.head + e.before, e.enc, e.after) for i, e in enumerate(ENVELOPES)]
    envelopes = F.broadcast(texts.sparkSession.createDataFrame(rows, "k long, before string, enc string, after string"))
    text = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    coded = (
        F.when(F.col("enc") == "none", "").when(F.col("enc") == "plain", text).when(F.col("enc") == "u16", F.base64(F.encode(text, "UTF-16LE")))
        .when(F.col("enc") == "html", F.base64(F.encode(F.concat(F.lit("<html><body><p>"), safe, F.lit("</p></body></html>")), "UTF-8"))).otherwise(F.base64(F.encode(text, "UTF-8")))
    )
    raw = F.encode(F.concat("before", coded, "after"), "UTF-8")
    both = texts.select("doc_id", "text", F.pmod("doc_id", F.lit(len(ENVELOPES))).cast("long").alias("k")).join(envelopes, "k")
    return both.select(F.col("doc_id").cast("string").alias("message_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".eml")).alias("filename"), F.octet_length(raw).cast("long").alias("size_bytes"), raw.alias("raw"))


#: The table of reports of each session and input: what one query has analysed, the next one reads.
_tables: dict[tuple[str, str, str], str] = {}


def _kept(spark, sf_dir, name: str, texts: DataFrame) -> DataFrame:
    """Reports of the mailbox of ``texts``, from a table that is brought up to date first."""
    messages = mailbox(texts)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = new_folder(spark, "reports")
    update_reports(messages, _tables[key])
    return reports_of(messages, _tables[key])


def _reports(spark, sf_dir) -> DataFrame:
    return _kept(spark, sf_dir, "documents", spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _turns(spark, sf_dir) -> DataFrame:
    """Reports of the turns of conversations."""
    return _kept(spark, sf_dir, "conversations", spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")))


def _ids(findings: str | Column = "findings") -> Column:
    return F.array_join(F.transform(findings, lambda f: f["id"]), " ")


def fixture_reports(spark, sf_dir):
    """Every turn of a conversation in an envelope: counts, and the rules in order."""
    return _turns(spark, sf_dir).select("message_id", "score", "verdict", "origin_ip", F.size("hops").alias("hops"), F.size("links").alias("links"), F.size("attachments").alias("attachments"), _ids().alias("rules"))


def auth_goldens(spark, sf_dir):
    return report.auth_chips(_turns(spark, sf_dir))


def scalar_goldens(spark, sf_dir):
    """Scalar functions over texts made of customers: addresses of both kinds, hosts, URLs, entities."""
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    own = (
        F.when(k % 6 == 0, text(k % 256, ".", k * 7 % 256, ".", k * 13 % 256, ".", k % 200)).when(k % 6 == 1, text("mail.", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), ".co.uk"))
        .when(k % 6 == 2, text("https://u", k, ":p@h", k, ".example.org:", k % 65536, "/p?q#f")).when(k % 6 == 3, text("x &amp;lt; &#", k % 26 + 65, "; &nbsp;|"))
        .when(k % 6 == 4, text(k % 10, ":2:3:4")).otherwise(text("FE80::", F.lower(F.hex(k % 65536))))
    )
    s = table(spark, sf_dir, "customer").select("c_custkey", own.alias("s"))
    p = url_parts(F.col("s"))
    return s.select(
        "c_custkey", "s", is_ip(F.col("s")).alias("ip"), is_private_ip(F.col("s")).alias("private"), org_domain(F.col("s")).alias("org"), defang(F.col("s")).alias("defanged"),
        entities(F.col("s")).alias("decoded"), p["host"].alias("host"), p["port"].alias("port"), p["userinfo"].alias("userinfo"),
    )


def mailbox_reports(spark, sf_dir):
    """The whole analysis over a mailbox made of every document."""
    return report.summary(_reports(spark, sf_dir)).drop("parse_error")


#: A table of one's own: other weights, a rule that is told without weighing, and a new rule with its condition.
OWN_RULES = [
    ("spf-fail", "auth", 40, "high", None, None), ("rcv-one", None, 0, "info", None, None), ("subj-urgency", None, 10, None, "contains(lower(subject), 'urgent')", "the subject is urgent"),
    ("own-long", "propias", 7, "low", "length(visible) > 1000 AND size(hops) = 2", "a long text over two hops"), ("combo-own", "combinacion", 9, "high", None, None),
]
OWN_CAPS = [("auth", 50), ("propias", 5)]
OWN_COMBINATIONS = [("combo-own", ["own-long"], ["spf-fail", "body-bec", "url-ip"], "long and suspicious")]


def mailbox_own_rules(spark, sf_dir):
    """The analysis by a changed book: score, verdict and rules of each message."""
    book = R.CATALOGUE.changed(
        spark.createDataFrame(OWN_RULES, "id string, cat string, points int, sev string, condition string, text string"), spark.createDataFrame(OWN_CAPS, "cat string, cap int"),
        spark.createDataFrame(OWN_COMBINATIONS, "id string, any_of array<string>, and_any_of array<string>, text string"),
    )
    reports = analyze(mailbox(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), book=book)
    own = F.array_sort(F.transform("findings", lambda f: f["id"]))
    return reports.select("message_id", "score", "verdict", F.array_join(own, " ").alias("rules"))


def mailbox_findings(spark, sf_dir):
    """All findings in order of emission, with the texts that stand for them left out."""
    rows = exploded(_reports(spark, sf_dir), "findings", "f", "message_id")
    return rows.select("message_id", "position", "f.id", "f.cat", "f.points", "f.sev")


def mailbox_verdicts(spark, sf_dir):
    return mailbox_reports(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def mailbox_iocs(spark, sf_dir):
    return report.ioc_rows(_reports(spark, sf_dir)).select("kind", "value", "defanged").distinct()


def mailbox_links(spark, sf_dir):
    rows = exploded(_reports(spark, sf_dir), "links", "u", "message_id")
    return rows.select("message_id", "u.ord", "u.url", "u.host", "u.kind", F.array_join(F.transform("u.flags", lambda f: f["id"]), " ").alias("flags"))


def mailbox_attachments(spark, sf_dir):
    rows = exploded(_reports(spark, sf_dir), "attachments", "a", "message_id")
    return rows.select("message_id", "a.filename", "a.size", "a.size_human", "a.sha256", "a.ext", "a.magic", F.array_join(F.transform("a.flags", lambda f: f["id"]), " ").alias("flags"))


def mailbox_hops(spark, sf_dir):
    rows = exploded(_reports(spark, sf_dir), "hops", "h", "message_id")
    return rows.select("message_id", "h.hop", "h.from_host", "h.by_host", "h.with_proto", "h.id", "h.for_addr", "h.date", F.array_join("h.ips", " ").alias("ips"), "h.delay_seconds")


def mailbox_auth(spark, sf_dir):
    return report.auth_chips(_reports(spark, sf_dir))


def mailbox_bodies(spark, sf_dir):
    """What is visible of each message, as a digest."""
    return _reports(spark, sf_dir).select("message_id", F.length("visible").alias("n_chars"), F.md5(F.col("visible").cast("binary")).alias("visible_md5"))


def mailbox_shares(spark, sf_dir):
    return report.cap_shares(_reports(spark, sf_dir)).drop("name")


def mailbox_gravest(spark, sf_dir):
    """The gravest findings of each message (a top-k report), and all of them by severity."""
    return _reports(spark, sf_dir).select("message_id", _ids(report.gravest_of()).alias("gravest"), _ids(report.by_severity()).alias("by_severity"))


def mailbox_destinations(spark, sf_dir):
    return report.destinations(_reports(spark, sf_dir))


def mailbox_domains(spark, sf_dir):
    return report.external_domains(_reports(spark, sf_dir)).select("message_id", F.array_join("domains", " ").alias("domains"))


def mailbox_json(spark, sf_dir):
    return report.report_json(_reports(spark, sf_dir))


def mailbox_reasons(spark, sf_dir):
    return report.reasons(_reports(spark, sf_dir)).select("message_id", "verdict", F.array_join("reasons", "; ").alias("reasons"))


QUERIES = {
    f.__name__: f
    for f in (fixture_reports, auth_goldens, scalar_goldens, mailbox_reports, mailbox_own_rules, mailbox_findings, mailbox_verdicts, mailbox_iocs, mailbox_links, mailbox_attachments, mailbox_hops, mailbox_auth, mailbox_bodies,
              mailbox_shares, mailbox_gravest, mailbox_destinations, mailbox_domains, mailbox_json, mailbox_reasons)
}

# The SQL. What follows is stated once more by hand, apart from ``rules``: weights, caps, combinations and word lists.
#: Fixed values, stated once more: id, category, cap of the category, points, severity.
WEIGHTS = [
    ("spf-fail", "auth", 30, 25, "high"), ("spf-softfail", "auth", 30, 12, "medium"), ("spf-none", "auth", 30, 8, "medium"), ("spf-neutral", "auth", 30, 8, "medium"),
    ("dkim-fail", "auth", 30, 20, "high"), ("dkim-none", "auth", 30, 8, "medium"), ("dkim-absent", "auth", 30, 8, "medium"), ("dmarc-fail", "auth", 30, 30, "high"),
    ("dmarc-none", "auth", 30, 10, "medium"), ("dmarc-absent", "auth", 30, 10, "medium"), ("compauth", "auth", 30, 10, "medium"),
    ("align-none", "auth", 30, 20, "high"), ("align-dkim", "auth", 30, 10, "medium"), ("no-transport", "auth", 30, 0, "info"),
    ("rp-mismatch", "identidad", 20, 15, "high"), ("replyto-mismatch", "identidad", 20, 18, "high"), ("replyto-freemail", "identidad", 20, 15, "high"),
    ("from-freemail-cargo", "identidad", 20, 15, "high"), ("dn-email", "identidad", 20, 22, "high"), ("dn-brand", "identidad", 20, 18, "high"),
    ("dn-homoglyph", "identidad", 20, 12, "medium"), ("from-punycode", "identidad", 20, 20, "high"), ("from-tld", "identidad", 20, 10, "medium"),
    ("from-multi", "identidad", 20, 10, "medium"), ("from-missing", "identidad", 20, 10, "medium"), ("mid-missing", "identidad", 20, 10, "medium"),
    ("mid-mismatch", "identidad", 20, 6, "low"),
    ("url-mismatch", "enlaces", 20, 20, "high"), ("url-ip", "enlaces", 20, 20, "high"), ("url-punycode", "enlaces", 20, 20, "high"),
    ("url-userinfo", "enlaces", 20, 20, "high"), ("url-data", "enlaces", 20, 25, "high"), ("url-brand", "enlaces", 20, 18, "high"),
    ("url-shortener", "enlaces", 20, 10, "medium"), ("url-creds", "enlaces", 20, 10, "medium"), ("url-tld", "enlaces", 20, 8, "medium"),
    ("url-port", "enlaces", 20, 8, "medium"), ("url-http", "enlaces", 20, 6, "medium"), ("url-subdomains", "enlaces", 20, 4, "low"),
    ("url-filehost", "enlaces", 20, 4, "low"), ("url-redirector", "enlaces", 20, 0, "info"),
    ("att-exec", "adjuntos", 15, 25, "high"), ("att-double", "adjuntos", 15, 22, "high"), ("att-rtlo", "adjuntos", 15, 22, "high"),
    ("att-macro", "adjuntos", 15, 20, "high"), ("att-html", "adjuntos", 15, 20, "high"), ("att-mismatch", "adjuntos", 15, 20, "high"),
    ("att-ole", "adjuntos", 15, 10, "medium"), ("att-container", "adjuntos", 15, 8, "medium"), ("att-empty", "adjuntos", 15, 0, "info"),
    ("body-password", "contenido", 10, 25, "high"), ("body-form", "contenido", 10, 20, "high"), ("body-script", "contenido", 10, 18, "high"),
    ("body-refresh", "contenido", 10, 18, "high"), ("body-bec", "contenido", 10, 15, "high"), ("body-iban", "contenido", 10, 12, "high"),
    ("body-nocontacto", "contenido", 10, 10, "medium"), ("body-iframe", "contenido", 10, 12, "medium"), ("body-image", "contenido", 10, 12, "medium"),
    ("body-hidden", "contenido", 10, 10, "medium"), ("body-crypto", "contenido", 10, 10, "medium"), ("body-empty", "contenido", 10, 8, "medium"),
    ("body-entities", "contenido", 10, 6, "low"), ("subj-urgency", "contenido", 10, 8, "medium"), ("subj-nothread", "contenido", 10, 8, "medium"),
    ("xmailer", "transporte", 5, 10, "medium"), ("rcv-none", "transporte", 5, 10, "medium"), ("rcv-one", "transporte", 5, 3, "low"),
    ("rcv-delay", "transporte", 5, 4, "low"), ("date-skew", "transporte", 5, 5, "low"), ("x-orig-ip", "transporte", 5, 0, "info"),
    ("combo-bec", "combinacion", 20, 20, "high"), ("combo-credenciales", "combinacion", 20, 15, "high"), ("combo-malware", "combinacion", 20, 15, "high"),
    ("combo-extorsion", "combinacion", 20, 15, "high"),
]


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_q, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


_SQUEEZE = r"trim(regexp_replace({}, '[ \t\n\r\f\v\x{{A0}}\x{{FEFF}}]+', ' ', 'g'))"
_E = _values([(i, e.name, e.enc, e.ids, e.tail, e.seen, e.risky, e.subject, e.sender, (e.ips or (None,))[0], len(e.delays), len(e.links), sum(x[2] == "enlace" for x in e.links), len(e.files), *e.chips) for i, e in enumerate(ENVELOPES)])
#: What combinations a list of ids completes.
_COMBOS = """  || CASE WHEN list_has_any(fired, ['from-freemail-cargo', 'replyto-freemail', 'dn-brand', 'dn-email']) AND list_has_any(fired, ['body-bec', 'body-iban']) THEN ['combo-bec'] ELSE [] END
  || CASE WHEN list_has_any(fired, ['body-password', 'body-form', 'url-creds']) AND list_has_any(fired, ['url-mismatch', 'url-brand', 'url-punycode', 'url-ip']) THEN ['combo-credenciales'] ELSE [] END
  || CASE WHEN list_has_any(fired, ['att-exec', 'att-macro', 'att-html']) AND list_has_any(fired, ['body-empty', 'subj-urgency', 'subj-nothread', 'dmarc-fail']) THEN ['combo-malware'] ELSE [] END
  || CASE WHEN list_contains(fired, 'body-crypto') AND list_has_any(fired, ['from-tld', 'spf-none', 'spf-neutral', 'dmarc-absent', 'dmarc-none']) THEN ['combo-extorsion'] ELSE [] END"""
_MAIL = rf"""e(k, name, enc, ids, tail, seen, risky, subject, sender, origin_ip, n_hops, n_urls, n_enlace, n_attachments, spf, dkim, dmarc, spf_alignment, dkim_alignment) AS (VALUES {_E}),
weights(id, cat, cap, points, sev) AS (VALUES {_values(WEIGHTS)}),
d AS (@texts@),
v AS (SELECT d.message_id, e.*, {_SQUEEZE.format("CASE enc WHEN 'none' THEN '' ELSE coalesce(text, '') || ' ' END || seen")} AS visible FROM d JOIN e USING (k)),
w AS (SELECT *, lower(visible || ' ' || subject) AS words FROM v),
c AS (SELECT *, regexp_matches(words, 'bitcoin|btc|usdt|ethereum|monero|wallet|seed phrase|frase semilla|criptomoneda') AS crypto,
  regexp_matches(words, 'transferencia|wire transfer|iban|swift|cambio de cuenta|bank details|datos bancarios|nomina|payroll|pago urgente|urgent payment') AS payment,
  regexp_matches(visible, '\b[A-Z]{{2}}[0-9]{{2}}[ ]?(?:[A-Za-z0-9]{{4}}[ ]?){{3,7}}[A-Za-z0-9]{{1,4}}\b') AS account,
  regexp_matches(lower(visible), 'no me llames|no llames|no puedo hablar|estoy en una reunion|estoy en una reunión|no digas nada|es confidencial') AS silence FROM w),
f AS (SELECT *, ids || CASE WHEN crypto THEN ['body-crypto'] ELSE [] END || CASE WHEN payment AND risky THEN ['body-bec'] ELSE [] END || CASE WHEN payment AND account THEN ['body-iban'] ELSE [] END
  || CASE WHEN silence THEN ['body-nocontacto'] ELSE [] END || tail AS fired FROM c),
g AS (SELECT *, fired
{_COMBOS} AS rules FROM f),
findings AS (SELECT message_id, position, u.id, cat, cap, points, sev FROM (SELECT message_id, unnest(rules) AS id, generate_subscripts(rules, 1) - 1 AS position FROM g) u JOIN weights USING (id)),
shares AS (SELECT message_id, cat, least(sum(points), any_value(cap)) AS points, any_value(cap) AS cap FROM findings GROUP BY message_id, cat),
scores AS (SELECT message_id, least(100, sum(points))::INTEGER AS score FROM shares GROUP BY message_id),
r AS (SELECT g.*, coalesce(score, 0)::INTEGER AS score, CASE WHEN score >= 80 THEN 'CRITICO' WHEN score >= 50 THEN 'ALTO' WHEN score >= 20 THEN 'MEDIO' ELSE 'BAJO' END AS verdict FROM g LEFT JOIN scores USING (message_id))"""
_DOCS = _MAIL.replace("@texts@", f"SELECT doc_id::VARCHAR AS message_id, doc_id % {len(ENVELOPES)} AS k, text FROM documents")
_TURNS = _MAIL.replace("@texts@", f"SELECT (conv_id * 1000 + turn)::VARCHAR AS message_id, (conv_id * 1000 + turn) % {len(ENVELOPES)} AS k, text FROM conversations")
_LINKS = "links(k, ord, url, host, kind, flags) AS (VALUES " + _values([(i, n, u, h, kind, " ".join(flags)) for i, e in enumerate(ENVELOPES) for n, (u, h, kind, flags) in enumerate(e.links)]) + ")"
_FILES = "files(k, filename, size, sha256, ext, magic, flags) AS (VALUES " + _values([(i, n, len(c), sha256(c), ext, magic, " ".join(flags)) for i, e in enumerate(ENVELOPES) for n, c, ext, magic, flags in e.files]) + ")"
_MAILS = "mails(k, email) AS (VALUES " + _values([(i, m) for i, e in enumerate(ENVELOPES) for m in e.emails]) + ")"
_IPS = "ips(k, ip) AS (VALUES " + _values([(i, m) for i, e in enumerate(ENVELOPES) for m in e.ips]) + ")"
_HOPS = "hops(k, hop, delay_seconds, n, first_ips, began) AS (VALUES " + _values([
    (i, n, x, len(e.delays), e.first_ips, re.search(r"id A1; ([^\r]*)", e.head)[1] if len(e.delays) > 1 else "") for i, e in enumerate(ENVELOPES) for n, x in enumerate(e.delays, 1)
]) + ")"
_SHOWN = "s(k, shown) AS (VALUES " + _values([(i, "see www.example.net/a, or ftp://example.net/b" if e.name == "link in plain text" else e.seen) for i, e in enumerate(ENVELOPES)]) + ")"
_IS_IP = r"regexp_matches(host, '^[0-9.]+$')"
_ORG = "CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END"
_ORG_OF = "CASE WHEN sender IS NULL THEN '' ELSE array_to_string(string_split(split_part(sender, '@', 2), '.')[-2:], '.') END"
_DEFANG = "replace(replace(regexp_replace(regexp_replace(value, '(?i)https://', 'hxxps://', 'g'), '(?i)http://', 'hxxp://', 'g'), '.', '[.]'), '@', '[@]')"
_RANK = "CASE sev WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"

SQL = {
    "fixture_reports": f"WITH {_TURNS} SELECT message_id, score, verdict, origin_ip, n_hops::INTEGER AS hops, n_urls::INTEGER AS links, n_attachments::INTEGER AS attachments, array_to_string(rules, ' ') AS rules FROM r",
    "auth_goldens": f"WITH {_TURNS} SELECT message_id, spf, dkim, dmarc, spf_alignment, dkim_alignment FROM r",
    "scalar_goldens": """WITH c AS (SELECT c_custkey, c_custkey AS k, c_custkey % 6 AS kind, [c_custkey % 256, c_custkey * 7 % 256, c_custkey * 13 % 256, c_custkey % 200] AS o, lower(replace(c_name, '#', '-')) AS name FROM customer),
t AS (SELECT *, CASE kind WHEN 0 THEN array_to_string(o, '.') WHEN 1 THEN 'mail.' || name || '.co.uk' WHEN 2 THEN 'https://u' || k || ':p@h' || k || '.example.org:' || k % 65536 || '/p?q#f'
  WHEN 3 THEN 'x &amp;lt; &#' || (k % 26 + 65) || '; &nbsp;|' WHEN 4 THEN k % 10 || ':2:3:4' ELSE 'FE80::' || printf('%x', k % 65536) END AS s FROM c)
SELECT c_custkey, s, kind IN (0, 4, 5) AS ip, CASE kind WHEN 0 THEN o[1] IN (0, 10, 127) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254) ELSE kind = 5 END AS private,
CASE kind WHEN 1 THEN name || '.co.uk' WHEN 2 THEN 'example.org:' || k % 65536 || '/p?q#f' ELSE lower(s) END AS org,
CASE kind WHEN 2 THEN 'hxxps://u' || k || ':p[@]h' || k || '[.]example[.]org:' || k % 65536 || '/p?q#f' ELSE replace(s, '.', '[.]') END AS defanged,
CASE kind WHEN 3 THEN 'x < ' || chr((k % 26 + 65)::INTEGER) || '  |' ELSE s END AS decoded,
CASE kind WHEN 2 THEN 'h' || k || '.example.org' ELSE '' END AS host, CASE kind WHEN 2 THEN (k % 65536)::VARCHAR ELSE '' END AS port, CASE kind WHEN 2 THEN 'u' || k || ':p' ELSE '' END AS userinfo FROM t""",
    "mailbox_reports": f"""WITH {_DOCS} SELECT message_id, message_id || '.eml' AS filename, verdict, score, sender AS "from", subject, origin_ip, n_hops::INTEGER AS n_hops, n_urls::INTEGER AS n_urls, n_enlace::INTEGER AS n_enlace,
(n_urls - n_enlace)::INTEGER AS n_recurso, n_attachments::INTEGER AS n_attachments, len(rules)::INTEGER AS n_findings FROM r""",
    "mailbox_own_rules": f"""WITH {_DOCS}, {_SHOWN}, x AS (SELECT message_id, {_SQUEEZE.format("CASE enc WHEN 'none' THEN '' ELSE coalesce(text, '') || ' ' END || shown")} AS t FROM d JOIN e USING (k) JOIN s USING (k)),
own AS (SELECT message_id, length(t) > 1000 AND n_hops = 2 AS long, list_filter(fired, lambda i: i <> 'subj-urgency') || CASE WHEN regexp_matches(lower(subject), 'urgent') THEN ['subj-urgency'] ELSE [] END
  || CASE WHEN length(t) > 1000 AND n_hops = 2 THEN ['own-long'] ELSE [] END AS fired FROM f JOIN x USING (message_id)),
told AS (SELECT message_id, fired
{_COMBOS} || CASE WHEN long AND list_has_any(fired, ['spf-fail', 'body-bec', 'url-ip']) THEN ['combo-own'] ELSE [] END AS rules FROM own),
changed AS (SELECT id, cat, CASE cat WHEN 'auth' THEN 50 ELSE cap END AS cap, CASE id WHEN 'spf-fail' THEN 40 WHEN 'rcv-one' THEN 0 WHEN 'subj-urgency' THEN 10 ELSE points END AS points FROM weights
  UNION ALL VALUES ('own-long', 'propias', 5, 7), ('combo-own', 'combinacion', 20, 9)),
sums AS (SELECT message_id, least(sum(points), any_value(cap)) AS points FROM (SELECT message_id, unnest(rules) AS id FROM told) JOIN changed USING (id) GROUP BY message_id, cat),
totals AS (SELECT message_id, least(100, sum(points))::INTEGER AS score FROM sums GROUP BY message_id)
SELECT message_id, coalesce(score, 0)::INTEGER AS score, CASE WHEN score >= 80 THEN 'CRITICO' WHEN score >= 50 THEN 'ALTO' WHEN score >= 20 THEN 'MEDIO' ELSE 'BAJO' END AS verdict,
  array_to_string(list_sort(rules), ' ') AS rules FROM told LEFT JOIN totals USING (message_id)""",
    "mailbox_findings": f"WITH {_DOCS} SELECT message_id, position::INTEGER AS position, id, cat, points::INTEGER AS points, sev FROM findings",
    "mailbox_verdicts": f"WITH {_DOCS} SELECT verdict, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM r GROUP BY verdict",
    "mailbox_iocs": f"""WITH {_DOCS}, {_LINKS}, {_FILES}, {_MAILS}, {_IPS}, here AS (SELECT DISTINCT k FROM d),
i AS (SELECT 'domain' AS kind, host AS value FROM links JOIN here USING (k) WHERE NOT {_IS_IP} UNION SELECT 'ip', host FROM links JOIN here USING (k) WHERE {_IS_IP} UNION SELECT 'ip', ip FROM ips JOIN here USING (k)
  UNION SELECT 'url', url FROM links JOIN here USING (k) UNION SELECT 'hash', sha256 FROM files JOIN here USING (k) UNION SELECT 'email', email FROM mails JOIN here USING (k))
SELECT kind, value, CASE kind WHEN 'hash' THEN value ELSE {_DEFANG} END AS defanged FROM i""",
    "mailbox_links": f"WITH {_DOCS}, {_LINKS} SELECT message_id, ord::INTEGER AS ord, url, host, kind, flags FROM d JOIN links USING (k)",
    "mailbox_attachments": f"WITH {_DOCS}, {_FILES} SELECT message_id, filename, size::BIGINT AS size, size || ' B' AS size_human, sha256, ext, magic, flags FROM d JOIN files USING (k)",
    "mailbox_hops": f"""WITH {_DOCS}, {_HOPS} SELECT message_id, hop::INTEGER AS hop, CASE WHEN hop = n THEN 'mx.example.com' ELSE 'host.example.com' END AS from_host,
CASE WHEN hop = n THEN 'mx.corp.example' ELSE 'mx.example.com' END AS by_host, CASE WHEN hop = n THEN 'ESMTPS' ELSE 'ESMTP' END AS with_proto, CASE WHEN hop = n THEN 'B2' ELSE 'A1' END AS id,
CASE WHEN hop = n THEN 'box@corp.example' END AS for_addr, CASE WHEN hop = n THEN 'Mon, 10 Aug 2026 09:00:10 +0200' ELSE began END AS date, CASE WHEN hop = n THEN '203.0.113.9' ELSE first_ips END AS ips, delay_seconds::BIGINT AS delay_seconds FROM d JOIN hops USING (k)""",
    "mailbox_auth": f"WITH {_DOCS} SELECT message_id, spf, dkim, dmarc, spf_alignment, dkim_alignment FROM r",
    "mailbox_shares": f"""WITH {_DOCS}, cats AS (SELECT DISTINCT cat, cap FROM weights)
SELECT message_id, cat, (100 * coalesce(points, 0) // cats.cap)::INTEGER AS percent FROM (SELECT message_id, cat, cap FROM d, cats) cats LEFT JOIN shares USING (message_id, cat) WHERE cat <> 'combinacion' OR points > 0""",
    "mailbox_gravest": f"""WITH {_DOCS}, o AS (SELECT message_id, list(id ORDER BY {_RANK}, position) AS by_severity, list(id ORDER BY position) FILTER (sev = 'high') AS high FROM findings GROUP BY message_id)
SELECT message_id, coalesce(array_to_string(high[:6], ' '), '') AS gravest, coalesce(array_to_string(by_severity, ' '), '') AS by_severity FROM d LEFT JOIN o USING (message_id)""",
    "mailbox_destinations": f"""WITH {_DOCS}, {_LINKS}, p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || host || split_part(regexp_extract(url, '://[^/?#]*(.*)$', 1), '?', 1) AS destination FROM links),
q AS (SELECT k, kind, destination, count(*) AS times, min(ord) AS ord, arg_min(url, ord) AS url, arg_min(CASE flags WHEN '' THEN 0 ELSE len(string_split(flags, ' ')) END, ord)::INTEGER AS n_flags FROM p GROUP BY k, kind, destination)
SELECT message_id, kind, row_number() OVER (PARTITION BY message_id, kind ORDER BY n_flags DESC, ord)::INTEGER AS position, destination, times, url, n_flags FROM d JOIN q USING (k)""",
    "mailbox_domains": f"""WITH {_DOCS}, {_LINKS}, o AS (SELECT k, ord, {_ORG} AS org FROM links WHERE kind = 'enlace'), s AS (SELECT k, {_ORG_OF} AS own FROM e),
t AS (SELECT k, org, min(ord) AS ord FROM o JOIN s USING (k) WHERE org <> own GROUP BY k, org), l AS (SELECT k, array_to_string(list(org ORDER BY ord)[:6], ' ') AS domains FROM t GROUP BY k)
SELECT message_id, coalesce(domains, '') AS domains FROM d LEFT JOIN l USING (k)""",
    "mailbox_reasons": f"""WITH {_DOCS}, told(id, reason) AS (VALUES {_values(report.REASONS.items())}),
t AS (SELECT message_id, reason, min(position) AS position FROM findings JOIN told USING (id) GROUP BY message_id, reason), l AS (SELECT message_id, array_to_string(list(reason ORDER BY position)[:5], '; ') AS reasons FROM t GROUP BY message_id)
SELECT message_id, verdict, coalesce(reasons, '') AS reasons FROM r LEFT JOIN l USING (message_id)""",
    "mailbox_bodies": f"""WITH {_DOCS}, {_SHOWN},
x AS (SELECT message_id, {_SQUEEZE.format("CASE enc WHEN 'none' THEN '' ELSE coalesce(text, '') || ' ' END || shown")} AS t FROM d JOIN e USING (k) JOIN s USING (k)) SELECT message_id, length(t)::INTEGER AS n_chars, md5(t) AS visible_md5 FROM x""",
}
