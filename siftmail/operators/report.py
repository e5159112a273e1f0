"""Reports as tables, JSON, indicator lists and text trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import defang, exploded, human_size, lookup_url, short_address

#: Headline and subtitle of each verdict.
HEADLINES = {
    "CRITICO": ("Almost surely a fraud", "Touch nothing in this message."), "ALTO": ("Very suspicious: treat it as a fraud", "It has several clear signs of phishing."),
    "MEDIO": ("Suspicious: do not trust it yet", "Some things in it do not fit."), "BAJO": ("No clear signs of fraud", "Look at the usual things all the same."),
}
#: What to do, by verdict.
ADVICE = {
    "CRITICO": ("Open no link and no attachment.", "Do not answer, and call no number that it gives.", "If you gave a password anywhere, change it now on the official site and turn on a second factor.",
                "If it claims to be your bank, company or an authority, call the number you know.", "Report it to security, then delete it."),
    "ALTO": ("Open no link and no attachment.", "Do not answer.", "Check by another channel: type the official address yourself or call the usual number.", "If you expected it, ask the sender another way first."),
    "MEDIO": ("Be wary: open no link or attachment for now.", "Confirm by another channel that the sender wrote.", "If it asks for money, data or a password, take it for a fraud until that is confirmed."),
    "BAJO": ("No clear signs, which is no guarantee.", "If it asks for money, passwords or data, check by another channel.", "When in doubt, type the address yourself."),
}
REASONS = {
    "spf-fail": "the sending server is not allowed to send for this domain", "dkim-fail": "the signature does not verify", "dmarc-fail": "the sender's domain is not proven",
    "align-none": "the message comes from another domain than it shows", "dn-brand": "the name shows a brand that the address does not belong to", "dn-email": "the name shows another address",
    "replyto-mismatch": "answers go to another domain", "replyto-freemail": "answers go to another account", "from-freemail-cargo": "a manager writes from a free account",
    "body-bec": "it asks for a payment or new bank details", "body-iban": "it gives an account to pay to", "body-nocontacto": "it asks you not to call anyone",
    "body-form": "it holds a form", "body-password": "it asks for a password", "url-ip": "a link goes to a bare address", "url-mismatch": "a link shows one site and goes to another",
    "url-punycode": "a link imitates letters", "url-brand": "a link imitates a brand", "att-exec": "an attachment can run", "att-macro": "an attachment holds macros",
    "att-double": "an attachment hides its type", "att-html": "an attachment is a web page", "subj-urgency": "it presses for haste",
    "rp-mismatch": "bounces go to another domain than the sender's", "from-punycode": "the sender's domain imitates letters", "from-tld": "the sender's domain is of a kind that fraud favours",
    "subj-nothread": "it poses as an answer to a conversation that is not there", "body-script": "it holds program code", "body-refresh": "it sends you to another page by itself",
    "body-hidden": "it holds text that cannot be seen", "body-image": "it is nearly all image, which filters cannot read", "body-crypto": "it speaks of cryptocurrency",
    "xmailer": "it was sent by a bulk mailing tool", "url-creds": "a link goes to a page for signing in or verifying an account", "url-filehost": "a link goes to a file sharing service",
    "url-http": "a link to a page that asks for data is not encrypted", "url-shortener": "a shortened link hides where it goes", "url-tld": "a link goes to a domain of a kind that fraud favours",
    "url-userinfo": "a link is made to seem to go elsewhere", "att-mismatch": "an attachment is not of the type it claims", "att-rtlo": "an attachment's name is written backwards in part",
    "combo-bec": "it fits fraud by someone posing as a superior or supplier", "combo-credenciales": "it fits the theft of passwords by a false page",
    "combo-malware": "it fits the sending of malware in an attachment", "combo-extorsion": "it fits extortion for cryptocurrency",
}

# Relay services by registrable domain, and public search pages.
RELAYS = {"privaterelay.appleid.com": "Hide My Email", "duck.com": "DuckDuckGo", "mozmail.com": "Firefox Relay", "simplelogin.co": "SimpleLogin", "anonaddy.me": "AnonAddy"}
CATEGORY_NAMES = {
    "auth": "Authentication", "identidad": "Sender's identity", "enlaces": "Links", "adjuntos": "Attachments", "contenido": "Content of the message", "transporte": "Transport and headers",
    "combinacion": "Combinations that fit a known fraud",
}
LOOKUPS = {"file": "https://www.virustotal.com/gui/file/", "domain": "https://www.virustotal.com/gui/search/", "ip": "https://www.abuseipdb.com/check/"}


def _pairs(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def _own(reports: DataFrame, name: str, kind: str) -> Column:
    """A column of the messages' source, null where the source has none."""
    return F.col(name) if name in reports.columns else F.lit(None).cast(kind).alias(name)


def _addresses_of(role: str) -> Column:
    return F.transform(F.filter("addresses", lambda a: a["role"] == role), lambda a: a["address"])


def _count(kind: str) -> Column:
    return F.size(F.filter("links", lambda u: u["kind"] == kind))


def summary(reports: DataFrame, *more: str) -> DataFrame:
    """The batch table: one line per message, with ``more`` of its columns. One that could not be parsed has its error and no
    verdict."""
    return reports.select(
        *more, "message_id", _own(reports, "filename", "string"), "verdict", "score", F.try_element_at(_addresses_of("from"), F.lit(1)).alias("from"), "subject", "origin_ip",
        F.size("hops").alias("n_hops"), F.size("links").alias("n_urls"), _count("enlace").alias("n_enlace"), _count("recurso").alias("n_recurso"), F.size("attachments").alias("n_attachments"),
        F.size("findings").alias("n_findings"), "parse_error",
    )


ENGINE = "siftmail 1"


def report_json(reports: DataFrame, pretty: bool = False) -> DataFrame:
    """message_id and the report as JSON, nulls kept; without a time of analysis, so that equal messages give equal rows."""
    headers = F.transform(
        "headers", lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value"), h["decoded"].alias("decoded"), F.lower(h["name"]).isin(R.INTERESTING_HEADERS).alias("interesting"))
    )
    bodies = F.struct(F.substring("plain", 1, 200_000).alias("plain"), F.length("html").alias("htmlLength"), F.substring("html", 1, 400_000).alias("htmlSource"))
    names = _pairs(CATEGORY_NAMES)
    scores = F.transform("score_breakdown", lambda b: F.struct(
        b["cat"].alias("cat"), F.element_at(names, b["cat"]).alias("name"), b["raw"].alias("raw"), b["cap"].alias("cap"), b["points"].alias("points"), b["n_rules"].alias("rules")))
    sender = F.try_element_at(F.filter("addresses", lambda a: a["role"] == "from"), F.lit(1))
    head = lambda name: F.trim(F.coalesce(F.try_element_at(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(1)), F.lit("")))
    brief = F.struct(
        sender["address"].alias("from"), sender["name"].alias("fromDisplay"), F.nullif(F.col("from_org"), F.lit("")).alias("fromOrgDomain"), _addresses_of("reply-to").alias("replyTo"),
        F.try_element_at(_addresses_of("return-path"), F.lit(1)).alias("returnPath"), _addresses_of("to").alias("to"), _addresses_of("cc").alias("cc"), F.col("subject"),
        head("date").alias("date"), head("message-id").alias("messageId"), F.col("origin_ip").alias("originIP"), F.size("hops").alias("hops"), _count("enlace").alias("urlCount"),
        _count("recurso").alias("resourceCount"), F.size("attachments").alias("attachmentCount"),
    )
    found = F.struct(
        "iocs.urls", F.transform("iocs.urls", defang).alias("urlsDefanged"), "iocs.domains", F.transform("iocs.domains", defang).alias("domainsDefanged"), "iocs.ips", "iocs.hashes", "iocs.emails"
    )
    body = F.struct(
        F.struct(_own(reports, "filename", "string"), _own(reports, "size_bytes", "long").alias("sizeBytes"), F.lit(ENGINE).alias("engine"), F.col("parse_error").alias("error")).alias("meta"),
        "score", "verdict", scores.alias("scoreBreakdown"), brief.alias("summary"), F.col("auth").withField("alignment", F.col("alignment")).alias("auth"), headers.alias("headers"),
        F.col("hops").alias("received"), F.col("links").alias("urls"), "attachments", "findings", found.alias("iocs"), bodies.alias("bodies"), tree(F.col("parts")).alias("structure"),
    )
    return reports.select("message_id", F.to_json(body, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def _label(p: Column) -> Column:
    return F.concat(
        p["mime"], F.when(p["charset"] != "", F.concat(F.lit("; charset="), p["charset"])).otherwise(""), F.when(p["encoding"] != "7bit", F.concat(F.lit(" ["), p["encoding"], F.lit("]"))).otherwise(""),
        F.when(p["disp_filename"] != "", F.concat(F.lit(" -> "), p["disp_filename"])).otherwise(""),
    )


def tree(parts: Column) -> Column:
    """The MIME tree flat, depth first: array<struct(id, parent, depth, label)>; nesting follows from parent."""
    return F.transform(parts, lambda p: F.struct(p["part_id"].alias("id"), p["parent_id"].alias("parent"), p["depth"].alias("depth"), _label(p).alias("label")))


def structure(parts: Column) -> Column:
    """The MIME tree as indented lines."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.repeat(F.lit("  "), p["depth"]), F.when(p["depth"] > 0, "└ ").otherwise(""), _label(p))), "\n")


def ioc_rows(reports: DataFrame) -> DataFrame:
    """message_id, kind, value, defanged: one row per indicator."""
    kinds = {"domain": "domains", "ip": "ips", "url": "urls", "hash": "hashes", "email": "emails"}

    def named(kind: str) -> Column:
        return F.transform(F.col(f"iocs.{kinds[kind]}"), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    lists = F.concat(*map(named, kinds))
    rows = exploded(reports, lists, "i", "message_id").select("message_id", "i.kind", "i.value")
    return rows.withColumn("defanged", F.when(F.col("kind") == "hash", F.col("value")).otherwise(defang(F.col("value"))))


def ioc_text(reports: DataFrame) -> DataFrame:
    """message_id and the defanged block of domains, addresses, URLs and hashes (no e-mail addresses)."""
    part = lambda title, c: F.array_join(F.concat(F.array(F.lit(f"# {title}")), F.transform(F.col(f"iocs.{c}"), defang if c != "hashes" else lambda v: v)), "\n")
    return reports.select("message_id", F.concat_ws("\n\n", part("dominios", "domains"), part("ips", "ips"), part("urls", "urls"), part("hashes", "hashes")).alias("text"))


def url_list(reports: DataFrame) -> DataFrame:
    """message_id and all defanged addresses of a message, one a line."""
    return reports.select("message_id", F.array_join(F.transform("links", lambda u: u["defanged"]), "\n").alias("text"))


def reasons(reports: DataFrame, most: int = 5) -> DataFrame:
    """The verdict's headline, the first distinct plain reasons of each message (a top-k report), and what to do."""
    told, advice = _pairs(REASONS), F.create_map(*(x for v, lines in ADVICE.items() for x in (F.lit(v), F.array(*map(F.lit, lines)))))
    texts = F.array_distinct(F.filter(F.transform("findings", lambda f: F.try_element_at(told, f["id"])), lambda t: t.isNotNull()))
    line = lambda i: F.try_element_at(_pairs({v: x[i] for v, x in HEADLINES.items()}), F.col("verdict"))
    return reports.select(
        "message_id", "verdict", line(0).alias("headline"), line(1).alias("subtitle"), F.slice(texts, 1, most).alias("reasons"), F.try_element_at(advice, F.col("verdict")).alias("advice")
    )


def destinations(reports: DataFrame) -> DataFrame:
    """Links of each message by kind and destination (scheme, host, path before the query): message_id, kind, position,
    destination, times, url (the first), n_flags. Within a kind, those of most flags come first, else in order of sight."""
    links = exploded(reports, "links", "u", "message_id").select("message_id", "u.*")
    key = F.concat("scheme", F.lit("://"), "host", F.substring_index("path", "?", 1))
    first = F.min_by(F.struct("ord", "url", F.size("flags").alias("n_flags")), "ord")
    grouped = links.groupBy("message_id", "kind", key.alias("destination")).agg(F.count(F.lit(1)).alias("times"), first.alias("f"))
    order = Window.partitionBy("message_id", "kind").orderBy(F.col("f.n_flags").desc(), "f.ord")
    return grouped.select("message_id", "kind", F.row_number().over(order).alias("position"), "destination", "times", "f.url", "f.n_flags")


def gravest_of(most: int = 6) -> Column:
    return F.slice(F.filter("findings", lambda f: f["sev"] == "high"), 1, most)


def gravest(reports: DataFrame, most: int = 6) -> DataFrame:
    """The first findings of high severity of each message (a top-k report)."""
    return reports.select("message_id", gravest_of(most).alias("findings"))


def cap_shares(reports: DataFrame) -> DataFrame:
    """message_id, cat, name, percent: how much of its cap each category uses, in whole numbers."""
    rows = exploded(reports, "score_breakdown", "b", "message_id")
    return rows.select("message_id", "b.cat", F.element_at(_pairs(CATEGORY_NAMES), F.col("b.cat")).alias("name"), F.expr("int(100 * b.points div b.cap)").alias("percent"))


def by_severity() -> Column:
    rank = _pairs(R.SEVERITY_RANK)
    keyed = F.transform("findings", lambda f, i: F.struct(F.element_at(rank, f["sev"]).alias("r"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def findings_by_severity(reports: DataFrame) -> DataFrame:
    """message_id and the findings, the gravest first, stable."""
    return reports.select("message_id", by_severity().alias("findings"))


def sender_lines(reports: DataFrame) -> DataFrame:
    """The sender as shown (a long local part shortened), and whether a relay service hides the real address."""
    sender = F.try_element_at(F.filter("addresses", lambda a: a["role"] == "from"), F.lit(1))["address"]
    relay = _pairs(RELAYS)
    return reports.select("message_id", F.coalesce(short_address(sender), F.lit("?")).alias("sender"), F.try_element_at(relay, F.col("from_org")).alias("relay"))


def checks(reports: DataFrame) -> DataFrame:
    """message_id, what, lookup: public search addresses for attachments, clickable foreign domains and the origin."""
    foreign = _foreign(6)
    of = lambda base, v: F.struct(v.alias("what"), lookup_url(base, v).alias("lookup"))
    rows = F.concat(
        F.transform("attachments", lambda a: of(LOOKUPS["file"], a["sha256"])), F.transform(foreign, lambda d: of(LOOKUPS["domain"], d)),
        F.transform(F.filter(F.array("origin_ip"), lambda x: x.isNotNull()), lambda x: of(LOOKUPS["ip"], x)),
    )
    return exploded(reports, rows, "c", "message_id").select("message_id", "c.*")


def _foreign(most: int) -> Column:
    usable = F.filter("links", lambda u: (u["kind"] == "enlace") & ~u["own"] & (u["org_domain"] != ""))
    return F.slice(F.array_distinct(F.transform(usable, lambda u: u["org_domain"])), 1, most)


def external_domains(reports: DataFrame, most: int = 6) -> DataFrame:
    """The first distinct foreign domains that can be clicked (a top-k report)."""
    return reports.select("message_id", _foreign(most).alias("domains"))


def auth_chips(reports: DataFrame) -> DataFrame:
    """Each result's display class: pass, fail, warn or none."""
    chip = lambda c: F.when(c == "pass", "pass").when(c.isin("fail", "softfail"), "fail").when(c.isNotNull(), "warn").otherwise("")
    label = lambda c: F.when(c, "aligned").when(~c, "not aligned").otherwise("unknown")
    return reports.select("message_id", *(chip(F.col(f"auth.{k}")).alias(k) for k in ("spf", "dkim", "dmarc")), label(F.col("alignment.spf")).alias("spf_alignment"), label(F.col("alignment.dkim")).alias("dkim_alignment"))


def tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of a report frame; write it or persist it first, so that parsing runs once."""
    rows = lambda c, *cols: exploded(reports, c, "_r", "message_id").select("message_id", "_r.*")
    parts = rows("parts").drop("text", "content")
    return {
        "headers": rows("headers"), "mime_parts": parts.withColumn("size_human", human_size(F.col("size"))), "addresses": rows("addresses"), "hops": rows("hops"),
        "links": rows("links"), "attachments": rows("attachments"), "findings": exploded(reports, "findings", "_r", "message_id").select("message_id", F.col("position").alias("ord"), "_r.*"),
        "score_breakdown": rows("score_breakdown"), "iocs": ioc_rows(reports), "reports": summary(reports),
    }
