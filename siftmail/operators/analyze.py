"""Messages to reports: authentication, hops, links, attachments, rules, score, indicators. Catalyst expressions on one
row per message, so nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import (
    B, E, IPV4, IPV6_IN_TEXT, URL, among, built_once, defang, entities, ext_of, first_brand, flag, has_any, human_size, is_ip, is_private_ip, let, magic_of, org_domain, squeezed, strip_tags, url_flags, url_parts,
)
from .parse import with_parsed
from .scoring import findings, weights


def header_all(name: str) -> Column:
    return F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == name), lambda h: h["value"])


def header(name: str) -> Column:
    return F.try_element_at(header_all(name), F.lit(1))


def told(name: str) -> Column:
    """The header's value, null where it is absent or empty."""
    return F.nullif(header(name), F.lit(""))


def first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, null where the pattern isn't found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def addresses(role: str) -> Column:
    return F.filter("addresses", lambda a: a["role"] == role)


def with_auth(df: DataFrame) -> DataFrame:
    for step in _auth_steps():
        df = df.withColumns(step)
    return df.drop("_lines", "_signatures", "_spf")


@built_once
def _auth_steps() -> list[dict[str, Column]]:
    """auth: results by key, the first line that has one; domains; signatures; alignment with the sender's domain."""
    lines = F.concat(header_all("authentication-results"), header_all("arc-authentication-results"))
    grab = lambda k: first(F.transform("_lines", lambda x: extract(F.lower(x), rf"{B}{k}\s*=\s*([a-z]+)")))
    # the first line whose domain is not empty once what stands before @ is gone
    domain = lambda k, own: first(F.transform("_lines", lambda x: own(extract(F.lower(x), rf"{k}\s*=\s*([^\s;,()]+)"))))
    fallback = header_all("received-spf")
    spf_line = F.try_element_at(F.filter(F.transform(fallback, lambda x: F.lower(extract(F.trim(x), "^([A-Za-z]+)"))), lambda x: x.isNotNull()), F.lit(-1))
    behind_at = lambda x: F.regexp_replace(x, "^.*@", "")
    spf_domain = first(F.transform(fallback, lambda x: F.regexp_replace(behind_at(extract(x, r"(?i)(?:envelope-from|smtp\.mailfrom)\s*=\s*([^\s;,()]+)")), "[<>]", "")))
    tag = lambda s, k: F.regexp_replace(F.trim(extract(s, rf"(?:^|;)\s*{k}\s*=\s*([^;]+)")), r"\s+", "")
    signatures = F.transform(
        header_all("dkim-signature"),
        lambda s: F.struct(*(tag(s, k).alias(k) for k in "dsac"), F.length(F.coalesce(tag(s, "b"), F.lit(""))).alias("b_len")),
    )
    real = lambda x: F.when((x != "") & ~F.lower(x).isin("none", "unknown", "-"), x)
    auth = F.struct(
        F.coalesce("_spf", spf_line).alias("spf"), grab("dkim").alias("dkim"), grab("dmarc").alias("dmarc"), grab("compauth").alias("compauth"),
        real(F.coalesce(domain(r"smtp\.mailfrom", behind_at), F.when(F.col("_spf").isNull(), spf_domain))).alias("spf_domain"),
        real(F.coalesce(domain(r"header\.d", lambda x: x), F.try_element_at(F.col("_signatures"), F.lit(1))["d"])).alias("dkim_domain"),
        real(domain(r"header\.from", behind_at)).alias("dmarc_from"), F.col("_signatures").alias("dkim_signatures"),
        F.size(header_all("arc-seal")).alias("arc_seals"),
        F.concat(F.col("_lines"), F.when(F.col("_spf").isNull(), F.transform(fallback, lambda x: F.concat(F.lit("Received-SPF: "), x))).otherwise(F.array().cast("array<string>"))).alias("raw"),
    )
    named = F.transform("addresses", lambda a: a.withField("org_domain", org_domain(a["domain"])))
    org = F.coalesce(F.try_element_at(addresses("from"), F.lit(1))["org_domain"], F.lit(""))
    aligned = lambda d: F.when((F.col("from_org") != "") & d.isNotNull(), org_domain(d) == F.col("from_org"))
    alignment = F.struct(aligned(F.col("auth.spf_domain")).alias("spf"), aligned(F.col("auth.dkim_domain")).alias("dkim"))
    return [{"_lines": lines, "_signatures": signatures, "addresses": named}, {"_spf": grab("spf"), "from_org": org}, {"auth": auth}, {"alignment": alignment}]


# Hours that the named zones of mail dates are ahead of universal time.
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?"
_ZONE = r"([a-z]+|(?:gmt|utc?)?[+-]\d{2}:?\d{2})"
_RFC = rf"^(?:[a-z]{{3,9}},? ?)?(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -](\d{{4}}|\d{{2}})[ ,]+{_CLOCK} ?{_ZONE}?$"
_ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[t ]{_CLOCK})?{_ZONE}?$"
_MONTH_FIRST = r"^(?:[a-z]{3,9},? )?([a-z]{3})[a-z]* (\d{1,2}),? (\d{4}) (\d.*)$"
_YEAR_LAST = r"^(?:[a-z]{3,9},? )?([a-z]{3})[a-z]* (\d{1,2}) (\d{1,2}:\d{2}(?::\d{2})?)((?: [a-z+-][a-z0-9:+-]*)?) (\d{4})$"


def timestamp_of(date: Column) -> Column:
    """A date as mail has it: day or month first, ISO, offsets or named zones, comments and the week day left out; without
    a zone, universal time. Null for anything else."""

    def build(d: Column) -> Column:
        iso = d.rlike(_ISO)
        part = lambda i, r: F.when(iso, F.regexp_extract(d, _ISO, i)).otherwise(F.regexp_extract(d, _RFC, r))
        number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
        name = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.regexp_extract(d, _RFC, 2))
        month = F.when(iso, F.regexp_extract(d, _ISO, 2).try_cast("int")).when((name > 0) & (name % 3 == 1), ((name + 2) / 3).cast("int"))
        written = part(1, 3)
        year = written.try_cast("int") + F.when(F.length(written) > 2, 0).when(written < "50", 2000).otherwise(1900)
        zone = part(7, 7)
        sign = F.when(zone.contains("-"), -1).otherwise(1)
        shift = sign * (number(F.regexp_extract(zone, r"[+-](\d{2})", 1)) * 3600 + number(F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})", 1)) * 60)
        named = F.try_element_at(F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair)), zone)
        offset = F.when((zone == "") | zone.rlike("[+-]"), shift).otherwise(named * 3600)  # null for a name that is none
        day = F.when(iso, F.regexp_extract(d, _ISO, 3)).otherwise(F.regexp_extract(d, _RFC, 1)).try_cast("int")
        clock = F.try_make_timestamp(year, month, day, number(part(4, 4)), number(part(5, 5)), number(part(6, 6)), F.lit("UTC"))
        return F.when(iso | d.rlike(_RFC), F.timestamp_seconds(F.unix_timestamp(clock) - offset))

    d = F.lower(F.trim(F.regexp_replace(F.regexp_replace(date, r"\([^)]*\)", " "), r"\s+", " ")))
    d = F.regexp_replace(F.regexp_replace(d, _MONTH_FIRST, "$2 $1 $3 $4"), _YEAR_LAST, "$2 $1 $5 $3$4")
    return let(d, build)


def with_hops(df: DataFrame) -> DataFrame:
    for step in _hop_steps():
        df = df.withColumns(step)
    return df.drop("_hops")


@built_once
def _hop_steps() -> list[dict[str, Column]]:
    """hops in time order, with the seconds since the hop before, and origin_ip."""

    def hop(line: Column) -> Column:
        word = lambda k: extract(line, rf"(?i){B}{k}\s+([^\s;()]+)")
        date = squeezed(extract(line, r";\s*([^;]+)$"))
        v6 = F.filter(F.regexp_extract_all(line, F.lit(f"({IPV6_IN_TEXT})"), 1), lambda x: F.instr(x, ":") > 1)
        ips = F.array_distinct(F.concat(F.regexp_extract_all(line, F.lit(rf"(?<![A-Za-z0-9_])({IPV4})(?![A-Za-z0-9_])"), 1), v6))
        return F.struct(
            word("from").alias("from_host"), word("by").alias("by_host"), extract(line, rf"(?i){B}with\s+([A-Za-z0-9._+-]+)").alias("with_proto"), word("id").alias("id"),
            extract(line, rf"(?i){B}for\s+<?([^\s;<>()]+@[^\s;<>()]+)>?").alias("for_addr"), date.alias("date"), timestamp_of(date).alias("ts"), ips.alias("ips"),
            F.filter(ips, lambda ip: ~is_private_ip(ip)).alias("public_ips"), squeezed(line).alias("raw"),
        )

    before = F.concat(F.array(F.lit(None).cast("timestamp")), F.transform("_hops", lambda h: h["ts"]))
    paired = F.zip_with("_hops", F.slice(before, F.lit(1), F.size("_hops")), lambda h, p: F.struct(h.alias("h"), (F.unix_timestamp(h["ts"]) - F.unix_timestamp(p)).alias("delay_seconds")))
    names = ("from_host", "by_host", "with_proto", "id", "for_addr", "date", "ts", "ips", "public_ips", "raw")
    numbered = F.transform(paired, lambda x, i: F.struct((i + 1).alias("hop"), *(x["h"][n].alias(n) for n in names), x["delay_seconds"].alias("delay_seconds")))
    origin = F.try_element_at(F.flatten(F.transform("hops", lambda h: h["public_ips"])), F.lit(1))
    return [{"_hops": F.reverse(F.transform(header_all("received"), hop))}, {"hops": numbered}, {"origin_ip": origin}]


def with_bodies(df: DataFrame) -> DataFrame:
    for step in _body_steps():
        df = df.withColumns(step)
    return df


@built_once
def _body_steps() -> list[dict[str, Column]]:
    """subject, plain, html and visible text."""
    of = lambda mime: F.array_join(F.transform(F.filter("parts", lambda p: (p["mime"] == mime) & p["text"].isNotNull()), lambda p: p["text"]), "\n\n")
    subject = F.coalesce(F.try_element_at(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "subject"), lambda h: h["decoded"]), F.lit(1)), F.lit(""))
    return [{"subject": subject, "plain": of("text/plain"), "html": of("text/html")}, {"visible": visible_text(F.col("plain"), F.col("html"))}]


def visible_text(plain: Column, html: Column) -> Column:
    """What a reader sees of both bodies."""
    return squeezed(F.when(html == "", plain).otherwise(F.concat_ws(" ", plain, entities(strip_tags(html)))))


def anchor_text(text: Column) -> Column:
    """What is shown of an anchor's text, up to 200 characters."""
    return F.substring(squeezed(entities(text)), 1, 200)


def raw_links(page: Column, html: Column, plain: Column) -> Column:
    """array<struct(url, text, source)> in order of source, then of place: what the markup refers to (``page``, as
    ``markup.page_links`` finds it), addresses in the text of the page, its refresh, and addresses in plain text."""
    link = lambda url, text, source: F.struct(url.alias("url"), text.alias("text"), source.alias("source"))
    none = F.array().cast("array<struct<url:string,text:string,source:string>>")
    some = lambda s: s.contains("://") | s.rlike(r"(?i)www\.")  # noqa: E731  # else there is no address, and no need to look for one
    found = lambda s: F.regexp_extract_all(s, F.lit(f"({URL})"), 1)
    bare = lambda s, source, own: F.when(some(s), F.transform(found(s), lambda u: link(own(u), F.lit(None).cast("string"), F.lit(source)))).otherwise(none)
    told = lambda r: F.when(r["source"] == "html:a", anchor_text(r["text"])).otherwise(r["text"])
    of_page = F.transform(page, lambda r: link(entities(r["url"]), told(r), r["source"]))
    refresh = lambda r: r["source"] == "html:refresh"
    ordered = let(of_page, lambda p: F.concat(F.filter(p, lambda r: ~refresh(r)), bare(strip_tags(html), "html:text", entities), F.filter(p, refresh)))
    return F.concat(F.when(html == "", none).otherwise(ordered), bare(plain, "text", lambda u: u))


CLICKABLE = ("html:a", "html:form", "html:refresh", "text")


def links(raw: Column, own_domains: Column) -> Column:
    """array<struct(ord, url, defanged, scheme, host, org_domain, own, kind, port, path, anchor_texts, sources, flags)>: one
    per address with a scheme, in order of first sight; weak flags don't count on the sender's own domains. Sightings of
    one address are brought together by sorting, so that a message of many links takes no more than its share."""
    seen = F.transform(raw, lambda r, i: F.struct(url_parts(r["url"]).alias("p"), i.alias("i"), r["text"].alias("text"), r["source"].alias("source")))
    keyed = F.transform(F.filter(seen, lambda x: x["p"]["scheme"] != ""), lambda x: F.struct(x["p"]["url"].alias("url"), x["i"].alias("i"), x.alias("x")))

    def build(s: Column, known: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (x["url"] != F.try_element_at(s, j)["url"]), j + 1)), lambda j: j.isNotNull())
        runs = let(begins, lambda b: F.zip_with(b, F.slice(F.concat(b, F.array(F.size(s) + 1)), F.lit(2), F.size(b)), lambda x, y: F.slice(s, x, y - x)))
        return F.transform(F.array_sort(F.transform(runs, lambda r: let(r, lambda own: detail(own, known)))), lambda x, i: x["link"].withField("ord", i))

    def detail(s: Column, known: Column) -> Column:
        p = F.element_at(s, 1)["x"]["p"]
        texts = F.array_distinct(F.filter(F.transform(s, lambda x: x["x"]["text"]), lambda t: t.isNotNull() & (t != "")))
        sources = F.array_distinct(F.transform(s, lambda x: x["x"]["source"]))
        org = org_domain(p["host"])
        own = F.array_contains(known, org)
        shown = F.filter(F.transform(texts, lambda t: F.regexp_extract(t, f"({URL})", 1)), lambda u: u != "")
        foreign = F.filter(F.transform(shown, lambda u: url_parts(u)["host"]), lambda h: (h != "") & (org_domain(h) != org))
        mismatches = F.transform(foreign, lambda h: flag("url-mismatch", F.concat(F.lit("shows "), h, F.lit(" but goes to "), p["host"])))
        kept = F.filter(F.concat(url_flags(p), mismatches), lambda f: ~(own & f["id"].isin(R.WEAK_ON_OWN_DOMAIN)))
        return F.struct(F.element_at(s, 1)["i"].alias("i"), F.struct(
            p["url"].alias("url"), defang(p["url"]).alias("defanged"), p["scheme"].alias("scheme"), p["host"].alias("host"), org.alias("org_domain"), own.alias("own"),
            F.when(F.arrays_overlap(sources, F.array(*(F.lit(c) for c in CLICKABLE))), "enlace").otherwise("recurso").alias("kind"), p["port"].alias("port"),
            F.substring(p["path"], 1, 300).alias("path"), texts.alias("anchor_texts"), sources.alias("sources"), kept.alias("flags"),
        ).alias("link"))

    known = F.filter(own_domains, lambda d: d.isNotNull() & (d != ""))
    return let(F.array_sort(keyed), lambda a: let(known, lambda k: build(a, k)))


@built_once
def _link_steps() -> list[dict[str, Column]]:
    return [{"_raw": raw_links(F.col("page_links"), F.col("html"), F.col("plain"))}, {"links": links(F.col("_raw"), F.array("from_org", org_domain(F.col("auth.dkim_domain"))))}]


def with_links(df: DataFrame) -> DataFrame:
    for step in _link_steps():
        df = df.withColumns(step)
    return df.drop("_raw", "page_links")


ATTACHMENT_TEXTS = {
    "att-exec": "an extension that runs", "att-macro": "an office file with macros", "att-container": "a container may hide what it holds", "att-html": "a page as attachment, as in local phishing",
    "att-double": "two extensions in the name", "att-rtlo": "characters that turn the direction of the name", "att-mismatch": "the content is a program, the name says otherwise",
    "att-ole": "an old office container under another extension", "att-empty": "an empty attachment",
}


def attachment_rules(name: Column, ext: Column, magic: Column, size: Column) -> list[tuple[str, Column]]:
    """Rule ids of an attachment with their conditions, in the catalogue's order."""
    return [
        ("att-exec", among(ext, R.EXEC_EXT)), ("att-macro", among(ext, R.MACRO_EXT)), ("att-container", among(ext, R.CONTAINER_EXT)), ("att-html", among(ext, R.HTML_EXT)),
        ("att-double", name.rlike(r"(?i)\.[a-z0-9]{2,4}\s*\.[a-z0-9]{2,4}$")), ("att-rtlo", name.rlike("[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]")),
        ("att-mismatch", (magic == "PE/DOS") & ~among(ext, R.EXEC_EXT)), ("att-ole", (magic == "OLE2") & ~ext.isin("doc", "xls", "ppt")), ("att-empty", size == 0),
    ]


def attachments(parts: Column) -> Column:
    """Attached parts, breadth first, with digests, magic and flags; contents are dropped."""

    def one(p: Column) -> Column:
        name = F.coalesce(p["filename"], F.lit("(unnamed)"))
        ext, content = ext_of(name), F.coalesce(p["content"], F.lit(b""))
        magic, size = magic_of(content), F.octet_length(content)
        flags = F.array(*(F.when(c, flag(i, F.lit(ATTACHMENT_TEXTS[i]))) for i, c in attachment_rules(name, ext, magic, size)))
        return F.struct(
            name.alias("filename"), p["mime"].alias("mime"), p["encoding"].alias("encoding"), p["disposition"].alias("disposition"), size.cast("long").alias("size"),
            human_size(size).alias("size_human"), magic.alias("magic"), ext.alias("ext"), F.md5(content).alias("md5"), F.sha1(content).alias("sha1"),
            F.sha2(content, 256).alias("sha256"), F.filter(flags, lambda x: x.isNotNull()).alias("flags"),
        )

    attached = F.filter(parts, lambda p: p["attached"])
    order = lambda a: F.array_sort(F.transform(a, lambda p, i: F.struct(p["depth"].alias("d"), p["ord"].alias("o"), i.alias("i"))))
    return let(attached, lambda a: F.transform(order(a), lambda k: one(F.element_at(a, k["i"] + 1))))


def content_rules(visible: Column, subject: Column) -> dict[str, Column]:
    """What the words of a message say: conditions over the visible text and the subject."""
    words = F.lower(F.concat_ws(" ", visible, subject))
    payment = has_any(words, R.PAYMENT)
    return {
        "subj-urgency": has_any(F.lower(subject), R.URGENCY), "payment": payment, "body-crypto": has_any(words, R.CRYPTO), "body-nocontacto": has_any(F.lower(visible), R.NO_CONTACT),
        "body-iban": payment & visible.rlike(f"{B}{R.IBAN}{E}"),
    }


def html_counts(html: Column) -> dict[str, Column]:
    """What the markup of a message holds: conditions and, with a leading n_, counts."""
    low = F.lower(html)
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    return {
        "has_form": low.rlike(f"<form{E}"), "has_password": low.rlike("type\\s*=\\s*[\"']?password"), "has_script": low.rlike(f"<script{E}"), "has_iframe": low.rlike(f"<iframe{E}"),
        "has_refresh": low.rlike("http-equiv\\s*=\\s*[\"']?refresh"), "n_hidden": count(f"(?:{R.HIDDEN_STYLE})"), "n_images": count(f"<img{E}"), "n_entities": count("&#x?[0-9a-f]{2,};"),
    }


def job_title(name: Column) -> Column:
    return name.rlike(f"(?iu){B}(?:{'|'.join(R.JOB_TITLES)}){E}")


def bulk_mailer(mailer: Column) -> Column:
    return mailer.rlike(f"(?i){R.BULK_MAILERS}")


def with_fired(df: DataFrame) -> DataFrame:
    """``df`` with fired, array<struct(id, msg)>: the rules that a message fires, in the catalogue's order of emission."""
    for step in _fired_steps():
        df = df.withColumns(step)
    return df.drop("_words", "_markup")


@built_once
def _fired_steps() -> list[dict[str, Column]]:
    as_struct = lambda d: F.struct(*(c.alias(n) for n, c in d.items()))
    words = as_struct(content_rules(F.col("visible"), F.col("subject")))
    markup = F.when(F.col("html") != "", as_struct(html_counts(F.col("html"))))
    return [{"_words": words, "_markup": markup}, {"fired": _fired()}]


def _fired() -> Column:
    auth, org, html, sender = F.col("auth"), F.col("from_org"), F.col("html"), F.try_element_at(addresses("from"), F.lit(1))
    seen_transport = (F.size(auth["raw"]) > 0) | (F.size("hops") > 0)
    reply, back = F.try_element_at(addresses("reply-to"), F.lit(1)), F.try_element_at(addresses("return-path"), F.lit(1))
    other_org = lambda a: (org != "") & (a["org_domain"] != "") & (a["org_domain"] != org)
    name, domain = F.coalesce(sender["name"], F.lit("")), F.coalesce(sender["domain"], F.lit(""))
    brand = first_brand(name)
    in_name = F.regexp_extract(name, r"(?<![A-Za-z0-9_.+-])([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+)", 1)
    has_from, freemail = sender.isNotNull(), among(org, R.FREEMAIL)
    message_id = F.trim(F.coalesce(header("message-id"), F.lit("")))
    mid_domain = F.regexp_extract(message_id, r"@([^>\s]+)>?\s*$", 1)
    mailer = F.coalesce(told("x-mailer"), told("user-agent"), F.lit(""))
    long_hop = F.try_element_at(F.filter("hops", lambda h: h["delay_seconds"] > 3600), F.lit(1))
    first_ts = F.try_element_at(F.filter("hops", lambda h: h["ts"].isNotNull()), F.lit(1))["ts"]
    skew = F.abs(F.unix_timestamp(first_ts) - F.unix_timestamp(timestamp_of(F.trim(header("date")))))
    words, markup = F.col("_words"), F.col("_markup")
    payment, has_html = words["payment"], html != ""
    stripped = F.length(squeezed(strip_tags(html)))
    misaligned, dkim_off = ~F.col("alignment.spf") & ~F.coalesce("alignment.dkim", F.lit(False)), ~F.col("alignment.dkim")
    is_ = lambda k, *v: auth[k].isin(*v)
    gone = lambda k: auth[k].isNull() & seen_transport
    mismatch_reply = reply.isNotNull() & other_org(reply)
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    known = lambda c, none: F.coalesce(c, F.lit(none))
    rules = [
        ("no-transport", ~seen_transport, say("no Received and no Authentication-Results headers: judged by content only")),
        ("spf-fail", is_("spf", "fail"), say("SPF fails: the server may not send for this domain")), ("spf-softfail", is_("spf", "softfail"), say("SPF softfail")),
        ("spf-none", gone("spf"), say("no SPF result in the headers")), ("spf-neutral", is_("spf", "none", "neutral"), say("SPF ", auth["spf"], ": no usable policy")),
        ("dkim-fail", is_("dkim", "fail"), say("DKIM fails: altered content or a false signature")), ("dkim-none", gone("dkim"), say("no DKIM result in the headers")),
        ("dkim-absent", is_("dkim", "none"), say("the message is not signed")), ("dmarc-fail", is_("dmarc", "fail"), say("DMARC fails: not aligned with the sender")),
        ("dmarc-none", gone("dmarc"), say("no DMARC result in the headers")), ("dmarc-absent", is_("dmarc", "none"), say("the domain has no DMARC policy")),
        ("compauth", is_("compauth", "fail", "softpass", "none"), say("compauth=", auth["compauth"], ": weak composite authentication")),
        ("align-none", misaligned, say("nothing aligns with ", org, ": SPF ", known(auth["spf_domain"], "unknown"), ", DKIM ", known(auth["dkim_domain"], "no signature"))),
        ("align-dkim", ~F.coalesce(misaligned, F.lit(False)) & dkim_off, say("DKIM signs as ", auth["dkim_domain"], ", not as ", org)),
        ("rp-mismatch", back.isNotNull() & other_org(back), say("Return-Path is of ", back["org_domain"], ", the sender of ", org)),
        ("replyto-mismatch", mismatch_reply, say("answers go to ", reply["address"], ", of another domain")),
        ("replyto-freemail", ~F.coalesce(mismatch_reply, F.lit(False)) & reply.isNotNull() & has_from & (F.lower(reply["address"]) != F.lower(sender["address"])) & freemail, say("answers go to ", reply["address"], ", another account")),
        ("dn-email", has_from & (in_name != "") & (org_domain(F.regexp_extract(in_name, "@([^@]*)", 1)) != org), say("the name shows another address: ", in_name)),
        ("dn-brand", brand.isNotNull() & (org != "") & ~F.regexp_replace(org, "[^a-z0-9]", "").contains(brand), say("the name shows ", brand, ", the domain is ", org)),
        ("dn-homoglyph", has_from & F.concat(name, known(sender["address"], "")).rlike("[\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}\\x{0100}-\\x{017F}]"), say("letters of the sender may imitate others")),
        ("from-punycode", domain.rlike(r"(?i)(^|\.)xn--"), say("the sender's domain is in punycode: ", domain)),
        ("from-tld", among(F.substring_index(domain, ".", -1), R.RISKY_TLDS), say("the sender's top-level domain is of much abuse: ", F.substring_index(domain, ".", -1))),
        ("from-freemail-cargo", freemail & job_title(name), say("poses as ", F.trim(name), " from a free account")),
        ("from-multi", F.size(addresses("from")) > 1, say(F.size(addresses("from")), " addresses in From")), ("from-missing", ~has_from, say("no From")),
        ("mid-missing", (message_id == "") & seen_transport, say("no Message-ID")),
        ("mid-mismatch", (mid_domain != "") & (org != "") & (org_domain(mid_domain) != org), say("the Message-ID is of ", org_domain(mid_domain))),
        ("xmailer", bulk_mailer(mailer), say("bulk mailing tool: ", F.trim(mailer))),
        ("x-orig-ip", told("x-originating-ip").isNotNull(), say("written at ", F.regexp_replace(told("x-originating-ip"), r"[\[\]]", ""))),
        ("rcv-none", (F.size("hops") == 0) & seen_transport, say("no Received headers")), ("rcv-one", F.size("hops") == 1, say("a single hop")),
        ("rcv-delay", long_hop.isNotNull(), say(F.round(long_hop["delay_seconds"] / 60).cast("long"), " minutes before hop ", long_hop["hop"])),
        ("date-skew", (F.size("hops") > 0) & (skew > 48 * 3600), say("Date and the first hop are over 48 hours apart")),
        ("subj-urgency", words["subj-urgency"], say("the subject presses for haste")),
        ("subj-nothread", F.lower("subject").rlike(r"^\s*re\s*:") & told("in-reply-to").isNull() & told("references").isNull(), say("poses as an answer, but refers to no message")),
        ("body-form", markup["has_form"], say("a form in the message")), ("body-password", markup["has_password"], say("a field for a password")), ("body-script", markup["has_script"], say("a script in the message")),
        ("body-iframe", markup["has_iframe"], say("an embedded frame")), ("body-refresh", markup["has_refresh"], say("goes to another page by itself")),
        ("body-hidden", (markup["n_hidden"] >= 2) & ~F.coalesce(is_("dmarc", "pass"), F.lit(False)), say(markup["n_hidden"], " styles that hide text")),
        ("body-image", has_html & (markup["n_images"] > 0) & (stripped < 120), say(markup["n_images"], " images and ", stripped, " characters")),
        ("body-entities", markup["n_entities"] > 40, say(markup["n_entities"], " numeric entities")),
        ("body-empty", ~has_html & (F.col("plain") == "") & (F.size("attachments") > 0), say("no text, but an attachment")), ("body-crypto", words["body-crypto"], say("speaks of cryptocurrency")),
        ("body-bec", payment & ((F.size(addresses("reply-to")) > 0) | F.coalesce(dkim_off, F.lit(False)) | freemail), say("asks for a payment, and the sender is in doubt")),
        ("body-iban", words["body-iban"], say("gives an account to pay to")), ("body-nocontacto", words["body-nocontacto"], say("asks not to call or tell anyone")),
    ]
    plain = F.filter(F.array(*(F.when(c, F.struct(F.lit(i).alias("id"), m.alias("msg"))) for i, c, m in rules)), lambda x: x.isNotNull())
    # flags of links, the first of each rule and host; told apart by text, as arrays of structs are compared pairwise
    key = lambda f, host: F.concat(f["id"], F.lit("|"), host)
    flagged = F.flatten(F.transform("links", lambda u: F.transform(u["flags"], lambda f: F.struct(key(f, u["host"]).alias("key"), f["id"].alias("id"), F.concat(f["msg"], F.lit(" -> "), F.substring(u["defanged"], 1, 160)).alias("msg")))))

    def once(rows: Column) -> Column:
        sorted_ = F.array_sort(F.transform(rows, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["id"].alias("id"), x["msg"].alias("msg"))))
        firsts = let(sorted_, lambda s: F.filter(s, lambda x, j: (j == 0) | (x["key"] != F.try_element_at(s, j)["key"])))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["id"].alias("id"), x["msg"].alias("msg")))), lambda x: F.struct(x["id"].alias("id"), x["msg"].alias("msg")))

    of_files = F.flatten(F.transform("attachments", lambda a: F.transform(a["flags"], lambda f: F.struct(f["id"].alias("id"), F.concat(f["msg"], F.lit(" ["), a["filename"], F.lit("]")).alias("msg")))))
    return F.concat(plain, let(flagged, once), of_files)


def iocs() -> Column:
    hosts = F.transform("links", lambda u: u["host"])
    own = F.transform(F.filter("addresses", lambda a: a["role"].isin("from", "reply-to", "return-path", "sender") & (a["address"] != "")), lambda a: a["address"])
    return F.struct(
        F.transform("links", lambda u: u["url"]).alias("urls"), F.array_distinct(F.filter(hosts, lambda h: (h != "") & ~is_ip(h))).alias("domains"),
        F.array_distinct(F.concat(F.filter(hosts, is_ip), F.flatten(F.transform("hops", lambda h: h["public_ips"])))).alias("ips"),
        F.array_distinct(F.transform("attachments", lambda a: a["sha256"])).alias("hashes"), F.array_distinct(own).alias("emails"),
    )


def last_steps(book: R.Book) -> list[dict[str, Column]]:
    return [{"findings": F.when(F.col("parse_error").isNull(), findings(F.col("fired"), book))}, *weights(book), {"iocs": iocs()}]


@built_once
def _last_steps() -> list[dict[str, Column]]:
    return last_steps(R.CATALOGUE)


@built_once
def _attachments() -> Column:
    return attachments(F.col("parts"))


def own_rules(book: R.Book) -> Column:
    """``fired`` with the rules whose condition the book gives as SQL: in the place of built-in ones of the same id, behind
    all others."""
    own = F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(i).alias("id"), F.lit(text).alias("msg"))) for i, c, text in book.conditions)), lambda x: x.isNotNull())
    names = [i for i, _, _ in book.conditions]
    return F.concat(F.filter("fired", lambda f: ~f["id"].isin(names)), own)


def analyze(messages: DataFrame, raw: str = "raw", book: R.Book = R.CATALOGUE) -> DataFrame:
    """One report row per message: auth, alignment, hops, links, attachments, findings, score_breakdown, score, verdict,
    iocs. A message that could not be parsed, or read (``read_error``), has ``parse_error`` and neither findings nor score
    nor verdict. ``book`` has the weights, caps and combinations, and rules of one's own."""
    df = with_parsed(messages, raw)
    if "read_error" in messages.columns:
        df = df.withColumn("parse_error", F.coalesce("read_error", "parse_error")).drop("read_error")
    df = with_links(with_bodies(with_hops(with_auth(df))))
    df = with_fired(df.withColumn("attachments", _attachments()))
    if book.conditions:
        df = df.withColumn("fired", own_rules(book))
    for step in _last_steps() if book == R.CATALOGUE else last_steps(book):
        df = df.withColumns(step)
    return df.drop("fired")
