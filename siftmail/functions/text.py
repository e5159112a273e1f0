"""Column functions over hosts, addresses, URLs, markup and files. All are Catalyst expressions."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R

# ASCII word borders: Java's \b knows other letters
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HEX = r"[0-9A-Fa-f]{1,4}"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
IPV6 = rf"(?:{HEX}:){{3,7}}{HEX}|(?:{HEX}:){{1,6}}:{HEX}"
#: An address of six kind within a text: a border at both ends of either form.
IPV6_IN_TEXT = rf"{B}(?:{HEX}:){{3,7}}{HEX}{E}|{B}(?:{HEX}:){{1,6}}:{HEX}{E}"
# most characters fail the first test, which is the cheapest
URL = rf"(?i)(?=[fhw]){B}(?:(?:https?|ftp|file)://[^\s<>\"'`)\]}}]+|www\.[a-z0-9-]+(?:\.[a-z0-9-]+)+[^\s<>\"'`)\]}}]*)"


#: Signs that belong to the sentence, not to the address before them.
_TAIL = ")>]}.,;:'\""
_WHOLE = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#]*)(.*)$"
_PAIR = r"^(\[[^\]]+\]|[^:]+)(?::([0-9]+))?$"


def built_once(f):
    """``f()`` (columns over fixed names) once for each JVM: building large expressions takes longer than a small run."""
    made: dict[int, object] = {}

    @functools.wraps(f)
    def get():
        key = id(SparkContext._jvm)
        if key not in made:
            made.clear()
            made[key] = f()
        return made[key]

    return get


def among(x: Column, values: list[str]) -> Column:
    """Whether the one-line text is one of the values: one search in one literal."""
    return F.lit("\n" + "\n".join(values) + "\n").contains(F.concat(F.lit("\n"), x, F.lit("\n")))


def exploded(df: DataFrame, values: Column | str, name: str, *keep: str) -> DataFrame:
    """``keep``, position and ``name``: a row for each value of an array. By way of the outer form, as the plain one puts a
    filter under itself, which then repeats the whole computation of the array."""
    values = F.col(values) if isinstance(values, str) else values
    return df.select(*keep, F.posexplode_outer(values).alias("position", name)).where("position IS NOT NULL")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_ip(host: Column) -> Column:
    return F.coalesce(host.rlike(f"^(?:{IPV4}|{IPV6})$"), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    v4 = r"^(?:10\.|127\.|192\.168\.|169\.254\.|0\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
    return F.coalesce(F.when(ip.rlike(f"^{IPV4}$"), ip.rlike(v4)).otherwise(F.lower(ip).rlike("^(?:::1$|fe80:|fc|fd)")), F.lit(False))


def _clean_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^\[|[\].]+$", "")


def _registrable(h: Column) -> Column:
    """Last two labels of a clean host, three under a two-level suffix; addresses and short hosts stay."""
    labels = F.size(F.split(h, r"\."))
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.when(is_ip(h) | (labels <= 2), h).when(among(two, R.SUFFIXES), three).otherwise(two)


def org_domain(host: Column) -> Column:
    """Registrable domain of a host; '' for none."""
    return let(_clean_host(host), _registrable)


def defang(s: Column) -> Column:
    for a, b in ((rf"(?i){B}https://", "hxxps://"), (rf"(?i){B}http://", "hxxp://"), (r"\.", "[.]"), ("@", "[@]")):
        s = F.regexp_replace(s, a, b)
    return s


def url_parts(url: Column) -> Column:
    """struct(url, scheme, host, port, userinfo, path); scheme '' if there is no '://'."""
    s = F.rtrim(F.trim(url), F.lit(_TAIL))
    s = F.when(s.rlike(r"(?i)^www\."), F.concat(F.lit("http://"), s)).otherwise(s)
    whole, pair = _WHOLE, _PAIR

    def build(x: Column) -> Column:
        full = x.rlike(whole)
        authority = F.regexp_extract(x, whole, 2)
        place = F.regexp_replace(authority, r"^.*@", "")
        host = F.when(place.rlike(pair), F.regexp_extract(place, pair, 1)).otherwise(place)
        return F.struct(
            x.alias("url"), F.lower(F.regexp_extract(x, whole, 1)).alias("scheme"), F.when(full, F.lower(host)).otherwise("").alias("host"),
            F.when(full, F.regexp_extract(place, pair, 2)).otherwise("").alias("port"), F.when(full, F.regexp_extract(authority, r"^(.*)@", 1)).otherwise("").alias("userinfo"),
            F.when(full, F.regexp_extract(x, whole, 3)).otherwise(x).alias("path"),
        )

    return let(s, build)


def url_rules(url: Column, scheme: Column, host: Column, port: Column, userinfo: Column, path: Column, org: Column) -> list[tuple[str, Column]]:
    """Rule ids of a parsed URL with their conditions, in catalogue order; what needs anchor texts is apart. No condition
    uses a lambda, so a projection of them is generated code."""
    creds = F.lower(path).rlike("|".join(R.CREDENTIAL_WORDS))
    # a brand is a token of the host, and the registrable domain does not begin with it
    imitates = F.concat(host, F.lit("/"), org).rlike(rf"^(?:[^/]*[.\-_])?({'|'.join(R.BRANDS)})(?:[.\-_][^/]*)?/(?!\1)")
    return [
        ("url-ip", is_ip(host)), ("url-punycode", host.rlike(r"(?i)(^|\.)xn--")), ("url-userinfo", userinfo != ""), ("url-shortener", among(org, R.SHORTENERS)),
        ("url-redirector", host.rlike(R.REDIRECTORS)), ("url-port", ~port.isin("", "80", "443")), ("url-tld", among(F.substring_index(host, ".", -1), R.RISKY_TLDS)),
        ("url-creds", creds), ("url-http", (scheme == "http") & creds), ("url-subdomains", F.size(F.split(host, r"\.")) >= 5), ("url-brand", imitates),
        ("url-data", F.lower(url).startswith("data:")), ("url-filehost", among(host, R.FILE_HOSTS) | among(org, R.FILE_HOSTS)),
    ]


#: What each flag of a link tells; braces take a part of the link.
URL_TEXTS = {
    "url-ip": "goes to a bare address without a name", "url-punycode": "the domain is written in punycode and may imitate another", "url-userinfo": "a name before @ hides the host: {userinfo}",
    "url-shortener": "a shortener hides the destination", "url-redirector": "the host redirects or tracks", "url-port": "unusual port {port}", "url-tld": "top-level domain of much abuse",
    "url-creds": "the path has words of credential theft", "url-http": "a sensitive page without encryption", "url-subdomains": "very many subdomains in {host}",
    "url-brand": "a brand stands in the name of a foreign domain: {host}", "url-data": "the page itself is in the address", "url-filehost": "a file service, check that you expected it: {host}",
}
_SEVERITY = {rule: severity for rule, _, _, severity in R.RULES}


def _filled(text: str, p: Column) -> Column:
    """The text with parts of a parsed URL in its braces."""
    return F.concat(*(p[piece[1:-1]] if piece.startswith("{") else F.lit(piece) for piece in re.split(r"(\{[a-z]+\})", text) if piece))


def flag(rule: str, msg: Column) -> Column:
    """struct(id, sev, msg) of a rule of links or attachments."""
    return F.struct(F.lit(rule).alias("id"), F.lit(_SEVERITY[rule]).alias("sev"), msg.alias("msg"))


def url_flags(p: Column) -> Column:
    """array<struct(id, sev, msg)> of one parsed URL (struct of ``url_parts``)."""

    def flags(org: Column) -> Column:
        rules = url_rules(*(p[c] for c in ("url", "scheme", "host", "port", "userinfo", "path")), org)
        return F.filter(F.array(*(F.when(c, flag(i, _filled(URL_TEXTS[i], p))) for i, c in rules)), lambda x: x.isNotNull())

    return let(org_domain(p["host"]), flags)


def with_url_columns(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``url`` trimmed and scheme, host, port, userinfo, path and org beside it; flat projections only."""
    s = F.rtrim(F.trim(F.col(url)), F.lit(_TAIL))
    df = df.withColumn(url, F.when(s.rlike(r"(?i)^www\."), F.concat(F.lit("http://"), s)).otherwise(s))
    full = F.col(url).rlike(_WHOLE)
    df = df.withColumns({"scheme": F.lower(F.regexp_extract(url, _WHOLE, 1)), "_authority": F.regexp_extract(url, _WHOLE, 2), "path": F.when(full, F.regexp_extract(url, _WHOLE, 3)).otherwise(F.col(url))})
    df = df.withColumns({"userinfo": F.regexp_extract("_authority", r"^(.*)@", 1), "_place": F.regexp_replace("_authority", r"^.*@", "")})
    host = F.when(F.col("_place").rlike(_PAIR), F.regexp_extract("_place", _PAIR, 1)).otherwise(F.col("_place"))
    df = df.withColumns({"host": F.lower(host), "port": F.regexp_extract("_place", _PAIR, 2)})
    return df.withColumn("_host", _clean_host(F.col("host"))).withColumn("org", _registrable(F.col("_host"))).drop("_authority", "_place", "_host")


def url_rules_of_columns() -> list[tuple[str, Column]]:
    """``url_rules`` over the columns of ``with_url_columns``."""
    return url_rules(*(F.col(c) for c in ("url", "scheme", "host", "port", "userinfo", "path", "org")))


def first_brand(name: Column) -> Column:
    """First brand, in the catalogue's order, within a name of letters and digits."""

    def first(plain: Column) -> Column:
        out = F.lit(None).cast("string")
        for b in reversed(R.BRANDS):
            out = F.when(plain.contains(b), F.lit(b)).otherwise(out)
        return out

    return let(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), first)


def strip_tags(html: Column) -> Column:
    """Each ``<...>`` as a space. Behind the last ``>`` nothing is looked for, or every ``<`` there would be searched to the
    end of the text."""
    rest = F.substring_index(html, ">", -1)
    return F.concat(F.regexp_replace(F.substring(html, F.lit(1), F.length(html) - F.length(rest)), r"<[^>]+>", " "), rest)


_NARROW = r"\t-\r\x{A0}"
_WIDE = _NARROW + r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def squeezed(s: Column) -> Column:
    """Runs of blanks as one space, none at the ends. Single spaces, which are most, are no match; blanks beyond Latin-1
    are looked for only in texts with such characters."""
    runs = lambda x: F.regexp_replace(s, f"[{x}][ {x}]*| [ {x}]+", " ")
    return F.trim(F.when(s.rlike(r"[\x{1680}-\x{FEFF}]"), runs(_WIDE)).otherwise(runs(_NARROW)))


def has_any(s: Column, alternatives: str) -> Column:
    """Whether one of the literal alternatives (a|b|c) is in the text: plain search, many times as fast as a pattern."""
    return functools.reduce(lambda a, b: a | b, (s.contains(x) for x in alternatives.split("|")))


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def entities(s: Column) -> Column:
    """Numeric, then the seven common named entities; others and impossible numbers stay as they are."""

    def numeric(text: Column, pattern: str, number) -> Column:
        parts, codes = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)

        def one(c: Column) -> Column:
            n = number(c)
            good = n.isNotNull() & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.when(good, _code_point(F.coalesce(n, F.lit(63).cast("long")))).otherwise(c)

        joined = F.zip_with(parts, F.concat(F.transform(codes, one), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(F.size(codes) == 0, text).otherwise(F.array_join(joined, ""))

    whole = s
    s = numeric(s, r"(?i:&#x[0-9a-f]{1,8};)", lambda c: F.conv(F.regexp_extract(c, r"(?i)x([0-9a-f]+)", 1), 16, 10).cast("long"))
    s = numeric(s, r"&#[0-9]{1,9};", lambda c: F.regexp_extract(c, r"([0-9]+)", 1).try_cast("long"))
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&(?:#39|apos);", "'"), ("&nbsp;", " ")):
        s = F.regexp_replace(s, f"(?i){a}", b)
    return F.when(whole.contains("&"), s).otherwise(whole)


def ext_of(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([a-z0-9_-]{1,20})$", 1)


def magic_of(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for signature, name in reversed(R.MAGIC):
        out = F.when(F.substring(content, 1, len(signature) // 2) == F.lit(bytes.fromhex(signature)), F.lit(name)).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Bytes as B, KB (one decimal) or MB (two), base 1024, halves rounded up, in whole-number arithmetic."""
    n = n.cast("long")
    tenths, hundredths = F.floor((20 * n + 1024) / 2048), F.floor((200 * n + 1048576) / 2097152)
    kb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" KB"))
    mb = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def short_address(address: Column) -> Column:
    """Local parts of over 22 characters cut to 20 and an ellipsis; the domain is what follows the last @."""
    domain = F.substring_index(address, "@", -1)
    local = F.substring(address, F.lit(1), F.length(address) - F.length(domain) - 1)
    return F.when(address.contains("@") & (F.length(local) > 22), F.concat(F.substring(local, 1, 20), F.lit("…@"), domain)).otherwise(address)


def lookup_url(base: str, value: Column) -> Column:
    """A search address with the value percent-encoded; nothing is fetched."""
    return F.concat(F.lit(base), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
