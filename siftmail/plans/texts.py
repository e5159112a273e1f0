"""Queries over ``documents``, ``conversations`` and others: indicators, content rules, digests, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import IPV4, ext_of, first_brand, html_escape, human_size, is_private_ip, lookup_url, magic_of, short_address
from ..operators import analyze as A
from .urls import spread, table

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}"
DOTTED = rf"(?<![A-Za-z0-9_]){IPV4}(?![A-Za-z0-9_])"


def doc_emails(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


def doc_ips(spark, sf_dir):
    """Distinct addresses of each text, and whether they are private."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({DOTTED})"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("ip")).select("doc_id", "ip", is_private_ip(F.col("ip")).alias("private"))


def ioc_union(spark, sf_dir):
    """Indicators of documents and pages, each once."""
    hosts = table(spark, sf_dir, "pages").select(F.lit("domain").alias("kind"), F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("value"))
    emails = doc_emails(spark, sf_dir).select(F.lit("email").alias("kind"), F.col("email").alias("value"))
    ips = doc_ips(spark, sf_dir).where("NOT private").select(F.lit("ip").alias("kind"), F.col("ip").alias("value"))
    return hosts.unionByName(emails).unionByName(ips).distinct()


def doc_hashes(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


def first_brand_in_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", first_brand(F.col("text")).alias("brand"))


#: doc_id modulo -> appended phrase
PHRASES = {
    2: " acción requerida en 24 horas", 3: " hagan la transferencia al IBAN ES91 2100 0418 4502 0005 1332", 5: " paid in bitcoin", 7: " no me llames, es confidencial", 11: " URGENTE último aviso",
}
#: The rules' words, stated once more by hand for the SQL.
RULES = {
    "subj-urgency": "(?i)urgente|inmediat|caduca|expira|vence|suspend|bloquea|bloqueo|último aviso|accion requerida|acción requerida|24 horas|48 horas|impag|multa|sanción|premio|herencia|urgent|immediate|expires?|action required|final notice|overdue|last warning",
    "payment": "(?i)transferencia|wire transfer|iban|swift|cambio de cuenta|bank details|datos bancarios|nomina|payroll|pago urgente|urgent payment",
    "body-crypto": "(?i)bitcoin|btc|usdt|ethereum|monero|wallet|seed phrase|frase semilla|criptomoneda",
    "body-nocontacto": "(?i)no me llames|no llames|no puedo hablar|estoy en una reuni[oó]n|no digas nada|es confidencial",
    "job-title": r"(?i)\b(?:ceo|cfo|coo|cto|director|directora|direccion|dirección|gerente|presidente|presidenta|administrador|administradora|jefe|jefa|responsable|manager|head of)\b",
    "bulk-mailer": r"(?i)phpmailer|sendmail|python|swiftmailer|mass|bulk|axigen|smtplib|mailer\s*script",
}
_IBAN = r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Za-z0-9]{4}[ ]?){3,7}[A-Za-z0-9]{1,4}\b"


def content_rules(spark, sf_dir):
    """Which content rules each text fires, phrases appended by id so that each fires somewhere."""
    text = F.concat("text", *(F.when(F.col("doc_id") % k == 0, F.lit(p)).otherwise("") for k, p in PHRASES.items()))
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("whole"))
    rules = A.content_rules(F.col("whole"), F.col("whole")) | {"job-title": A.job_title(F.col("whole")), "bulk-mailer": A.bulk_mailer(F.col("whole"))}
    hit = (F.when(c, F.lit(i)) for i, c in rules.items())
    return texts.select("doc_id", F.explode(F.array(*hit)).alias("id")).where("id IS NOT NULL")


def human_sizes(spark, sf_dir):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 37).otherwise(1021)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), human_size(n).alias("size"))


def magic_numbers(spark, sf_dir):
    """File types by leading bytes: a signature in front of each text by id, none for every eleventh."""
    head = F.lit(b"")
    for k, (signature, _) in enumerate(R.MAGIC):
        head = F.when(F.col("doc_id") % 11 == k, F.lit(bytes.fromhex(signature))).otherwise(head)
    return table(spark, sf_dir, "documents").select("doc_id", magic_of(F.concat(head, F.col("text").cast("binary"))).alias("magic"))


def file_extensions(spark, sf_dir):
    """Attachment rules by extension, for names made of ids."""
    exts = [*R.EXEC_EXT, *R.MACRO_EXT, *R.CONTAINER_EXT, *R.HTML_EXT, "pdf", "txt", "docx"]
    ext = F.element_at(F.array(*(F.lit(x) for x in exts)), (F.col("doc_id") % len(exts) + 1).cast("int"))
    rules = A.attachment_rules(F.col("name"), F.col("ext"), F.lit(None).cast("string"), F.lit(1))
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Name."), F.upper(ext)).alias("name"))
    return names.withColumn("ext", ext_of(F.col("name"))).select("doc_id", "ext", F.coalesce(*(F.when(c, F.lit(i)) for i, c in rules)).alias("rule"))


def escaped_turns(spark, sf_dir):
    """Conversation turns as safe HTML."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", html_escape(F.concat_ws(" ", F.concat(F.lit("<"), "role", F.lit(">")), "text")).alias("html"))


def lookup_links(spark, sf_dir):
    """Search addresses for page hosts; nothing is fetched."""
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", lookup_url("https://lookup.invalid/search/", F.concat(host, F.lit(" a+b"))).alias("lookup"))


def short_addresses(spark, sf_dir):
    name = F.concat(F.substring(F.md5(F.col("c_name").cast("binary")), 1, (F.col("c_custkey") % 32 + 1).cast("int")), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("address"), short_address(name).alias("short"))


QUERIES = {
    f.__name__: f
    for f in (doc_emails, doc_ips, ioc_union, doc_hashes, first_brand_in_text, content_rules, human_sizes, magic_numbers, file_extensions, escaped_turns, lookup_links, short_addresses)
}

_EMAILS = f"emails AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS email FROM documents)"
_PRIVATE = r"regexp_matches(ip, '^(?:10\.|127\.|192\.168\.|169\.254\.|0\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)')"
_IPS = rf"ips AS (SELECT doc_id, ip, {_PRIVATE} AS private FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b{IPV4}\b'))) AS ip FROM documents))"
_BRAND = "CASE " + " ".join(f"WHEN contains(plain, '{b}') THEN '{b}'" for b in R.BRANDS) + " END"
_TEXT = "text || " + " || ".join(f"CASE WHEN doc_id % {k} = 0 THEN '{p}' ELSE '' END" for k, p in PHRASES.items())
_N = "(n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 1021 END)"
_EXTS = [*R.EXEC_EXT, *R.MACRO_EXT, *R.CONTAINER_EXT, *R.HTML_EXT, "pdf", "txt", "docx"]


def _in(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


SQL = {
    "doc_emails": f"WITH {_EMAILS} SELECT * FROM emails",
    "doc_ips": f"WITH {_IPS} SELECT * FROM ips",
    "ioc_union": f"""WITH {_EMAILS}, {_IPS} SELECT 'domain' AS kind, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS value FROM pages
UNION SELECT 'email', email FROM emails UNION SELECT 'ip', ip FROM ips WHERE NOT private""",
    "doc_hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "first_brand_in_text": f"SELECT doc_id, {_BRAND} AS brand FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS plain FROM documents)",
    "content_rules": f"WITH t AS (SELECT doc_id, {_TEXT} AS text FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS id FROM t WHERE regexp_matches(text, '{p}')" for i, p in RULES.items())
    + f" UNION ALL SELECT doc_id, 'body-iban' FROM t WHERE regexp_matches(text, '{_IBAN}') AND regexp_matches(text, '{RULES['payment']}')",
    "human_sizes": f"""SELECT doc_id, {_N} AS n_bytes, CASE WHEN {_N} < 1024 THEN {_N}::VARCHAR || ' B'
WHEN {_N} < 1048576 THEN ((20 * {_N} + 1024) // 2048 // 10)::VARCHAR || '.' || ((20 * {_N} + 1024) // 2048 % 10)::VARCHAR || ' KB'
ELSE ((200 * {_N} + 1048576) // 2097152 // 100)::VARCHAR || '.' || lpad(((200 * {_N} + 1048576) // 2097152 % 100)::VARCHAR, 2, '0') || ' MB' END AS size FROM documents""",
    "magic_numbers": "SELECT doc_id, CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (_, n) in enumerate(R.MAGIC)) + " END AS magic FROM documents",
    "file_extensions": f"""SELECT doc_id, ext, CASE WHEN ext IN ({_in(R.EXEC_EXT)}) THEN 'att-exec' WHEN ext IN ({_in(R.MACRO_EXT)}) THEN 'att-macro'
WHEN ext IN ({_in(R.CONTAINER_EXT)}) THEN 'att-container' WHEN ext IN ({_in(R.HTML_EXT)}) THEN 'att-html' END AS rule
FROM (SELECT doc_id, [{_in(_EXTS)}][doc_id % {len(_EXTS)} + 1] AS ext FROM documents)""",
    "escaped_turns": """SELECT conv_id, turn, replace(replace(replace(replace(concat_ws(' ', '<' || role || '>', text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM conversations""",
    "lookup_links": "SELECT page_id, 'https://lookup.invalid/search/' || url_encode(regexp_extract(url, '^https?://([^/?#:]+)', 1) || ' a+b') AS lookup FROM pages",
    "short_addresses": """WITH a AS (SELECT c_custkey, md5(c_name)[1:(c_custkey % 32 + 1)] AS local FROM customer)
SELECT c_custkey, local || '@example.com' AS address, CASE WHEN length(local) > 22 THEN local[1:20] || '…' ELSE local END || '@example.com' AS short FROM a""",
}
