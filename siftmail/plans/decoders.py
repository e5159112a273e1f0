"""The decoders, as SQL functions over tables: encoded words, transfer encodings, parameters, addresses, nested parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import register
from .urls import table


def decode_goldens(spark, sf_dir):
    """Names in encoded words and broken base64, soft line breaks, and parameters in pieces."""
    register(spark)
    coded = F.base64(F.encode("c_name", "UTF-8"))
    key = F.col("c_custkey").cast("string")
    word = F.concat(F.lit("=?utf-8?B?"), coded, F.lit("?=\t =?UTF-8?q?=C3=A9=20_"), key, F.lit("?= ?= =? "), "c_mktsegment")
    dirty = F.concat(F.substring(coded, 1, 3), F.lit("\r\n *"), F.rtrim(F.regexp_replace(F.substring(coded, 4, 1000), "=", "")))
    params = F.concat(F.lit("Attachment; x=\"a;"), key, F.lit("\"; n*1*=%C3%A9.txt; n*0*=utf-8''"), F.replace(F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", word.alias("word"), dirty.alias("dirty"), F.concat(F.lit("a=\r\n=C3=B1=ZZ_"), key).alias("soft"), params.alias("params"))
    rows.createOrReplaceTempView("siftmail_decoders")
    return spark.sql("""SELECT c_custkey, rfc2047(word) AS header, decode_text(dirty, 'base64', 'utf-8') AS body, decode_text(soft, 'quoted-printable', 'UTF8') AS quoted, decode_text('é', '8bit', 'latin1') AS narrow,
p.value AS value, p.params['x'] AS x, p.params['n'] AS n FROM (SELECT *, header_params(params) AS p FROM siftmail_decoders)""")


def address_goldens(spark, sf_dir):
    """Two addresses a header: a quoted name with a comma, and one with a comment."""
    register(spark)
    value = F.concat(F.lit('"'), "c_name", F.lit(', x" <mailto:U'), "c_custkey", F.lit("@Mail.Example.COM>, plain"), "c_custkey", F.lit("@b.example (a, b)"))
    table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")).createOrReplaceTempView("siftmail_addresses")
    return spark.sql("SELECT c_custkey, i AS position, a.name, a.address, a.domain FROM siftmail_addresses LATERAL VIEW posexplode(address_list(value)) t AS i, a")


def mime_goldens(spark, sf_dir):
    """Each text inside nested parts; the path, the kind and the text of every part."""
    register(spark)
    head = "Content-Type: multipart/mixed; boundary=o\r\n\r\nbefore\r\n--o\r\nContent-Type: multipart/alternative; boundary=\"i\"\r\n\r\n--i\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    tail = "\r\n--i  \r\nContent-Type: text/html\r\n\r\n<b>x</b>\r\n--i--\r\n--o\r\nContent-Type: message/rfc822\r\n\r\nSubject: in\r\n\r\ninner\r\n--o--\r\nafter"
    raw = F.encode(F.concat(F.lit(head), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit(tail)), "UTF-8")
    table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).createOrReplaceTempView("siftmail_messages")
    return spark.sql("SELECT doc_id, p.part_id, p.parent_id, p.depth, p.mime, md5(p.text) AS text_md5 FROM siftmail_messages, LATERAL mime_parts(raw) p")


QUERIES = {f.__name__: f for f in (decode_goldens, address_goldens, mime_goldens)}

SQL = {
    "decode_goldens": """SELECT c_custkey, c_name || 'é  ' || c_custkey || ' ?= =? ' || c_mktsegment AS header, c_name AS body, 'añ=ZZ_' || c_custkey AS quoted, 'é' AS narrow, 'attachment' AS value,
'a;' || c_custkey AS x, c_name || 'é.txt' AS n FROM customer""",
    "address_goldens": """SELECT c_custkey, 0 AS position, c_name || ', x' AS name, 'U' || c_custkey || '@Mail.Example.COM' AS address, 'mail.example.com' AS domain FROM customer
UNION ALL SELECT c_custkey, 1, '', 'plain' || c_custkey || '@b.example (a, b)', 'b.example (a, b)' FROM customer""",
    "mime_goldens": """SELECT doc_id, part_id, parent_id, depth, mime, CASE kind WHEN 't' THEN md5(coalesce(text, '')) WHEN 'h' THEN md5('<b>x</b>') WHEN 'i' THEN md5('inner') END AS text_md5
FROM documents, (VALUES ('1', NULL, 0, 'multipart/mixed', ''), ('1.1', '1', 1, 'multipart/alternative', ''), ('1.1.1', '1.1', 2, 'text/plain', 't'), ('1.1.2', '1.1', 2, 'text/html', 'h'),
('1.2', '1', 1, 'message/rfc822', ''), ('1.2.1', '1.2', 2, 'text/plain', 'i')) p(part_id, parent_id, depth, mime, kind)""",
}
