"""Registration for use in Spark SQL: Arrow UDFs of the decoders, a table function for MIME parts, SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import IPV4, IPV6, B

PARTS = "part_id string, parent_id string, depth int, mime string, charset string, disposition string, encoding string, filename string, text string"


class _MimeParts:
    """``SELECT * FROM messages, LATERAL mime_parts(raw)``: the parts of each message, depth first."""

    def eval(self, raw):
        from ..operators.parse import mime_parts

        names = [c.split()[0] for c in PARTS.split(", ")]
        for part in mime_parts(bytes(raw or b"").decode("latin-1")):
            yield tuple(part[n] for n in names)


def register(spark: SparkSession) -> None:
    """rfc2047(s), decode_text(body, encoding, charset), header_params(s), address_list(s), mime_parts(raw), defang(s), is_ip(s), is_private_ip(s)."""
    from ..operators import parse

    @F.pandas_udf("string")
    def rfc2047(s: pd.Series) -> pd.Series:
        return s.map(parse.rfc2047)

    @F.pandas_udf("array<struct<raw:string,name:string,address:string,domain:string>>")
    def address_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(parse.address_list)

    @F.pandas_udf("string")
    def decode_text(body: pd.Series, encoding: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([parse.decode_bytes(parse.transfer_decoded(b, e), c) for b, e, c in zip(body, encoding, charset, strict=True)])

    @F.pandas_udf("struct<value:string,params:map<string,string>>")
    def header_params(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(parse.params_of, s)), columns=["value", "params"])

    spark.udf.register("rfc2047", rfc2047)
    spark.udf.register("decode_text", decode_text)
    spark.udf.register("header_params", header_params)
    spark.udf.register("address_list", address_list)
    spark.udtf.register("mime_parts", F.udtf(_MimeParts, returnType=PARTS))
    functions = {
        "defang(s STRING) RETURNS STRING": rf"replace(replace(regexp_replace(regexp_replace(s, r'(?i){B}https://', 'hxxps://'), r'(?i){B}http://', 'hxxp://'), '.', '[.]'), '@', '[@]')",
        "is_ip(s STRING) RETURNS BOOLEAN": f"coalesce(rlike(s, r'^(?:{IPV4}|{IPV6})$'), false)",
        "is_private_ip(s STRING) RETURNS BOOLEAN": rf"coalesce(CASE WHEN rlike(s, r'^{IPV4}$') THEN rlike(s, r'^(?:10\.|127\.|192\.168\.|169\.254\.|0\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)') ELSE rlike(lower(s), '^(?:::1$|fe80:|fc|fd)') END, false)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
