"""Mailboxes made of ``conversations``, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.parse import with_parsed
from ..sources.mailfiles import write_mailboxes
from ..sources.messages import read_messages
from ..sources.scratch import new_folder
from .urls import table


def mail_files(spark, sf_dir):
    """Each turn as a message of a mailbox: what its subject says, and the size and digest of what was read."""
    turns = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("From: "), "role", F.lit("@conv.example\nSubject: "), "conv_id", F.lit("/"), "turn", F.lit("\n\nFrom: "), F.coalesce("text", F.lit("")), F.lit("\nFrom here on\n"))
    uri = new_folder(spark, "mailboxes")
    write_mailboxes(turns.select(raw.alias("raw")), uri)
    mail = read_messages(spark, uri, partition_bytes=4 << 20)
    subject = F.element_at(F.filter("headers", lambda h: h["name"] == "Subject"), 1)["value"]
    return with_parsed(mail).select(subject.alias("subject"), "size_bytes", F.col("message_id").alias("sha256"), F.coalesce("read_error", "parse_error").alias("error"))


QUERIES = {"mail_files": mail_files}
SQL = {
    "mail_files": """WITH m AS (SELECT conv_id || '/' || turn AS subject, 'From: ' || role || '@conv.example' || chr(10) || 'Subject: ' || conv_id || '/' || turn || chr(10) || chr(10) || 'From: ' || coalesce(text, '') ||
  chr(10) || 'From here on' || chr(10) AS raw FROM conversations) SELECT subject, octet_length(encode(raw))::BIGINT AS size_bytes, sha256(raw) AS sha256, NULL::VARCHAR AS error FROM m""",
}
