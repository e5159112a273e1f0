"""The corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns the columns of
``documents`` (the last: pieces of packed sequences). Stages are written as Parquet between each other. The scratch
tables of a stage stay as long as the next stages' input reads them: a stage called on a written table deletes those of
the stages before it in the same thread, one called on a frame that still reads them keeps them. ``run`` leaves only
what its result reads; ``with siftmail.llm.common.scratch(spark):`` around it deletes that, too.

Nulls: a null text has no language and goes at the first stage. A null id is kept by every later stage, never merged
with another. Repeated rows (one id, one text) leave the near-duplicate stage as one; rows of one id and several texts
are documents of their own, compared text by text. Extra columns are dropped by
the first stage; an empty table passes through as one.
"""

from __future__ import annotations

import threading
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmail.llm import curve_packing, lang_spans, minmax_dedup, repeat_dedup, toxic_lexicon
from siftmail.llm.chunked_bpe import ranks_from_json
from siftmail.llm.common import fold, own, read_by, release, saved, scratch_dir, table, taken, written
from siftmail.llm.queries_toxic_lexicon import labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A text less of whose letters than this are of its main language is rejected, as one without letters is.
MIN_LANGUAGE_SHARE = 0.3
MAX_TOXICITY = 0.3



class _Before(threading.local):
    """Scratch tables of the stages that this thread has called."""

    def __init__(self):
        self.tables: list[str] = []


_before = _Before()


def _stage(f):
    """The stage ``f``, whose scratch tables live until a later stage is called that doesn't read them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still = read_by(docs, _before.tables)
        release(spark, [t for t in _before.tables if t not in still])
        mark = written()
        out = f(spark, docs, sf_dir)
        _before.tables = sorted(still) + taken(mark)
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language: letters at all, and enough of them in one language."""
    docs = docs.select(*COLUMNS)
    model = lang_spans.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    named = docs.withColumn("found", lang_spans.language_of(F.col("text"), model))
    return named.where((F.col("found.lang") != lang_spans.UND) & (F.col("found.score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below MAX_TOXICITY."""
    model = toxic_lexicon.fit(labelled(spark, sf_dir, docs))
    scored = docs.select(*COLUMNS).withColumn("toxicity", toxic_lexicon.toxicity(F.col("text"), model))
    return scored.where(F.col("toxicity") < MAX_TOXICITY).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id and, within an id, of the smallest text.
    Rows that share an id but not the text are documents of their own; those that are linked with nothing all stay."""
    docs = docs.select(*COLUMNS)
    named, unnamed = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    digest = F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
    several = named.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
    if several.isEmpty():
        kept = minmax_dedup.near_duplicates(named).where("kept").select("doc_id").distinct().withColumnRenamed("doc_id", "kept_id")
        left = named.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    else:  # numbered in the order of (id, text), so that each text is compared as itself
        rows = named.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
        rows = saved(rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
        kept = minmax_dedup.near_duplicates(rows, id_col="row").where("kept").select(F.col("doc_id").alias("kept_row"))
        left = rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi").select(*COLUMNS)
    return left.unionByName(unnamed)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that start in more than one place."""
    docs = docs.select(*COLUMNS)
    cut = repeat_dedup.remove_repeats(docs).select("id", "x", "kept_text")
    joined = docs.select(*COLUMNS, *repeat_dedup.text_key(docs)).join(cut, ["id", "x"], "left")
    text = F.coalesce("kept_text", "text")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, neighbours along the curve together."""
    ranks = ranks_from_json(public_tokenizers.path("byte_bpe_50k.json"))
    return curve_packing.pack(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: No SQL: three stages learn, hash or tokenise. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    at: list[str] = []
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/siftmail-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, at)  # the stage before is read no more
        at = [path]
        docs = spark.read.parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    own(at + _before.tables)  # what the result reads is the caller's
    _before.tables = []
    return out
