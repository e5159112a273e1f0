"""What the operators of this subpackage share: inputs, scratch tables, folds."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go if the session names no shared folder and all of Spark is on one machine, as in tests.
LOCAL_SCRATCH = "/tmp/siftmail-checkpoints"


class _Own(threading.local):
    """The scratch tables of one thread's work, so that runs side by side don't release each other's."""

    def __init__(self):
        self.written: list[str] = []


_own = _Own()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local session may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or LOCAL_SCRATCH


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps restart from files that
    outlive any executor, and nothing upstream is computed twice. ``by``: a column of few values; a filter on it reads
    the files of these values only."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftmail-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _own.written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many scratch tables there are so far: a mark for ``release``."""
    return len(_own.written)


def taken(since: int) -> list[str]:
    """The scratch tables written after the mark; they are the caller's to release."""
    own = _own.written[since:]
    del _own.written[since:]
    return own


def own(tables: list[str]) -> None:
    """The tables are this thread's to release again."""
    _own.written.extend(tables)


def read_by(df: DataFrame, tables: list[str]) -> set[str]:
    """Those of the scratch tables that ``df`` reads."""
    names = {t.rsplit("/", 1)[-1]: t for t in tables}
    return {names[part] for f in df.inputFiles() for part in f.split("/") if part in names} if tables else set()


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete scratch tables. Call it only when no frame still reads one of them."""
    for path in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete the scratch tables of this thread that the frames read; nothing reads them any more."""
    for df in frames:
        gone = read_by(df, _own.written)
        release(df.sparkSession, sorted(gone))
        _own.written = [t for t in _own.written if t not in gone]


#: Characters of text that are taken apart together; longer texts go in segments.
SEGMENT = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = 0) -> Iterator[str]:
    """A text in runs of about ``size`` characters, cut before single spaces, where words and pre-tokens end anyway."""
    size = size or SEGMENT
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end; write results out before."""
    mark = written()
    try:
        yield
    finally:
        release(spark, taken(mark))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
