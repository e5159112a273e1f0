"""Mail files as a Spark data source: any number of files and mailboxes, planned by size, faults as rows.

``spark.read.format("mailfiles").load(path)`` has a row for each file with one of the ``extensions`` and for each message
of a mailbox (``mboxExtensions``: messages one after another, each behind a line ``From ...`` that begins the file or
follows an empty line; ``>From`` at a line's begin has one ``>`` taken away). The driver lists paths and sizes; partitions
are cut so that each has about ``partitionBytes``: small files are packed in order of their paths, mailboxes are cut at
fixed offsets, and the messages that begin between two offsets belong to one partition. A task holds one message and
a batch of at most 8 MB and 1000 messages.

A file that can't be read (or a message too long for a value, 2 GB) is a row with ``read_error`` and no ``raw``; the
job goes on. Paths are opened by pyarrow, so any store that it knows by URI will do.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start long, size_bytes long, raw binary, read_error string"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size_bytes", pa.int64()), ("raw", pa.binary()), ("read_error", pa.string())])
#: What opening a file costs, in bytes read; what a batch holds, in bytes and rows; what a value can hold.
OPEN_COST, BATCH, BATCH_ROWS, LONGEST = 4096, 8 << 20, 1000, (1 << 31) - 1
_BLOCK = 1 << 20
_BORDER = re.compile(rb"\n\r?\nFrom ")
_QUOTED = re.compile(rb"(?m)^>(>*From )")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}")


@dataclass
class Piece:
    """A whole file, or of a mailbox the messages that begin in [first, last)."""

    path: str
    first: int
    last: int
    mailbox: bool


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)


def pieces_of(files: list[tuple[str, int, bool]], target: int) -> list[Piece]:
    """Files (path, size, whether it is a mailbox) in order, mailboxes in pieces of at most ``target`` bytes."""
    out = []
    for path, size, mailbox in sorted(files):
        cuts = [*range(0, size, target), size] if mailbox and size else [0, size]
        out += [Piece(path, a, b, mailbox) for a, b in pairwise(cuts)]
    return out


def packed(pieces: list[Piece], target: int) -> list[list[Piece]]:
    """Runs of pieces of about equal weight, as many as the whole has ``target`` bytes."""
    weights = [p.last - p.first + OPEN_COST for p in pieces]
    whole = sum(weights)
    n = max(1, -(-whole // target))
    out: list[list[Piece]] = [[] for _ in range(n)]
    at = 0
    for piece, w in zip(pieces, weights, strict=True):
        out[min(n - 1, (at + w // 2) * n // whole)].append(piece)
        at += w
    return [x for x in out if x]


def mailbox_messages(f, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the messages of a mailbox that begin in [first, last). Blocks are read as they are needed."""
    base = max(0, first - 3)  # a border before ``first`` may end there
    f.seek(base)
    held, ended = bytearray(), False

    def border(at: int) -> int | None:
        """The next line ``From `` at or behind the place ``at`` of what is held, reading on."""
        nonlocal ended
        if base + at == 0:
            while len(held) < 5 and not ended:
                more()
            if held.startswith(b"From "):
                return 0
        look = max(0, at - 3)
        while True:
            found = _BORDER.search(held, look)
            while found and found.end() - 5 < at:
                found = _BORDER.search(held, found.start() + 1)
            if found:
                return found.end() - 5
            if ended:
                return None
            look = max(look, len(held) - 8)
            more()

    def more() -> None:
        nonlocal ended
        block = f.read(_BLOCK)
        held.extend(block)
        ended = not block

    at = border(first - base)
    while at is not None and base + at < last:
        after = border(at + 5)
        content = bytes(held[at : len(held) if after is None else after])
        _, _, content = content.partition(b"\n")  # the line From itself
        if after is not None or content.endswith((b"\n\n", b"\n\r\n")):  # the empty line that ends a message is none of it
            content = content[: -2 if content.endswith(b"\r\n") else -1]
        yield base + at, _QUOTED.sub(rb"\1", content)
        if after is None:
            return
        del held[:after]
        base, at = base + after, 0


def listed(store: fs.FileSystem, path: str) -> Iterator[tuple[str, int, bool]]:
    """Path and size of all files below ``path``, or of the file that it is. Local folders that can't be listed are named as
    well (marked by True), and local links that lead nowhere: reading them will tell."""
    top = store.get_file_info(path)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == fs.FileType.File:
        yield path, top.size or 0, True
    elif isinstance(store, fs.LocalFileSystem):
        closed: list[OSError] = []
        for folder, _, names in os.walk(path, onerror=closed.append):
            for name in names:
                full = os.path.join(folder, name)
                yield full, os.path.getsize(full) if os.path.exists(full) else 0, False
        yield from ((e.filename, 0, True) for e in closed)
    else:
        yield from ((i.path, i.size or 0, False) for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type != fs.FileType.Directory)


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        names = lambda key, default: tuple("." + x.strip().lower() for x in options.get(key, default).split(",") if x.strip())
        self.single, self.mailboxes = names("extensions", "eml,txt"), names("mboxextensions", "mbox")
        self.target = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Pieces]:
        store, path = place(self.uri)
        ends = self.single + self.mailboxes
        files = [(p, size, p.lower().endswith(self.mailboxes)) for p, size, sure in listed(store, path) if sure or p.lower().endswith(ends)]
        return [Pieces(p) for p in packed(pieces_of(files, self.target), self.target)] if files else [Pieces([])]

    def _rows(self, pieces: list[Piece]) -> Iterator[tuple]:
        store, _ = place(self.uri)
        for p in pieces:
            try:
                if not p.mailbox and p.last > LONGEST:
                    raise ValueError(f"{p.last} bytes are more than a value can hold")
                with store.open_input_file(p.path) as f:
                    if not p.mailbox:
                        raw = f.read()
                        yield p.path, 0, len(raw), raw, None
                        continue
                    for start, raw in mailbox_messages(f, p.first, p.last):
                        if len(raw) > LONGEST:
                            yield p.path, start, len(raw), None, f"ValueError: {len(raw)} bytes are more than a value can hold"
                        else:
                            yield p.path, start, len(raw), raw, None
            except (OSError, ValueError) as e:
                yield p.path, p.first, None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition.value):
            if len(rows) == BATCH_ROWS or (rows and held + (row[2] or 0) > BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                rows, held = [], 0
            rows.append(row)
            held += (row[2] or 0) + 200
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class MailFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader({k.lower(): v for k, v in self.options.items()})


def read_mail(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of ``mailfiles`` below ``path``."""
    spark.dataSource.register(MailFiles)
    return spark.read.format("mailfiles").options(**options).load(path)


def write_mailboxes(messages: DataFrame, uri: str, raw: str = "raw") -> int:
    """The messages of a column as mailboxes in the empty or new folder ``uri``, one a partition, streamed; their number. A
    message that doesn't end with a line's end gets one.
    A mailbox has its name only once a finished task has reported it; what other attempts wrote goes."""
    store, path = place(uri)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, out = f"_{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None
        store, path = place(uri)
        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{path}/{name}")
                for x in batch.column(0):
                    content = re.sub(rb"(?m)^(>*From )", rb">\1", x.as_py() or b"")
                    out.write(b"From MAILER-DAEMON Thu Jan  1 00:00:00 1970\n" + content + (b"\n" if content.endswith(b"\n") else b"\n\n"))
                    n += 1
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    done = messages.select(F.col(raw).cast("binary").alias("raw")).mapInArrow(write, "name string, n long").collect()  # one row a mailbox
    for r in done:
        store.move(f"{path}/{r['name']}", f"{path}/part{r['name']}.mbox")
    for f in store.get_file_info(fs.FileSelector(path)):
        if f.base_name.startswith("_"):
            store.delete_file(f.path)
    return sum(r["n"] for r in done)
