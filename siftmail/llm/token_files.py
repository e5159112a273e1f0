"""Token ids as flat binary files that a trainer memory-maps, and back.

A data set is a folder of shards and a ``manifest.json``. A shard is three flat little-endian files:

* ``.bin``: the ids of its documents one after another, unsigned, 16 bits each if the vocabulary allows, else 32;
* ``.off``: unsigned 64-bit offsets into these ids, one more than documents;
* ``.doc``: signed 64-bit document ids, in ascending order. Null ids come first; the manifest says how many there are.

Shards hold ranges of documents: the manifest lists them in order, each with the number of documents and ids before it
(prefix sums over one row a shard), so a global offset is a shard's base plus the offset in it.

Writing: texts move once, range-sorted by document id (a hot id is dealt over ranges), and the task that encodes a range
writes it as a shard, under a name of its own, and reports it. Only shards that a finished task reports enter the
manifest, which is written last, so that a lost executor or a second attempt leaves no trace but files that ``commit``
deletes. The folder may be in any store that pyarrow opens by its URI; no task holds more than one batch of rows.

Reading: ``read_tokens`` gives a table, runs of documents dealt over tasks; ``TokenFiles`` gives random access to
documents and to any run of the global stream. Both map a local or mounted file into memory and read the ranges they
need from other stores.

Null text counts as empty: its document is the end id alone. Rows with one id and several texts stand side by side;
repeated rows are written each. Other columns are ignored. An empty table makes a manifest without shards.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that a normaliser to composed form leaves alone and that are letters in any case; one word, whatever stands
# around it. (Left out: the dotted capital I and the long s, which change class or meet other letters when lowered.)
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_BLANK = "\t-\r "
_PIECES = re.compile(rf"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|[{_LETTERS}]+|[0-9]|[^{_BLANK}0-9{_LETTERS}]+")
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
_WORD = re.compile(rf"[^{_BLANK}]+")


def word_pieces(text: str) -> list[str]:
    """Runs of ``text`` that the word tokenizer encodes independently of each other: its own pre-tokens where only
    common letters occur, whole words elsewhere."""
    if _PLAIN.fullmatch(text):
        return _PIECES.findall(text)
    return [p for w in _WORD.findall(text) for p in (_PIECES.findall(w) if _PLAIN.fullmatch(w) else [w])]


#: What a task knows of a tokenizer: ids by piece. Forgotten between two texts when it holds so many pieces or characters.
MOST_PIECES, MOST_CHARS = 1_000_000, 30_000_000
_known: dict[int, WordEncoder] = {}


def byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as it is, the others by signs from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids by piece; a tokenizer of the ``tokenizers`` library (its json) is asked for each piece that isn't known yet: its
    model alone for a piece of common letters, as lower case and the signs of bytes are all that comes before."""

    def __init__(self, spec: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.chars = Tokenizer.from_str(spec), kind, 0
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.signs = self.tokenizer.model, byte_signs()

    def __missing__(self, piece: str) -> bytes:
        self.chars += len(piece)
        if _PLAIN.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(piece.lower().encode().decode("latin-1").translate(self.signs))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self[piece] = out = np.array(ids, self.kind).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > MOST_PIECES or self.chars > MOST_CHARS:
            self.clear()
            self.chars = 0
        return b"".join(map(self.__getitem__, word_pieces(text)))


def _encoder(spec: str, kind: str) -> WordEncoder:
    key = hash((spec, kind))
    if key not in _known:
        _known.clear()
        _known[key] = WordEncoder(spec, kind)
    return _known[key]


def kind_for(spec: str, end_id: int) -> str:
    """The width that all ids of a tokenizer (its json) and ``end_id`` fit."""
    vocabulary = json.loads(spec)
    return "<u2" if max([end_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary["added_tokens"])]) < 1 << 16 else "<u4"


def _tokenised(sent, kind: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = _encoder(sent.value, kind), np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((e.encode(t.as_py() or "") + end for t in part.column(1)), pa.binary())], ["doc_id", "ids"])

    return run


def word_tokens(docs: DataFrame, spec: str, *, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids of each row: the text's ids by a word tokenizer (its json), then ``end_id``."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_tokenised(sent, kind_for(spec, end_id), end_id), "doc_id long, ids binary")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store, path


def _shard_writer(uri: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the rows (doc_id, ids) of a task, in their order, as one shard; reports it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, store, docs, tokens, nulls = TaskContext.get().partitionId(), None, None, 0, 0, 0
        out: list = []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if name is None:
                    store, path = _place(uri)
                    name = f"shard-{part:06d}-{uuid.uuid4().hex}"
                    out = [store.open_output_stream(f"{path}/{name}.{end}") for end in ("bin", "off", "doc")]
                    out[1].write(np.zeros(1, "<u8").tobytes())
                raw = batch.column("ids")
                for ids in raw:
                    out[0].write(ids.as_buffer())
                n = np.array([ids.as_buffer().size // size for ids in raw], "<u8")
                out[1].write((tokens + np.cumsum(n)).astype("<u8").tobytes())
                ids = batch.column("doc_id")
                out[2].write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                docs, tokens, nulls = docs + batch.num_rows, tokens + int(n.sum()), nulls + ids.null_count
        finally:
            for f in out:
                f.close()
        if name is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [docs], "tokens": [tokens], "nulls": [nulls]})

    return write


REPORT = "part long, name string, docs long, tokens long, nulls long"


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, a value) by ranges of ids. A hot id is dealt over ranges by the partition that its rows come from,
    which a second attempt finds alike; in a range, rows of one id and partition ascend by a hash."""
    value = rows.columns[1]
    keyed = rows.withColumn("_from", F.spark_partition_id())
    return keyed.repartitionByRange("doc_id", "_from").sortWithinPartitions("doc_id", "_from", F.xxhash64(value)).select("doc_id", value)


def write_tokens(tokens: DataFrame, uri: str, *, kind: str, end_id: int | None = None) -> dict:
    """Rows (doc_id, ids) as a data set in the empty or new folder ``uri``; returns its manifest."""
    return _written(_ranged(tokens.select("doc_id", "ids")).mapInArrow(_shard_writer(uri, int(kind[2])), REPORT), uri, kind, end_id)


def write_words(docs: DataFrame, spec: str, uri: str, *, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> dict:
    """The word tokens of ``docs`` as a data set. Texts are sorted, not ids: the task that encodes a text writes it."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(spec), kind_for(spec, end_id)
    encode, write = _tokenised(sent, kind, end_id), _shard_writer(uri, int(kind[2]))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _written(_ranged(own).mapInArrow(lambda batches: write(encode(batches)), REPORT), uri, kind, end_id)


def _written(reports: DataFrame, uri: str, kind: str, end_id: int | None) -> dict:
    store, path = _place(uri)
    store.create_dir(path, recursive=True)
    return commit(uri, [r.asDict() for r in reports.collect()], kind=kind, end_id=end_id)  # one row a shard


def commit(uri: str, reports: list[dict], *, kind: str, end_id: int | None) -> dict:
    """The manifest of the reported shards, bases by prefix sums; what other attempts left in the folder goes."""
    store, path = _place(uri)
    shards, docs, tokens = [], 0, 0
    for r in sorted(reports, key=lambda r: r["part"]):
        shards.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "nulls": r["nulls"], "doc_base": docs, "token_base": tokens})
        docs, tokens = docs + r["docs"], tokens + r["tokens"]
    manifest = {"kind": kind, "end_id": end_id, "docs": docs, "tokens": tokens, "shards": shards}
    with store.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    good = {s["name"] for s in shards}
    for f in store.get_file_info(fs.FileSelector(path)):
        if f.base_name.startswith("shard-") and f.base_name.split(".")[0] not in good:
            store.delete_file(f.path)
    return manifest


def manifest_of(uri: str) -> dict:
    store, path = _place(uri)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class _Flat:
    """Numbers of one flat file by position: mapped into memory where the file is local, else read by range."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str):
        self.kind, self.size = kind, np.dtype(kind).itemsize
        self.mapped = self.file = None
        if isinstance(store, fs.LocalFileSystem):
            empty = store.get_file_info(path).size == 0
            self.mapped = np.zeros(0, kind) if empty else np.memmap(path, kind, "r")
        else:
            self.file = store.open_input_file(path)

    def get(self, a: int, b: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[a:b]
        self.file.seek(a * self.size)
        return np.frombuffer(self.file.read((b - a) * self.size), self.kind)


class TokenFiles:
    """Random access to a data set: ``document(i)`` in ascending order of ids, ``tokens(a, b)`` of the whole stream."""

    def __init__(self, uri: str):
        self.manifest = manifest_of(uri)
        self.shards = self.manifest["shards"]
        self._where = _place(uri)
        self._open: dict[tuple[int, str], _Flat] = {}
        self._docs = [s["doc_base"] for s in self.shards]
        self._tokens = [s["token_base"] for s in self.shards]

    def flat(self, shard: int, end: str) -> _Flat:
        if (shard, end) not in self._open:
            store, path = self._where
            kind = {"bin": self.manifest["kind"], "off": "<u8", "doc": "<i8"}[end]
            self._open[shard, end] = _Flat(store, f"{path}/{self.shards[shard]['name']}.{end}", kind)
        return self._open[shard, end]

    def __len__(self) -> int:
        return self.manifest["docs"]

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Id, place in the whole stream, and ids of the i-th document."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        s = bisect_right(self._docs, i) - 1
        at = i - self._docs[s]
        a, b = map(int, self.flat(s, "off").get(at, at + 2))
        doc_id = None if at < self.shards[s]["nulls"] else int(self.flat(s, "doc").get(at, at + 1)[0])
        return doc_id, self._tokens[s] + a, self.flat(s, "bin").get(a, b)

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the whole stream, across documents and shards."""
        b, out = min(b, self.manifest["tokens"]), []
        while a < b:
            s = bisect_right(self._tokens, a) - 1
            base = self._tokens[s]
            end = min(b, base + self.shards[s]["tokens"])
            out.append(self.flat(s, "bin").get(a - base, end - base))
            a = end
        return np.concatenate(out) if out else np.zeros(0, self.manifest["kind"])


def read_tokens(spark: SparkSession, uri: str, *, run_docs: int = 20_000) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files;
    runs of at most ``run_docs`` documents are dealt over the tasks."""
    # a task a run; there are few runs beside documents
    runs = [(i, a, min(a + run_docs, s["docs"])) for i, s in enumerate(manifest_of(uri)["shards"]) for a in range(0, s["docs"], run_docs)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            files = files or TokenFiles(uri)
            for shard, first, last in (runs[i] for i in batch.column(0).to_pylist()):
                base, nulls = files.shards[shard]["token_base"], files.shards[shard]["nulls"]
                for a in range(first, last, 256):
                    b = min(last, a + 256)
                    off = files.flat(shard, "off").get(a, b + 1).astype(np.int64)
                    ids = files.flat(shard, "bin").get(int(off[0]), int(off[-1]))
                    at = off - off[0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(files.flat(shard, "doc").get(a, b).astype(np.int64), mask=np.arange(a, b) < nulls), pa.array(base + off[:-1]), pa.array(np.diff(off)),
                        pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    return spark.range(0, len(runs), 1, max(1, len(runs))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
