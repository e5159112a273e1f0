"""Merkle manifest of a data set: a tree for each group of rows, a tree over the groups' roots, proofs of membership.

A node is a sha-256 digest; a parent is that of its children's digests as lowercase hex text, one after another. In
each group leaves ascend by id; every ``ARITY`` consecutive nodes have one parent, the last run may be shorter, and so
on until one node, the group's subroot, is left. The subroots, ordered by group, make the root in the same way.

Building is event-driven, by ``combineByKey``:

1. Leaves are range-sorted by (group, id, digest) and numbered within their group. A range holds the end of one group
   and whole groups after it, so one row a range (its first and its last group) tells where its first group goes on.
   The last leaf of a group is marked: it tells the size, and so the arity of the parents at the right edge.
2. The key of a leaf is its block, ``ARITY ** height`` consecutive leaves of a group. The combiner, a ``Forest``, holds
   partial parents that accumulate children by place. When a parent has the number of children that the size gives it,
   its digest goes as an event to its own parent, in the same combiner: on the map side for what is in one partition,
   after the shuffle for what wasn't resolved there. Forests of one block merge in any order. A group of any size is
   dealt over blocks, so no task holds more than its share.
3. A block's top node is what isn't resolved: the tops are the leaves of the next round, ``height`` levels higher, until
   each group has one node. At height 6 four rounds reach 10^11 leaves.

Proofs go the reverse way: each round's blocks are joined with the paths of their tops from the round above; a block's
forest links each node to its siblings, and the path of a member is its siblings, level by level, then those of its
block's top. A path holds the node's place among its siblings at each level, so a root can be folded from any leaf.

Rows whose fields are null have ``-`` in their place in the digest. Null groups come first, null ids come first in
their group. Rows with one id ascend by digest; repeated rows are leaves each. Other columns are ignored. A group
of one row has its leaf as subroot; one group has its subroot as root. An empty table has no nodes and no root.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ARITY, LEVELS = 3, 6


def parent_of(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(map(bytes.hex, children)).encode()).digest()


class Forest:
    """Partial parents over the members of one block; the combiner of ``combineByKey``.

    ``open`` has the children, by place, of parents that aren't resolved; ``edge`` the parents whose last child has
    come. A parent is resolved by its event: the child that makes its arity full."""

    __slots__ = ("edge", "last", "levels", "members", "open", "top")

    def __init__(self, levels: int = LEVELS):
        self.levels = levels
        self.members: list[tuple[int, bytes, object]] = []  # place, digest, what travels with it
        self.open: dict[tuple[int, int], dict[int, bytes]] = {}
        self.edge: dict[tuple[int, int], int] = {}
        self.top: bytes | None = None
        self.last = False

    def add(self, member: tuple) -> Forest:
        place, digest, last, payload = member
        self.members.append((place, digest, payload))
        self.last = self.last or last
        self._child(0, place, digest, last)
        return self

    def merge(self, other: Forest) -> Forest:
        self.members += other.members
        self.last = self.last or other.last
        self.top = self.top or other.top
        edges = self.edge | other.edge
        for (level, at), children in other.open.items():
            for i, digest in children.items():
                self._child(level, at * ARITY + i, digest, edges.get((level, at)) == i + 1)
        return self

    def _child(self, level: int, place: int, digest: bytes, last: bool) -> None:
        """The node ``place`` of ``level`` is there; ``last`` if it is the group's last of that level."""
        while level < self.levels and (place or not last):
            key = (level, place // ARITY)
            children = self.open.setdefault(key, {})
            children[place % ARITY] = digest
            if last:
                self.edge[key] = place % ARITY + 1
            if len(children) < self.edge.get(key, ARITY):
                return
            last = key in self.edge
            digest = parent_of([children[i] for i in range(len(children))])
            del self.open[key]
            self.edge.pop(key, None)
            level, place = level + 1, place // ARITY
        self.top = digest  # of the block, or of the whole group

    def paths(self) -> Iterator[tuple[bytes, bytes, object]]:
        """Digest, path to the top, and payload of each member. The reverse links: levels are rebuilt from the members,
        which lie gapless from the block's begin, or are the last of their group."""
        members = sorted(self.members, key=lambda m: m[0])
        if not members:
            return
        first = members[0][0]
        row, levels = [m[1] for m in members], []
        whole = first == 0 and self.last  # the block is the whole group
        while len(levels) < self.levels and not (whole and len(row) == 1):
            levels.append(row)
            row = [parent_of(row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
        for at, (_, digest, payload) in enumerate(members):
            path = bytearray()
            for row in levels:
                a = at - at % ARITY
                others = row[a:at] + row[at + 1 : a + ARITY]
                path += bytes([at % ARITY, len(others)]) + b"".join(others)
                at //= ARITY
            yield digest, bytes(path), payload


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place and siblings, level by level."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings make."""
    for place, others in steps(path):
        leaf = parent_of([*others[:place], leaf, *others[place:]])
    return leaf


def field(c: Column) -> Column:
    """UTF-8 byte count, ``:`` and value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """Binary sha-256 of the fields in a row."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, digest, ...) of a sorted range with part, pos (in the range), run_pos (in the group's run there), first
    (in the range's first group) and last (followed by another group here)."""
    part, pos, run, grp, is_first = TaskContext.get().partitionId(), 0, 0, None, True
    held: tuple[list, pa.RecordBatch] | None = None  # the row before the next batch waits for it
    for batch in batches:
        groups = batch.column("grp").to_pylist()
        made: list[tuple[int, int, bool]] = []
        for g in groups:
            if g != grp:
                is_first = grp is None
                grp, run = g, 0
            made.append((pos, run, is_first))
            pos, run = pos + 1, run + 1
        if not groups:
            continue
        if held:
            yield from _finished(held, groups[0], part)
        held = (made, batch)
    if held:
        yield from _finished(held, held[1].column("grp")[-1].as_py(), part)  # the caller knows what follows the range


def _finished(held: tuple[list, pa.RecordBatch], follows: str, part: int) -> Iterator[pa.RecordBatch]:
    made, batch = held
    groups = [*batch.column("grp").to_pylist(), follows]
    last = [a != b for a, b in zip(groups[:-1], groups[1:], strict=True)]
    cols = {
        "part": pa.array([part] * len(made), pa.int64()), "pos": pa.array([m[0] for m in made], pa.int64()), "run_pos": pa.array([m[1] for m in made], pa.int64()),
        "first": pa.array([m[2] for m in made]), "last": pa.array(last),
    }
    yield pa.RecordBatch.from_arrays([*batch.columns, *cols.values()], [*batch.schema.names, *cols])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp string without nulls, digest, ...) with ``place`` in their group by ``order`` and ``last``. Sorted by
    ranges; one row a range goes over the driver."""
    made = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    keys = ["grp", *order, "uid"]
    extra = "part long, pos long, run_pos long, first boolean, last boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = made.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid").mapInArrow(_numbered, f"{schema}, {extra}")
    placed = saved(ranged, "placed")
    ends = placed.groupBy("part").agg(
        F.min_by("grp", "pos").alias("a"), F.max_by("grp", "pos").alias("b"), F.max_by("run_pos", "pos").alias("at"), F.count_if("first").alias("n"), F.max("pos").alias("end"),
    )
    ranges = sorted((r.asDict() for r in ends.collect()), key=lambda r: r["part"])
    out, grp, count = [], None, 0
    for i, r in enumerate(ranges):
        base = count if r["a"] == grp else 0
        grp, count = r["b"], (base if r["a"] == r["b"] else 0) + r["at"] + 1
        ends_here = i + 1 == len(ranges) or ranges[i + 1]["a"] != grp
        out.append((r["part"], base, r["end"], ends_here))
    bases = rows.sparkSession.createDataFrame(out, "part long, base long, end long, ends_here boolean")
    place = F.col("run_pos") + F.when(F.col("first"), F.col("base")).otherwise(0)
    last = F.col("last") | ((F.col("pos") == F.col("end")) & F.col("ends_here"))
    return placed.join(F.broadcast(bases), "part").select(*rows.columns, place.alias("place"), last.alias("last"))


def _deal(key: tuple[str, int]) -> int:
    return zlib.crc32(f"{key[1]}:{key[0]}".encode())


BLOCK = "grp string, block long, last boolean, top binary, places array<long>, digests array<binary>, payloads array<string>"


def blocks(leaves: DataFrame, height: int) -> DataFrame:
    """One row a block of ``leaves`` (grp, place, digest, last, payload string): its top node and its members."""
    size = ARITY**height
    keyed = leaves.select("grp", "place", "digest", "last", "payload").rdd.map(lambda r: ((r[0], r[1] // size), (r[1], bytes(r[2]), r[3], r[4])))
    made = keyed.combineByKey(lambda m: Forest(height).add(m), Forest.add, Forest.merge, partitionFunc=_deal)

    def row(item):
        (grp, block), f = item
        members = sorted(f.members, key=lambda m: m[0])
        return grp, block, f.last, f.top, [m[0] for m in members], [m[1] for m in members], [m[2] for m in members]

    return saved(leaves.sparkSession.createDataFrame(made.map(row), BLOCK, verifySchema=False), "blocks")


PATHS = "grp string, payload string, digest binary, path binary, subroot binary, root binary"


def _paths_within(rows: DataFrame, height: int) -> DataFrame:
    """One row a member of ``rows``: blocks with the path, the subroot and the root of their top."""
    kinds = pa.schema([(n, pa.string()) for n in ("grp", "payload")] + [(n, pa.binary()) for n in ("digest", "path", "subroot", "root")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in kinds.names}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                f = Forest(height)
                f.members, f.last = list(zip(row["places"], row["digests"], row["payloads"], strict=True)), row["last"]
                for digest, path, payload in f.paths():
                    for n, v in zip(out, (row["grp"], payload, digest, path + row["path"], row["subroot"], row["root"]), strict=True):
                        out[n].append(v)
                if len(out["grp"]) > 4000:
                    yield pa.RecordBatch.from_pydict(out, kinds)
                    out = {n: [] for n in out}
        if out["grp"]:
            yield pa.RecordBatch.from_pydict(out, kinds)

    return rows.mapInArrow(run, PATHS)


#: The group is one block.
ALONE = "block = 0 AND last"


def grown(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of each round over ``leaves`` (grp, place, digest, last, payload), until each group has one node."""
    rounds = [blocks(leaves, height)]
    while not (rest := rounds[-1].where(f"NOT ({ALONE})")).isEmpty():
        place = F.col("block")
        rounds.append(blocks(rest.select("grp", place.alias("place"), F.col("top").alias("digest"), "last", place.cast("string").alias("payload")), height))
    return rounds


def subroots_of(rounds: list[DataFrame]) -> DataFrame:
    """grp and digest of each group's one node."""
    each = [made.where(ALONE).select("grp", F.col("top").alias("digest")) for made in rounds]
    return functools.reduce(DataFrame.unionByName, each)


def paths_of(rounds: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """grp, payload, digest, path, subroot, root of each leaf; ``tops`` (grp, path, subroot, root) has what is above the
    groups' subroots. Whole blocks are joined, before their members are rows."""
    above = None
    for made in reversed(rounds):
        rows = made.where(ALONE).join(tops, "grp")
        if above is not None:
            own = above.select("grp", F.col("payload").cast("long").alias("block"), "path", "subroot", "root")
            rows = rows.unionByName(made.where(f"NOT ({ALONE})").join(own, ["grp", "block"]))
        above = _paths_within(rows.select("grp", "last", "places", "digests", "payloads", "path", "subroot", "root"), height)
    return above


def manifest(rows: DataFrame, order: list[str], *, height: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees of ``rows`` (grp: a string or null, digest, payload string, and the columns of ``order``):

    * groups: grp, subroot, root, path (of the subroot to the root);
    * leaves: grp, payload, digest, path (to the root), subroot, root.
    """
    # text order is kept, null comes before every name
    named = F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))
    rounds = grown(numbered(rows.withColumn("grp", named), [*order, "digest"]), height)
    subroots = subroots_of(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("payload"), "digest")
    upper = grown(numbered(subroots, ["payload"]), height)
    end = subroots_of(upper).select("grp", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = saved(paths_of(upper, end, height).select(F.col("payload").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    plain = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("grp")
    return tops.select(plain, "subroot", "root", "path"), paths_of(rounds, tops, height).select(plain, "payload", "digest", "path", "subroot", "root")


PROOFS = "grp string, payload string, digest binary, subroot binary, root binary, proof_sha256 string, folded binary"


def folded(leaves: DataFrame, presented: str) -> DataFrame:
    """The leaves of ``manifest`` with proof_sha256 (of the siblings as hex text, level by level) and ``folded``: the root
    that the digest in column ``presented`` makes with the leaf's siblings."""
    names = ["grp", "payload", "digest", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof, root = [], []
            for path, leaf in zip(batch.column("path").to_pylist(), batch.column("presented").to_pylist(), strict=True):
                proof.append(hashlib.sha256("".join(x.hex() for _, others in steps(path) for x in others).encode()).hexdigest())
                root.append(fold(leaf, path))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(proof, pa.string()), pa.array(root, pa.binary())], [*names, "proof_sha256", "folded"])

    return leaves.select(*names, "path", F.col(presented).alias("presented")).mapInArrow(run, PROOFS)
