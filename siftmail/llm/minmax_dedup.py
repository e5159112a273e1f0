"""Near-duplicate documents by min-max hashing, confirmed on the full shingle sets.

Signature. Each of ``perms`` hash permutations of a set gives two values, its minimum and its maximum: half the
hash evaluations of plain minhashing for the same number of values, each matching with probability J as before, and
the two of a permutation slightly anti-correlated, which lowers the variance of their mean. ``rows`` values make a
band; sets that share a band are candidates. With 48 permutations and 4 rows there are 24 bands, and a pair of
similarity 0.8 shares none with probability (1 - 0.8^4)^24 = 3e-6.

Links. 1. Equal sets form classes (aggregation by a 128-bit hash of the set); one document stands for a class, and
copies are never paired. 2. Each class is compared with the smallest class that it shares a band with; confirmed
links are joined into components. 3. All members of band buckets that still hold several components are compared
across components by an exact prefix filter on their shingles, rarest first, and components joined again. A pair is
left out only if its members are already connected or if sizes or prefixes exclude the similarity, so the components
are those of all links between candidates. Buckets of any size take part, nothing is capped, and members of one
component are never paired.

Skew. Copies and bucket minima are aggregated before they move; joins on a hot class, bucket or root read plain
tables on both sides, so that AQE splits them.

Null text and texts without words have an empty set: linked with nothing. Rows with one id are one document (the
same component; if their texts differ, it is compared by the set whose bytes come first). A null id can't name a component: such rows have component_id null and are kept. Other columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .shingles import WordHashes, mixed, shingle_set

#: Ratio of the size classes in which candidate partners are sought.
STEP = 1.04


def min_max(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, in turn: 2 * perms values."""
    low, high = np.full(len(mul), ~np.uint64(0)), np.zeros(len(mul), np.uint64)
    for i in range(0, len(hashes), 4096):
        x = hashes[None, i : i + 4096] * mul[:, None] + add[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.stack([low, high], 1).ravel()


def permutations(perms: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, perms, np.uint64)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash a band, its number included. A band holds minima or maxima of different permutations."""
    v = np.concatenate([signature[::2], signature[1::2]])
    v = v[: len(v) // rows * rows].reshape(-1, rows)
    h = np.arange(1, len(v) + 1, dtype=np.uint64)
    for k in range(rows):
        h = mixed(h) + v[:, k]
    return mixed(h)


def signatures(docs: DataFrame, *, shingle: int, perms: int, rows: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n (set size), h1 and h2 (hash of the set), bands: one row per row of ``docs``, in one scan."""
    mul, add = permutations(perms)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            n, h1, h2, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), cache, shingle)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((h >> 64) - (1 << 63))
                h2.append((h & ((1 << 64) - 1)) - (1 << 63))
                bands.append(bands_of(min_max(s, mul, add), rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            lengths = np.array([0, *map(len, bands)]).cumsum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))],
                ["doc_id", "n", "h1", "h2", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, *, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """node, shingles (sorted 64-bit hashes): the sets of the documents whose ids are in ``wanted``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = pa.array((shingle_set(t.as_py(), cache, shingle).tobytes() for t in batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    return own.join(wanted, "node", "left_semi").mapInArrow(make, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_a, of_b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it is connected with), for the nodes of ``edges`` (a, b). Labels spread along the
    edges and then jump to their label's label; each round is written, so no round depends on an executor's memory."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("u", "v"), "edges")
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("least"))
        step = saved(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label")), "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = saved(step.join(up, "label").select("node", "was", F.least("label", "top").alias("label")), "labels")
        if new.where("was <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _elements(sets: DataFrame) -> DataFrame:
    """node, g: one row per shingle of each set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.frombuffer(x.as_py(), np.int64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], ["node", "g"])

    return sets.mapInArrow(spread, "node long, g long")


def _cross_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be linked, among the members of buckets of several components.
    ``buckets``: bucket, node, n, label.

    Linked sets of sizes n and m share at least need = p (n + m) / (100 + p) shingles, so the two share one of the
    first n - need + 1 and m - need + 1 of their own in any common order. The order is by number of sets that hold the
    shingle, rarest first: what only one set holds comes first and meets nobody, and a set with too much of its own
    drops out. A set takes part once for each class of partner sizes (powers of STEP), so that need is close. Every
    pair of components at a shingle has a side outside its largest component, so only those are matched with all."""
    split = buckets.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    nodes = saved(buckets.join(split, "bucket", "left_semi").select("node", "n", "label").distinct(), "mixed")
    own = saved(_elements(sets.join(nodes.select("node"), "node", "left_semi").select("node", "shingles")), "elements")
    held = saved(own.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "held")
    lists = own.join(held, "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("common"))
    n, p = F.col("n"), percent
    size_class = F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP)))
    reach = math.ceil(math.log(100 / p) / math.log(STEP)) + 1
    smallest = F.greatest(F.floor(F.pow(F.lit(STEP), F.col("d"))), F.ceil(p * n / 100))  # partner of the class
    need = F.ceil(p * (n + smallest) / (100 + p) - 1e-6)
    left = (n - need + 1 - (n - F.size("common"))).cast("int")  # the unshared stand first
    heads = lists.join(nodes, "node").withColumn("c", size_class).withColumn("d", F.explode(F.sequence(F.col("c") - reach, F.col("c") + reach)))
    heads = heads.where((F.pow(F.lit(STEP), F.col("d") + 1) * 100 >= p * n) & (smallest * p <= 100 * n) & (left > 0))
    heads = heads.select("node", "n", "label", "c", "d", F.explode(F.slice("common", F.lit(1), F.greatest(left, F.lit(1)))).alias("e"))
    heads = saved(heads.select("node", "n", "label", "c", "d", F.col("e.g").alias("g")), "heads")
    key = [F.col("g"), F.least("c", "d").alias("s"), F.greatest("c", "d").alias("t")]
    sizes = heads.select(*key, "label").groupBy("g", "s", "t", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = saved(sizes.groupBy("g", "s", "t").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("g", "s", "t", "major"), "largest")
    x = heads.select(*key, F.col("c").alias("cx"), F.col("d").alias("dx"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")).join(largest, ["g", "s", "t"]).where("la <> major").drop("major")
    y = heads.select(*key, F.col("c").alias("cy"), F.col("d").alias("dy"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    fits = (F.col("la") != F.col("lb")) & (F.col("cx") == F.col("dy")) & (F.col("cy") == F.col("dx")) & (100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))
    return saved(x, "minor").join(y, ["g", "s", "t"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, perms: int = 48, rows: int = 4, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id connected, its own included), kept (it is that id): one row per
    row of ``docs``."""
    signed = saved(signatures(docs, shingle=shingle, perms=perms, rows=rows, text_col=text_col, id_col=id_col), "signatures")
    named = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = saved(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("size")), "classes")
    # ids of several texts tie their classes together
    same_id = named.select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "node"), ["h1", "h2"]).where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")

    placed = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = saved(placed.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", "first"), "buckets")
    members = saved(placed.join(shared, "bucket"), "members")

    star = members.where("node <> first").groupBy("node").agg(F.min("first").alias("b")).select(F.col("node").alias("a"), "b")
    star = saved(star, "star")
    sets = saved(_sets(docs, members.select("node").distinct(), shingle=shingle, text_col=text_col, id_col=id_col).groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")
    links = saved(confirmed(star, sets, percent).union(same_id), "links")
    labels = components(links)

    known = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = saved(_cross_pairs(known, sets, percent).join(tested, ["a", "b"], "left_anti"), "rest")
    more = saved(confirmed(rest, sets, percent), "links")
    labels = components(links.union(more))

    found = saved(classes.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("component")), "found")
    out = signed.select("doc_id", "n", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
