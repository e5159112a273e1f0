"""The manifest against trees built level by level in plain Python."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siftmail.llm import merkle_manifest as M
from siftmail.llm.queries_merkle_manifest import op11_merkle_manifest

from .conftest import DOCS


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and for each leaf its siblings and places, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 3 : a - a % 3 + 3]
            paths[i].append((a % 3, run[: a % 3] + run[a % 3 + 1 :]))
            at[i] = a // 3
        nodes = [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def brute(docs):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in docs:
        tampered = text if text is None or zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 else text.replace("\n", "")
        row = [(doc_id, source, lang, n, t) for t in (text, tampered)]
        groups[source].append((doc_id is not None, doc_id or 0, leaf_of(row[0]), leaf_of(row[1]), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda r: r[:3])
        built[s] = tree([r[2] for r in groups[s]])
    root, above = tree([built[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for r, path in zip(groups[s], built[s][1]):
            folded = r[3]
            for place, others in path + up:
                folded = h([*others[:place], folded, *others[place:]])
            out.append((r[4], r[2], built[s][0], root, h(x for _, others in path + up for x in others), folded, folded == root))
    return sorted(map(repr, out))


def got(spark, path, docs, height=M.LEVELS, parts=4):
    spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("grp", "payload", "digest", "place", "block", "last", "uid", "part", "path", "root")}).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return sorted(repr(tuple(r)) for r in op11_merkle_manifest(spark, str(path), height).collect())


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("height", "sizes"), [(6, {"a": 1000, "b": 729, None: 1, "": 2, "ß": 9, "=": 3}), (1, {"a": 200, "b": 27, None: 28, "": 1, "é": 2, "z": 3}), (2, {"only": 300}), (6, {"only": 1}), (2, {f"s{i}": 1 + i % 4 for i in range(40)})])
def test_equals_trees(spark, tmp_path, many_ranges, height, sizes):
    docs = [(1000 * k + i, f"text {i}\n of {s}\n" if i % 3 else None, "en" if i % 2 else None, s, i if i % 5 else None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(1).shuffle(docs)
    assert got(spark, tmp_path, docs, height) == brute(docs)


def test_odd_rows(spark, tmp_path, many_ranges):
    """Null ids and fields, repeated rows, one id with several texts, line ends in all forms, a long text."""
    docs = [(None, None, None, None, None), (None, "a\n", "en", "s", 1), (None, "a\n", "en", "s", 1), (7, "x", None, "s", 3), (7, "y", None, "s", 3), (7, "x", None, "s", 3), (8, "", "", "", 0), (-9, "\n\r\n é日", "fr", "s", 5), (10, "long \n" * 300_000, "en", "s", 1)]
    docs += [(100 + i, "copy\n", "en", "hot", 4) for i in range(50)] + [(5, "copy\n", "en", "hot", 4)] * 20
    assert got(spark, tmp_path, docs) == brute(docs)


@pytest.mark.parametrize("seed", range(6))
def test_forests_merge_in_any_order(seed):
    """Members dealt over forests at random, merged at random: the top node, and nothing left open."""
    rng = random.Random(seed)
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 242, 243, 700, 729]:
        digests = [sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        members = [(i, d, i == n - 1, str(i)) for i, d in enumerate(digests)]
        rng.shuffle(members)
        forests = []
        for m in members:
            if forests and rng.random() < 0.8:
                rng.choice(forests).add(m)
            else:
                forests.append(M.Forest().add(m))
        while len(forests) > 1:
            a = forests.pop(rng.randrange(len(forests)))
            forests[rng.randrange(len(forests))].merge(a)
        root, _ = tree([d.hex() for d in digests])
        f = forests[0]
        assert f.top.hex() == root and not f.open and not f.edge and f.last
        assert all(M.fold(d, path) == f.top and d == digests[int(p)] for d, path, p in f.paths())


def test_events_on_the_map_side():
    """A run of members leaves only the parents at its two borders open."""
    f = M.Forest()
    for i in range(100, 700):
        f.add((i, sha256(str(i).encode()).digest(), False, ""))
    assert len(f.open) <= 2 * M.LEVELS


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_merkle_manifest(spark, str(tmp_path)).count() == 0
