"""Mail files: packing by size, mailboxes cut at any offset, faults as rows."""

import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmail.operators import report
from siftmail.operators.analyze import analyze
from siftmail.plans.envelopes import ENVELOPES
from siftmail.sources import mailfiles as M
from siftmail.sources.messages import read_messages


def test_a_thousand_files_one_of_which_cannot_be_read(spark, tmp_path):
    """A dangling link is a file that can't be read, for any user."""
    for i in range(999):
        folder = tmp_path / f"box{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"m{i:04d}.eml").write_bytes(ENVELOPES[i % len(ENVELOPES)].raw("some text " * (i % 50)))
    os.symlink(tmp_path / "gone", tmp_path / "box3" / "lost.eml")
    (tmp_path / "box1" / "notes.bin").write_bytes(b"x")
    mail = read_messages(spark, str(tmp_path), partition_bytes=200_000)
    rows = mail.withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == 1000 and [r["filename"] for r in rows if r["read_error"]] == ["lost.eml"] and len({r["message_id"] for r in rows if r["raw"] is None}) == 1
    sizes = {}
    for r in rows:
        sizes[r["p"]] = sizes.get(r["p"], 0) + (r["size_bytes"] or 0)
    assert len(sizes) >= 5 and max(sizes.values()) <= 2 * min(sizes.values())
    got = report.summary(analyze(mail)).where("parse_error IS NOT NULL").collect()
    assert [(r["filename"], r["verdict"], r["score"]) for r in got] == [("lost.eml", None, None)]


TEXTS = [b"A: b\n\nhello", b"", b"X: y\n\nFrom here\n>From there\n\nFrom the end", b"long " * 2000, b"\n\n\n", b"A: b\n\nx\n\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TEXTS), max_size=12), st.lists(st.integers(0, 30_000), max_size=4), st.sampled_from([b"\n", b"\r\n"]))
def test_mailboxes_cut_anywhere(texts, cuts, end):
    whole = [t if t.endswith(b"\n") else t + b"\n" for t in texts]
    box = b"".join(b"From a@b x\n" + M.re.sub(rb"(?m)^(>*From )", rb">\1", t) + b"\n" for t in whole).replace(b"\n", end)
    want = [t.replace(b"\n", end) for t in whole]
    edges = sorted({0, len(box), *(min(c, len(box)) for c in cuts)})
    got = [raw for a, b in zip(edges, edges[1:]) for _, raw in M.mailbox_messages(io.BytesIO(box), a, b)]
    assert got == want


def test_blocks_of_any_size(monkeypatch):
    box = b"".join(b"From a@b x\nA: %d\n\nbody %d\n\n" % (i, i) for i in range(300))
    want = [raw for _, raw in M.mailbox_messages(io.BytesIO(box), 0, len(box))]
    assert len(want) == 300 and want[7] == b"A: 7\n\nbody 7\n"
    for block in (1, 5, 64):
        monkeypatch.setattr(M, "_BLOCK", block)
        assert [raw for a in range(0, len(box), 97) for _, raw in M.mailbox_messages(io.BytesIO(box), a, min(len(box), a + 97))] == want


def test_packing():
    pieces = M.pieces_of([("b", 10_000_000, True), ("a", 50, False), ("c", 0, True), ("d", 9_000_000, False)], 1_000_000)
    assert [(p.path, p.first, p.last) for p in pieces][:3] == [("a", 0, 50), ("b", 0, 1_000_000), ("b", 1_000_000, 2_000_000)] and len(pieces) == 13
    runs = M.packed(pieces, 1_000_000)
    assert [p for r in runs for p in r] == pieces and max(sum(p.last - p.first for p in r) for r in runs[:-1]) <= 2_000_000
    assert M.packed(M.pieces_of([("a", 0, False)], 10), 10) and M.pieces_of([], 10) == []


def test_written_and_read_again(spark, tmp_path):
    raws = [e.raw("From me\n>From you") for e in ENVELOPES] + [b"", b"x"]
    uri = f"file://{tmp_path}/boxes"
    os.makedirs(tmp_path / "boxes")
    (tmp_path / "boxes" / "_000000-lost").write_bytes(b"half")
    assert M.write_mailboxes(spark.createDataFrame([(r,) for r in raws], "raw binary").repartition(3), uri) == len(raws)
    got = M.read_mail(spark, uri, partitionBytes="5000")
    assert got.rdd.getNumPartitions() > 10
    assert sorted(bytes(r["raw"]) for r in got.collect()) == sorted(r if r.endswith(b"\n") else r + b"\n" for r in raws)
    assert sorted(os.listdir(tmp_path / "boxes"))[0].startswith("part_") and read_messages(spark, uri).count() == len(raws)


def test_no_files(spark, tmp_path):
    assert read_messages(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        read_messages(spark, f"{tmp_path}/gone").count()


def test_batches_of_small_messages_are_bounded(tmp_path):
    """Tiny messages weigh more as Python objects than as bytes, so a batch is bounded by rows as well."""
    (tmp_path / "tiny.mbox").write_bytes(b"".join(b"From a@b x\nA: %d\n\n" % i for i in range(5000)))
    reader = M.MailReader({"path": str(tmp_path)})
    [part] = reader.partitions()
    own = [b.num_rows for b in reader.read(part)]
    assert sum(own) == 5000 and max(own) <= M.BATCH_ROWS
