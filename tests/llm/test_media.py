"""FLAC: exact round trips, hand-made streams of the other frame kinds, and faults."""

import hashlib
import zlib

import numpy as np
import pytest

from siftmail.llm import flac
from siftmail.llm.media import with_pcm
from siftmail.llm.queries_media import op6_flac_media

TEXTS = [None, "", "a", "x" * 64, "abc " * 3000, "é\n日本" * 900, "".join(map(chr, range(1, 900))), "a", "\0" * 100]


def payload(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 if b else 64)


def test_query(spark, docs_of, tmp_path):
    docs_of(TEXTS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op6_flac_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS, 1):
        p, r = payload(t), rows[i]
        media = flac.encode([p])[0]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len((t or "").encode()), len(p), len(media))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(p[-64:]) and r["error"] is None
        x = [b - 128 for b in p]  # 8-bit samples around zero, in frames of 4096
        want = {"frames": -(-len(x) // 4096), "samples": len(x), "min": min(x), "max": max(x), "sum": sum(x), "energy": sum(v * v for v in x), "crossings": sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}
        assert r["feature"] == ";".join(f"{k}={v}" for k, v in want.items())
    assert rows[3][1:] == rows[8][1:]


def test_faults_stay_in_their_row(spark):
    good = flac.encode([b"hello " * 2000])[0]
    bad = bytearray(good)
    bad[-500] ^= 1
    rows = [(1, good), (2, bytes(bad)), (3, b"no flac"), (4, None), (5, good[:200]), (6, b"")]
    got = {r["id"]: r for r in with_pcm(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1]["error"] is None and b"".join(b["pcm"] for b in got[1]["blocks"]) == b"hello " * 2000
    assert [b["sample_offset"] for b in got[1]["blocks"]] == [0, 4096, 8192]
    assert "checksum" in got[2]["error"] and all(got[i]["error"] for i in (3, 5, 6))
    assert got[4]["error"] is None and got[4]["blocks"] is None


def stream(frames, channels, bits, total, samples, seek=b""):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | ((channels - 1) << 41) | ((bits - 1) << 36) | total).to_bytes(8, "big") + hashlib.md5(flac.pcm(samples, bits)).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def frame(number, n, mode, depth, subframes):
    head = b"\xff\xf8" + bytes([0x60, (mode << 4) | (depth << 1)]) + flac._coded_number(number) + bytes([n - 1])
    body = head + bytes([flac.crc8(head)]) + np.packbits(np.concatenate(subframes)).tobytes()
    c = flac.crc16_of(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    return body + int(c).to_bytes(2, "big")


def bits(value, width):
    return flac._bits_of(np.array([value]), width)


@pytest.mark.parametrize("mode", [1, 8, 9, 10])
def test_stereo_and_other_codings(mode):
    """16-bit stereo in every channel coding: verbatim first channel; second a fixed predictor of order 3 with an escaped partition."""
    rng = np.random.default_rng(mode)
    n = 16
    left, right = rng.integers(-3000, 3000, n), rng.integers(-3000, 3000, n)
    side = left - right
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: ((left + right) >> 1, side)}[mode]
    w = [16 + (mode == 9), 16 + (mode in (8, 10))]
    a = [bits(2, 8), *(bits(v, w[0]) for v in first)]
    res = second[3:] - (3 * second[2:-1] - 3 * second[1:-2] + second[:-3])
    b = [bits(2 * 11, 8), *(bits(v, w[1]) for v in second[:3]), bits(0, 2), bits(0, 4), bits(15, 4), bits(20, 5), *(bits(v, 20) for v in res)]
    samples = np.stack([left, right])
    data = stream([frame(0, n, mode, 4, a + b)], 2, 16, n, samples)
    (s, got), = flac.decode([data])
    assert (np.concatenate(got, 1) == samples).all() and s.rate == 44100


def test_wasted_bits_and_constant():
    samples = np.array([[8, -16, 24, 40, 8, 0, 8, 16, 24, 32, 40, 48, 56, 64, 72, 80]])
    a = [bits(2 * 1 + 1, 8), bits(1, 3), *(bits(v >> 3, 13) for v in samples[0])]
    flat = [bits(0, 8), bits(-5, 16)]
    data = stream([frame(0, 16, 0, 4, a), frame(1, 16, 0, 4, flat)], 1, 16, 32, np.concatenate([samples, np.full((1, 16), -5)], 1))
    (_, got), = flac.decode([data])
    assert (got[0] == samples).all() and (got[1] == -5).all()


def test_random_payloads():
    rng = np.random.default_rng(3)
    p = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (1, 2, 63, 64, 4095, 4096, 4097, 9000)]
    p += [(128 + 100 * np.sin(np.arange(n) / 9)).astype(np.uint8).tobytes() for n in (5, 300, 5000)]
    for x, (_, got) in zip(p, flac.decode(flac.encode(p)), strict=True):
        assert (np.concatenate([g[0] for g in got]) + 128).astype(np.uint8).tobytes() == x
