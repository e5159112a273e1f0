"""Broken and hostile messages: what is found in them, and that time grows with their length."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmail.operators.analyze import analyze
from siftmail.operators.markup import links_of
from siftmail.operators.parse import address_list, header_block, mime_parts, params_of, parse_message, split_message


def found(html):
    return [(x["source"][5:], x["url"], x["text"]) for x in links_of(html)]


@pytest.mark.parametrize(("html", "want"), [
    ("<A HREF='http://a/?x=1&amp;y'>one<b>two</b></A> rest", [("a", "http://a/?x=1&amp;y", "onetwo")]),
    ("<a href=http://a>one<a href=http://b>two", [("a", "http://a", "one"), ("a", "http://b", "two")]),  # the next anchor ends one
    ("<p><a href=http://a>one</p> more", [("a", "http://a", "one more")]),
    ('<a title="x > y" href=" http://a/b c ">t</a>', [("a", "http://a/b c", "t")]),
    ("<a href=http://a href=http://b>t</a>", [("a", "http://a", "t")]),
    ("<a name=x>t</a><a href=>u</a><a href>v</a>", []),
    ("<!-- <a href=http://a>t</a> --><script>'<a href=http://b>'</script><style><a href=http://c></style>", []),
    ("<a href=http://a>2 < 3 <!-- no --> 4</a>", [("a", "http://a", "2 < 3  4")]),
    ("<abbr href=http://a>x</abbr><a/href=http://b>t</a>", [("a", "http://b", "t")]),
    ("<img alt=a src=i.png background=b.png><form action=/f><td background='c'><iframe src=q></iframe><script src=s.js></script>", [("img", "i.png", "[img]"), ("form", "/f", "[form]"), ("bg", "b.png", "[bg]"), ("bg", "c", "[bg]"), ("asset", "q", "[asset]"), ("asset", "s.js", "[asset]")]),
    ('<META http-equiv="Refresh" content="0; URL = http://a/?url=http://b/"><meta http-equiv=refresh content=url=http://c>', [("refresh", "http://b/", "[meta refresh]")]),
    ("<a href='http://a", []), ("<a href=http://a", []), ("<", []), ("</", []), ("<!--", []), ("", []), (None, []), ("</a></a>", []),
])
def test_scanner(html, want):
    assert found(html) == want


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("<>a/=\"' !-hrefscipt\n"), max_size=80))
def test_scanner_takes_anything(html):
    assert all(x["url"] and x["source"] for x in links_of(html))


def test_scanner_equals_the_pattern_on_closed_anchors():
    """The pattern that the reference falls back to, on markup that is well formed."""
    html = "".join(f'<div class="c{i}"><a class=x href="http://h{i}.example/{i}">t{i} <i>u</i></a><br></div>\n' for i in range(200))
    want = [(u, re.sub(r"<[^>]+>", "", t)) for u, t in re.findall(r"(?is)<a\b[^>]*href\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*>(.*?)</a>", html)]
    assert [(u, t) for _, u, t in found(html)] == want


MANY = 50_000
HOSTILE = {
    "open anchors": "<a href=http://h.example/x>t ", "own open anchors": None, "tags that never end": "<img ", "open quotes": "<a href='", "signs": "<", "comments": "<!--", "ends": "</a ",
    "closing signs": "> ", "refreshes": "<meta http-equiv=refresh ", "attributes": "<a x='1' ", "brackets": "<<>", "scripts": "<script>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_markup_takes_time_by_length(name):
    html = "".join(f"<a href=http://h{i}.example/>t " for i in range(MANY)) if HOSTILE[name] is None else HOSTILE[name] * MANY
    began = time.process_time()
    links = links_of(html)
    assert time.process_time() - began < 5
    assert len(links) == (MANY if "anchors" in name else 0)


@pytest.mark.parametrize("name", ["open anchors", "tags that never end", "signs", "brackets", "refreshes", "open quotes"])
def test_analysis_takes_time_by_length(spark, name):
    """The whole analysis of one such message, the planning of the first aside."""
    small, big = (spark.createDataFrame([("m", b"From: a@b.c\r\nContent-Type: text/html\r\n\r\n" + HOSTILE[name].encode() * n)], "message_id string, raw binary") for n in (1, MANY))
    analyze(small).collect()
    began = time.time()
    analyze(small).collect()
    planned = time.time() - began
    began = time.time()
    r = analyze(big).first()
    assert time.time() - began < planned + 8 and r["parse_error"] is None and len(r["links"]) == ("anchors" in name)


def test_ends_of_sentences_and_names_take_time_by_length(spark):
    from siftmail.functions import text as T

    urls = [("http://a.example/" + ")" * MANY + "x",), ("http://a.example/b" + ")." * MANY,)]
    began = time.time()
    got = [r["u"] for r in spark.createDataFrame(urls, "s string").select(T.url_parts(F.col("s"))["url"].alias("u")).collect()]
    assert got == [urls[0][0], "http://a.example/b"]
    assert address_list("<" * MANY)[0]["domain"] == "" and address_list("x <a@b" + ">" * MANY)[0]["address"] == "x a@b"
    raw = b"From: " + b"a" * MANY + b" <x@y.z>\r\n\r\nhello"
    assert analyze(spark.createDataFrame([("m", raw)], "message_id string, raw binary")).first()["score"] is not None
    assert time.time() - began < 60


def test_folded_headers_take_time_by_length():
    took = []
    for n in (40_000, 160_000):
        began = time.process_time()
        assert len(header_block("a: b\r\n" + " folded line\r\n" * n)[0][1]) == 12 * n + 1
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.01)


def parts_by_levels(raw, depth=0, path="1"):
    """Ids, kinds and bodies of all parts: each level splits its own text, as the definition has it."""
    head, body = split_message(raw)
    headers = {k.lower(): v for k, v in reversed(header_block(head))}
    mime, params = params_of(headers.get("content-type") or "text/plain")
    out, children = [(path, mime or "text/plain", body)], []
    if depth <= 12 and mime.startswith("multipart/") and params.get("boundary"):
        own = None
        for line in re.split(r"\r?\n", body):
            if line.rstrip() == "--" + params["boundary"] or line.rstrip() == "--" + params["boundary"] + "--":
                children += [] if own is None else ["\n".join(own)]
                own = []
                if line.rstrip() != "--" + params["boundary"]:
                    own = None
                    break
            elif own is not None:
                own.append(line)
        children = [c for c in children + ([] if own is None else ["\n".join(own)]) if c.strip()]
    elif depth <= 12 and mime == "message/rfc822":
        children = [body]
    for i, c in enumerate(children, 1):
        out += parts_by_levels(c, depth + 1, f"{path}.{i}")
    return out


LINES = ["", "text", "--", "--b", "--bb", "--b--", "--bb--", "--b----", "--b ", "  ", "A: b", " folded"]
HEADS = ["Content-Type: multipart/mixed; boundary=b", 'Content-Type: multipart/x; boundary="bb"', 'Content-Type: multipart/x; boundary="b--"', "Content-Type: message/rfc822", "Content-Type: text/html", "X: y"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(LINES), st.sampled_from(HEADS).map(lambda h: f"--b\n{h}\n"), st.sampled_from(HEADS).map(lambda h: f"--bb\n{h}\n")), max_size=25), st.sampled_from(HEADS), st.sampled_from(["\n", "\r\n"]))
def test_one_walk_finds_the_parts_of_all_levels(lines, head, end):
    raw = (head + "\n\n" + "\n".join(lines)).replace("\n", end)
    want = parts_by_levels(raw)
    got = mime_parts(raw)
    assert [(p["part_id"], p["mime"]) for p in got] == [(i, m) for i, m, _ in want]
    assert [p["text"] for p in got if p["text"] is not None] == [b for _, m, b in want if m in ("text/plain", "text/html")]
    assert [p["size"] for p in got] == [len(b) for *_, b in want]


def test_line_ends_of_nested_parts():
    """Each multipart around a part takes one carriage return from the ends of its lines."""
    inner = "Content-Type: multipart/x; boundary=i\r\n\r\n--i\r\nContent-Type: text/plain\r\n\r\na\r\r\r\nb\r\n--i--"
    outer = f"Content-Type: multipart/x; boundary=o\r\n\r\n--o\r\n{inner}\r\n--o--"
    assert [p["text"] for p in mime_parts(outer) if p["text"]] == [b for _, m, b in parts_by_levels(outer) if m == "text/plain"]


def test_parts_take_time_by_length():
    """64 MB in a nest of twelve levels, and fifty thousand small parts, some of which have no blank line."""
    nest = "x" * 75 + "\r\n"
    nest = nest * (64_000_000 // len(nest))
    for i in range(12):
        nest = f"Content-Type: multipart/mixed; boundary=b{i}\r\n\r\n--b{i}\r\n{nest}\r\n--b{i}--"
    began = time.process_time()
    parts = mime_parts(nest)
    assert time.process_time() - began < 15 and len(parts) == 13
    flat = "Content-Type: multipart/mixed; boundary=b\r\n\r\n" + "".join(f"--b\r\nX: {i}\r\n" + ("\r\nbody\r\n" if i % 2 else "") for i in range(MANY))
    began = time.process_time()
    assert len(mime_parts(flat)) == MANY + 1 and time.process_time() - began < 15


def test_addresses_of_six(spark):
    lines = {
        "(h [IPv6:2001:db8::1])": ["2001:db8::1"], "(h [IPv6:2001:db8:0:0:0:0:0:1])": ["2001:db8:0:0:0:0:0:1"], "([IPv6:fe80::1])": ["fe80::1"], "id xad::1z": [], "(1:2:3:4:5:6:7:8)": ["1:2:3:4:5:6:7:8"],
        "at 10:20:30 id": [], "[2001:db8::1] [2001:db8::1] 192.0.2.1": ["192.0.2.1", "2001:db8::1"], "(::1)": [],
    }
    raws = [(k, f"Received: from a {k} by b; Mon, 10 Aug 2026 09:00:00 +0200\r\n\r\nx".encode()) for k in lines]
    got = {r["message_id"]: r for r in analyze(spark.createDataFrame(raws, "message_id string, raw binary")).select("message_id", "hops", "origin_ip", "iocs").collect()}
    assert {k: r["hops"][0]["ips"] for k, r in got.items()} == lines
    for k, ips in lines.items():
        public = [ip for ip in ips if not ip.startswith("fe80")]
        assert got[k]["origin_ip"] == (public or [None])[0] and got[k]["iocs"]["ips"] == public


def test_headers_of_the_message_are_those_of_its_first_part():
    raw = b"Subject: a\r\n b\r\nContent-Type: text/html\r\n\r\n<a href=http://x/>y</a>"
    m = parse_message(raw)
    assert m["headers"][0]["value"] == "a b" and m["page_links"] == [{"url": "http://x/", "text": "y", "source": "html:a"}]
