"""The one Python stage: raw messages to headers, MIME parts and decoded header values, in Arrow batches.

Everything after it is Catalyst. A message that can't be parsed gets ``parse_error`` and empty lists; the job goes on.
The helpers are small and per message; Spark partitions the messages.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .batches import pieces
from .markup import BLANKS, LINK, links_of

MAX_DEPTH = 12
HEADER = "struct<ord:int,name:string,value:string,decoded:string>"
PART = (
    "struct<part_id:string,parent_id:string,ord:int,depth:int,mime:string,charset:string,disposition:string,encoding:string,filename:string,"
    "disp_filename:string,params:map<string,string>,disp_params:map<string,string>,size:bigint,attached:boolean,text:string,content:binary>"
)
ADDRESS = "struct<role:string,ord:int,raw:string,name:string,address:string,domain:string>"
PARSED = f"struct<headers:array<{HEADER}>,parts:array<{PART}>,addresses:array<{ADDRESS}>,page_links:array<{LINK}>,parse_error:string>"
ROLES = ("from", "reply-to", "return-path", "sender", "to", "cc")

# the five bytes that windows-1252 leaves open are control characters
codecs.register_error("c1", lambda e: ("".join(chr(b) for b in e.object[e.start : e.end]), e.end) if isinstance(e, UnicodeDecodeError) else ("?", e.end))


def decode_bytes(data: bytes, charset: str | None) -> str:
    """Text of bytes, never failing; a byte order mark of the charset goes."""
    name = R.CHARSETS.get((charset or "utf-8").strip(BLANKS).lower(), "utf-8-sig")
    text = data.decode(name, "c1" if name == "cp1252" else "replace")
    return text.removeprefix("\ufeff") if name == "utf-16-le" else text


def b64(text: str) -> bytes:
    clean = re.sub(r"[^A-Za-z0-9+/=]", "", text).rstrip("=")
    if "=" in clean or len(clean) % 4 == 1:
        return b""
    return base64.b64decode(clean + "=" * (-len(clean) % 4))


def quoted(text: str, header: bool) -> bytes:
    text = text.replace("_", " ") if header else re.sub(r"=\r?\n", "", text)
    raw = text.encode("latin-1", "replace")
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: binascii.unhexlify(m[1]), raw)


_BETWEEN = re.compile(r"(=\?[^?]+\?[BbQq]\?[^?]*\?=)\s+(?==\?)")
def transfer_decoded(body: str, encoding: str) -> bytes:
    """Bytes of a body; any encoding but the two that change it is taken as it stands."""
    return b64(body) if encoding == "base64" else quoted(body, False) if encoding == "quoted-printable" else body.encode("latin-1", "replace")


ENCODED = re.compile(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=")


def rfc2047(text: str | None) -> str:
    """Encoded words, each decoded alone; blanks between two of them go."""
    if not text:
        return ""
    text = _BETWEEN.sub(r"\1", text)
    return ENCODED.sub(lambda m: decode_bytes(b64(m[3]) if m[2] in "Bb" else quoted(m[3], True), m[1]), text)


def split_message(raw: str) -> tuple[str, str]:
    found = re.search(r"\r?\n\r?\n", raw)
    return (raw[: found.start()], raw[found.end() :]) if found else (raw, "")


def header_block(block: str) -> list[list[str]]:
    """Name and value of each header; folded lines, and lines that are no header, continue the one before."""
    out: list[tuple[str, list[str]]] = []
    for line in re.split(r"\r?\n", block):
        if line[:1] in (" ", "\t") and out:
            out[-1][1].append(line.lstrip(" \t"))
        elif found := re.match(r"([!-9;-~]+)[ \t]*:[ \t]*(.*)", line, re.S):
            out.append((found[1], [found[2]]))
        elif out and line.strip(BLANKS):
            out[-1][1].append(line.strip(BLANKS))
    return [[name, " ".join(pieces)] for name, pieces in out]


def first_header(headers: list[list[str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def outside_quotes(text: str, cut: str, comments: bool = False) -> list[str]:
    """``text`` cut at each ``cut`` outside quotation marks (and comments)."""
    out, quote, depth, start = [], False, 0, 0
    for i, c in enumerate(text):
        if c == '"':
            quote = not quote
        elif comments and not quote and c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == cut and not quote and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def params_of(value: str | None) -> tuple[str, dict[str, str]]:
    """A header's value and parameters; continued and encoded ones (name*0*) are joined in order and decoded once."""
    head, *rest = outside_quotes(value or "", ";")
    plain: dict[str, str] = {}
    pieces: dict[str, list[tuple[int, str]]] = {}
    for item in rest:
        key, sign, val = item.partition("=")
        key, val = key.strip().lower(), re.sub(r'^"|"$', "", val.strip())
        if not sign or not key:
            continue
        if found := re.fullmatch(r"([^*]+)\*(\d+)?\*?", key):
            pieces.setdefault(found[1], []).append((int(found[2] or 0), val))
        else:
            plain[key] = rfc2047(val)
    for key, own in pieces.items():
        joined = "".join(v for _, v in sorted(own, key=lambda x: x[0]))
        found = re.fullmatch(r"([^']*)'[^']*'(.*)", joined, re.S)
        plain[key] = decode_bytes(unquote_to_bytes(found[2].encode("latin-1", "replace")), found[1] or "utf-8") if found else rfc2047(joined)
    return head.strip().lower(), plain


def is_attached(mime: str, disposition: str, named: str | None, children: bool) -> bool:
    if children and mime.startswith("multipart/"):
        return False
    text = mime.startswith("text/")
    other = not text and not mime.startswith("multipart/") and mime != "message/rfc822"
    return disposition == "attachment" or bool(named) or (disposition == "inline" and not text) or other


_LINE = re.compile(r"^--[^\n]*", re.M)
_BLANK_LINE = re.compile(r"\r?\n\r?\n")
_SOMETHING = re.compile(f"[^{re.escape(BLANKS)}]")


class _Part:
    """A part whose end isn't known yet: what its headers say, and where its body begins."""

    def __init__(self, out: list[dict], parent: _Part | None, head: str, begin: int):
        headers = header_block(head)
        self.mime, self.params = params_of(first_header(headers, "content-type") or "text/plain")
        self.mime = self.mime or "text/plain"
        self.disposition, self.disp_params = params_of(first_header(headers, "content-disposition"))
        self.encoding = (first_header(headers, "content-transfer-encoding") or "7bit").strip().lower()
        self.begin, self.parent, self.children, self.closed = begin, parent, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.levels = parent.levels + (parent.boundary is not None) if parent else 0  # multiparts around it
        if parent:
            parent.children += 1
        self.path = f"{parent.path}.{parent.children}" if parent else "1"
        nested = self.depth <= MAX_DEPTH
        self.boundary = self.params["boundary"] if nested and self.mime.startswith("multipart/") and self.params.get("boundary") else None
        self.wraps = nested and self.mime == "message/rfc822"
        self.out: dict = {}
        out.append(self.out)
        self.ord = len(out) - 1

    def mark(self, line: str) -> str | None:
        """Whether a line opens (``next``) or ends (``end``) a child."""
        if self.boundary is None or self.closed or not line.startswith(self.boundary, 2):
            return None
        rest = line[2 + len(self.boundary) :]
        return "next" if not rest else "end" if rest == "--" else None

    def finish(self, text: str, end: int) -> None:
        """The part ends at ``end``. Contents of containers are neither cut nor decoded, unless they say that they are coded."""
        is_text = self.mime in ("text/plain", "text/html") and self.disposition != "attachment"
        filename = self.disp_params.get("filename") or self.params.get("name")
        attached = is_attached(self.mime, self.disposition, filename, self.children > 0)
        end = max(self.begin, end)
        plain = not (is_text or attached) and self.encoding not in ("base64", "quoted-printable")
        data = b"" if plain else transfer_decoded(unended(text[self.begin : end], self.levels - 1), self.encoding)
        self.out |= {
            "part_id": self.path, "parent_id": self.parent.path if self.parent else None, "ord": self.ord, "depth": self.depth, "mime": self.mime, "charset": self.params.get("charset"),
            "disposition": self.disposition, "encoding": self.encoding, "filename": rfc2047(filename) if filename else None,
            "disp_filename": rfc2047(self.disp_params["filename"]) if self.disp_params.get("filename") else None, "params": self.params, "disp_params": self.disp_params,
            "size": end - self.begin if plain else len(data), "attached": attached, "text": decode_bytes(data, self.params.get("charset")) if is_text else None, "content": data if attached else None,
        }


def unended(text: str, times: int) -> str:
    """``text`` with up to ``times`` carriage returns gone from each line's end: every multipart around a part takes one."""
    return re.sub(f"\r{{1,{times}}}\n", "\n", text) if times > 0 and "\r\n" in text else text


def _within(text: str, top: _Part, out: list[dict]) -> None:
    """The parts of the multipart ``top``, whose body is ``text`` with plain line ends. One walk over the lines that begin
    with two hyphens, with a stack of open parts; the outermost boundary that a line matches counts."""
    stack = [top]
    pending: tuple[int, bool] | None = None  # where a part begins whose headers aren't read yet; whether it is there even if blank
    blank: re.Match | None = None
    more = True  # whether there may be another blank line

    def opened(limit: int, at_end: bool) -> bool:
        """Read the headers of the pending part, if they end before ``limit`` or (``at_end``) it does; push it."""
        nonlocal pending, blank, more
        begin, sure = pending
        if more and (blank is None or blank.start() < begin):
            blank = _BLANK_LINE.search(text, begin)
            more = blank is not None
        ends = blank.end() if more else len(text) + 2
        if ends > limit and not at_end:
            return False
        pending = None
        first = _SOMETHING.search(text, begin)
        if at_end and not sure and (first is None or first.start() >= limit):
            return False
        levels = stack[-1].levels + (stack[-1].boundary is not None)
        head, body = (text[begin : blank.start()], ends) if ends <= limit else (text[begin : max(begin, limit)], max(begin, limit))
        stack.append(_Part(out, stack[-1], unended(head, levels - 1), body))
        if stack[-1].wraps:
            pending = (body, True)
        return True

    for found in [*_LINE.finditer(text), None]:
        line = found[0].rstrip(BLANKS) if found else ""
        at = found.start() if found else len(text) + 1
        level = mark = None
        while True:
            level, mark = next(((i, m) for i, p in enumerate(stack) if (m := p.mark(line))), (None, None)) if found else (0, "end")
            if pending is None or not opened(at - 1 if mark else at, mark is not None):
                break
        if mark:
            while len(stack) > level + 1:
                stack.pop().finish(text, at - 1)
            if mark == "end":
                stack[level].closed = True
            elif found.end() < len(text):
                pending = (found.end() + 1, False)


def mime_parts(raw: str) -> list[dict]:
    """All parts, depth first; a part's id is its path (1, 1.1, 1.2.1). Texts of bodies and contents of attachments are
    decoded; other parts have neither. Each byte is looked at a fixed number of times, however deep parts are nested."""
    out: list[dict] = []
    text, open_ = raw, []
    while True:
        head, body = split_message(text)
        part = _Part(out, open_[-1][0] if open_ else None, head, 0)
        open_.append((part, body))
        if not part.wraps:
            break
        text = body
    if part.boundary is not None:
        _within(body.replace("\r\n", "\n"), part, out)
    for part, body in reversed(open_):
        part.finish(body, len(body))
    return out


def address_list(value: str | None) -> list[dict]:
    out = []
    for item in map(str.strip, outside_quotes(value or "", ",", comments=True)):
        if not item:
            continue
        # the bracket that closes the item, and the first that opens after any other closing one
        ends = item.endswith(">")
        begins = item.find("<", item.rfind(">", 0, -1) + 1) if ends else -1
        name = re.sub(r'^"|"$', "", item[:begins].strip()) if begins >= 0 else ""
        address = re.sub(r"(?i)^mailto:", "", item[begins + 1 : -1].strip() if begins >= 0 else re.sub(r"[<>]", "", item).strip())
        domain = address.rpartition("@")[2].lower().rstrip(">,;" + BLANKS) if "@" in address else ""
        out.append({"raw": item, "name": rfc2047(name).strip(), "address": address, "domain": domain})
    return out


def body_of(parts: list[dict], mime: str) -> str:
    """The texts of one kind, in order."""
    return "\n\n".join(p["text"] for p in parts if p["mime"] == mime and p["text"] is not None)


def parse_message(raw: bytes | None) -> dict:
    try:
        text = (raw or b"").decode("latin-1")
        headers = header_block(split_message(text)[0])
        addresses = [{"role": role, "ord": i} | a for role in ROLES for i, a in enumerate(address_list(first_header(headers, role)))]
        parts = mime_parts(text)
        return {
            "headers": [{"ord": i, "name": k, "value": v, "decoded": rfc2047(v)} for i, (k, v) in enumerate(headers)],
            "parts": parts, "addresses": addresses, "page_links": links_of(body_of(parts, "text/html")), "parse_error": None,
        }
    except Exception as e:  # one bad message is reported, the others go on
        return {"headers": [], "parts": [], "addresses": [], "page_links": [], "parse_error": f"{type(e).__name__}: {e}"}


def _arrow_type(name: str) -> pa.DataType:
    from pyspark.sql import SparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(SparkSession.active().createDataFrame([], f"x {name}").schema["x"].dataType)


def with_parsed(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """``messages`` with headers, parts, addresses, page_links and parse_error of the binary column ``raw``."""
    kind = _arrow_type(PARSED)

    @F.arrow_udf(PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in (p for batch in batches for p in pieces(batch)):
            rows = [parse_message(x.as_py()) for x in own]
            for part in (p for r in rows for p in r["parts"]):
                part["params"], part["disp_params"] = list(part["params"].items()), list(part["disp_params"].items())
            yield pa.array(rows, kind)

    return messages.withColumn("_parsed", parse(F.col(raw))).select(*messages.columns, "_parsed.*")
