"""Messages of our own with results stated by hand: one fault an envelope, and some that combine several.

An envelope takes a text as its body or as one of its parts, so a table of texts becomes a mailbox: text number n goes into
envelope n modulo their number. What the envelope itself fires is stated here; what the words of a text add is left to
whoever compares.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

AUTH = "mx.corp.example; spf={spf} smtp.mailfrom=ann@{d}; dkim={dkim} header.d={d}; dmarc={dmarc} header.from={d}"


def auth(spf: str = "pass", dkim: str = "pass", dmarc: str = "pass", d: str = "example.com") -> str:
    return AUTH.format(spf=spf, dkim=dkim, dmarc=dmarc, d=d)


LAST = "from mx.example.com (mx.example.com [203.0.113.9]) by mx.corp.example with ESMTPS id B2 for <box@corp.example>; Mon, 10 Aug 2026 09:00:10 +0200"
FIRST = "from host.example.com (host.example.com [198.51.100.7]) by mx.example.com with ESMTP id A1; Mon, 10 Aug 2026 09:00:00 +0200"
IPS = ("198.51.100.7", "203.0.113.9")
BASE = {
    "Received": [LAST, FIRST], "Authentication-Results": [auth()], "From": ["Ann <ann@example.com>"], "To": ["box@corp.example"], "Subject": ["hello"], "Message-ID": ["<m@example.com>"],
    "Date": ["Mon, 10 Aug 2026 09:00:00 +0200"], "MIME-Version": ["1.0"],
}
TEXT_PART = 'Content-Type: text/plain; charset="utf-8"\r\nContent-Transfer-Encoding: base64\r\n\r\n'


def b64(data: bytes) -> str:
    return base64.encodebytes(data).decode().replace("\n", "\r\n").rstrip()


def part(*head: str, body: str = "") -> str:
    return "\r\n--b\r\n" + "\r\n".join(head) + "\r\n\r\n" + body


@dataclass
class Envelope:
    """raw: ``head``, ``before``, the text in the encoding ``enc`` (plain, b64, u16, html or none), ``after``. The rest is
    what is expected: see the module."""

    name: str
    head: str
    enc: str
    before: str
    after: str
    ids: list[str]
    links: list[tuple[str, str, str, list[str]]] = field(default_factory=list)  # url, host, kind, flags
    files: list[tuple[str, bytes, str, str | None, list[str]]] = field(default_factory=list)  # name, content, ext, magic, flags
    seen: str = ""  # what is visible beside the text
    risky: bool = False  # answers elsewhere, a foreign signature or a free account: a payment is then suspicious
    subject: str = "hello"
    sender: str | None = "ann@example.com"
    emails: tuple[str, ...] = ("ann@example.com",)
    ips: tuple[str, ...] = IPS
    delays: tuple[int | None, ...] = (None, 10)
    first_ips: str = "198.51.100.7"  # all that the first hop names, private ones too
    chips: tuple[str, str, str, str, str] = ("pass", "pass", "pass", "aligned", "aligned")

    @property
    def tail(self) -> list[str]:
        """Ids of links, each once a host, then of files."""
        of_links = dict.fromkeys((i, host) for _, host, _, flags in self.links for i in flags)
        return [i for i, _ in of_links] + [i for *_, flags in self.files for i in flags]

    def raw(self, text: str) -> bytes:
        def coded() -> str:
            if self.enc == "none":
                return ""
            if self.enc == "plain":
                return text
            if self.enc == "html":
                safe = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                return b64(f"<html><body><p>{safe}</p></body></html>".encode())
            return b64(text.encode("utf-16-le" if self.enc == "u16" else "utf-8"))

        return (self.head + self.before + coded() + self.after).encode()


def envelope(name: str, ids: str = "", *, set: dict | None = None, enc: str = "plain", html: str | None = None, parts: str | None = None, body: str | None = None, **expected) -> Envelope:  # noqa: A002
    headers = BASE | (set or {})
    head = "".join(f"{k}: {v}\r\n" for k, values in headers.items() for v in (values if isinstance(values, list) else [values]))
    head = head.replace("Subject-: ", "Subject : ")
    if html is not None:
        before, enc = 'Content-Type: multipart/alternative; boundary="b"\r\n\r\npreamble\r\n--b\r\n' + TEXT_PART, "b64"
        after = part('Content-Type: text/html; charset="utf-8"', body=f"<html><body>{html}</body></html>") + "\r\n--b--\r\nepilogue"
    elif parts is not None:
        before, enc, after = 'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\n' + TEXT_PART, "b64", parts + "\r\n--b--\r\n"
    elif body is not None:
        before, enc, after = body, "none", ""
    else:
        kind, charset, coding = {"plain": ("plain", "utf-8", "8bit"), "b64": ("plain", "utf-8", "base64"), "u16": ("plain", "UTF-16", "base64"), "html": ("html", "utf-8", "BASE64")}[enc]
        before, after = f'Content-Type: text/{kind}; charset="{charset}"\r\nContent-Transfer-Encoding: {coding}\r\n\r\n', ""
    return Envelope(name, head, enc, before, after, ids.split(), **expected)


def sender(address: str, name: str = "Ann", **more) -> dict:
    """Headers of another sender, aligned in all respects."""
    d = address.partition("@")[2]
    return {"From": f"{name} <{address}>", "Authentication-Results": auth(d=d), "Message-ID": f"<m@{d}>"} | more


def link(url: str, host: str, flags: str = "", name: str = "see") -> dict:
    """Markup and expectation of one link of an HTML part."""
    return {"html": f'<p><a href="{url}">{name}</a></p>', "links": [(url, host, "enlace", flags.split())], "seen": name}


def file(name: str, content: bytes, ext: str, magic: str | None, flags: str = "", kind: str = "application/octet-stream", disposition: str | None = None) -> dict:
    disposition = disposition or f'Content-Disposition: attachment; filename="{name}"'
    return {"parts": part(f"Content-Type: {kind}", "Content-Transfer-Encoding: base64", disposition, body=b64(content)), "files": [(name, content, ext, magic, flags.split())]}


_ONE_HOP = {"ips": ("203.0.113.9",), "delays": (None,)}
_FREE = {"sender": "ann@gmail.com", "emails": ("ann@gmail.com",), "risky": True}
_BULK = "mx.corp.example; spf=pass smtp.mailfrom=b@bulk.example.net; dkim=pass header.d=example.net; dmarc=pass header.from=example.com"
_EARLY = FIRST.replace("Mon, 10 Aug 2026 09:00:00 +0200", "Mon, 10 Aug 2026 {}")

ENVELOPES = [
    envelope("plain"), envelope("base64", enc="b64"), envelope("utf-16", enc="u16"), envelope("html", enc="html"),
    # authentication
    envelope("no transport", "no-transport", set={"Received": [], "Authentication-Results": []}, ips=(), delays=(), chips=("", "", "", "unknown", "unknown")),
    envelope("spf fail", "spf-fail", set={"Authentication-Results": auth(spf="fail")}, chips=("fail", "pass", "pass", "aligned", "aligned")),
    envelope("spf softfail", "spf-softfail", set={"Authentication-Results": auth(spf="softfail")}, chips=("fail", "pass", "pass", "aligned", "aligned")),
    envelope("spf missing", "spf-none", set={"Authentication-Results": "mx; dkim=pass header.d=example.com; dmarc=pass"}, chips=("", "pass", "pass", "unknown", "aligned")),
    envelope("spf neutral", "spf-neutral", set={"Authentication-Results": auth(spf="NEUTRAL")}, chips=("warn", "pass", "pass", "aligned", "aligned")),
    envelope("spf permerror", set={"Authentication-Results": auth(spf="permerror")}, chips=("warn", "pass", "pass", "aligned", "aligned")),
    envelope("spf elsewhere", "spf-softfail", set={"Authentication-Results": "mx; dkim=pass header.d=example.com; dmarc=pass", "Received-SPF": ["Pass (a) envelope-from=<x@example.com>", "SoftFail (b) envelope-from=y@example.net"]},
             chips=("fail", "pass", "pass", "aligned", "aligned")),
    envelope("dkim fail", "dkim-fail", set={"Authentication-Results": auth(dkim="fail")}, chips=("pass", "fail", "pass", "aligned", "aligned")),
    envelope("dkim missing", "dkim-none", set={"Authentication-Results": "mx; spf=pass smtp.mailfrom=example.com; dmarc=pass"}, chips=("pass", "", "pass", "aligned", "unknown")),
    envelope("dkim none", "dkim-absent", set={"Authentication-Results": "mx; spf=pass smtp.mailfrom=example.com; dkim=none header.d=none; dmarc=pass"}, chips=("pass", "warn", "pass", "aligned", "unknown")),
    envelope("dkim of the signature", set={"Authentication-Results": "mx; spf=pass smtp.mailfrom=example.com; dkim=pass; dmarc=pass", "DKIM-Signature": "v=1; a=rsa-sha256; d=example.com;\r\n s=k1; b=abc\r\n def"}),
    envelope("dmarc fail", "dmarc-fail", set={"Authentication-Results": auth(dmarc="fail")}, chips=("pass", "pass", "fail", "aligned", "aligned")),
    envelope("dmarc missing", "dmarc-none", set={"Authentication-Results": "mx; spf=pass smtp.mailfrom=example.com; dkim=pass header.d=example.com"}, chips=("pass", "pass", "", "aligned", "aligned")),
    envelope("dmarc none", "dmarc-absent", set={"Authentication-Results": auth(dmarc="none")}, chips=("pass", "pass", "warn", "aligned", "aligned")),
    envelope("compauth", "compauth", set={"Authentication-Results": auth() + "; compauth=softpass reason=1"}),
    envelope("nothing aligned", "align-none", set={"Authentication-Results": _BULK}, risky=True, chips=("pass", "pass", "pass", "not aligned", "not aligned")),
    envelope("foreign signature", "align-dkim", set={"Authentication-Results": _BULK.replace("b@bulk.example.net", "example.com")}, risky=True, chips=("pass", "pass", "pass", "aligned", "not aligned")),
    envelope("empty envelope domain", "align-dkim", set={"Authentication-Results": _BULK.replace("b@bulk.example.net", "bounce@")}, risky=True, chips=("pass", "pass", "pass", "unknown", "not aligned")),
    # identity
    envelope("return path", "rp-mismatch", set={"Return-Path": "<b@example.net>"}, emails=("ann@example.com", "b@example.net")),
    envelope("reply elsewhere", "replyto-mismatch", set={"Reply-To": "other@example.net"}, risky=True, emails=("ann@example.com", "other@example.net")),
    envelope("reply to a free account", "replyto-freemail", set=sender("ann@gmail.com", **{"Reply-To": "ann.two@gmail.com"}), **_FREE | {"emails": ("ann@gmail.com", "ann.two@gmail.com")}),
    envelope("reply to oneself", set={"Reply-To": "ANN@example.com"}, risky=True, emails=("ann@example.com", "ANN@example.com")),
    envelope("address in the name", "dn-email", set={"From": '"chief@example.net" <ann@example.com>'}),
    envelope("brand in the name", "dn-brand", set={"From": "Pay Pal Service <ann@example.com>"}),
    envelope("odd letters", "dn-homoglyph", set={"From": "=?utf-8?B?" + base64.b64encode("\u0410nn".encode()).decode() + "?= <ann@example.com>"}),
    envelope("punycode sender", "from-punycode", set=sender("ann@xn--exmple-cua.com"), sender="ann@xn--exmple-cua.com", emails=("ann@xn--exmple-cua.com",)),
    envelope("risky sender", "from-tld", set=sender("ann@example.xyz"), sender="ann@example.xyz", emails=("ann@example.xyz",)),
    envelope("manager on a free account", "from-freemail-cargo", set=sender("ann@gmail.com", '"Ann, CEO"'), **_FREE),
    envelope("two senders", "from-multi", set={"From": "Ann <ann@example.com>, Bob <bob@example.com>"}, emails=("ann@example.com", "bob@example.com")),
    envelope("no sender", "from-missing", set={"From": []}, sender=None, emails=(), chips=("pass", "pass", "pass", "unknown", "unknown")),
    envelope("no message id", "mid-missing", set={"Message-ID": []}), envelope("foreign message id", "mid-mismatch", set={"Message-ID": "<m@example.net>"}),
    # transport
    envelope("bulk mailer", "xmailer", set={"X-Mailer": "PHPMailer 6"}), envelope("empty mailer", "xmailer", set={"X-Mailer": "", "User-Agent": "Python smtplib"}),
    envelope("origin told", "x-orig-ip", set={"X-Originating-IP": "[203.0.113.1]"}), envelope("empty origin", set={"X-Originating-IP": ""}),
    envelope("no hops", "rcv-none", set={"Received": []}, ips=(), delays=()), envelope("one hop", "rcv-one", set={"Received": [LAST]}, **_ONE_HOP),
    envelope("private hop", set={"Received": [LAST, FIRST.replace("198.51.100.7", "10.0.0.7")]}, ips=("203.0.113.9",), first_ips="10.0.0.7"),
    *(
        envelope(name, set={"Received": [LAST, FIRST.replace("198.51.100.7", said)]}, ips=(*public, "203.0.113.9"), first_ips=named)
        for name, said, public, named in (
            ("tagged address of six", "IPv6:2001:db8::1", ["2001:db8::1"], "2001:db8::1"), ("full address of six", "IPv6:2001:db8:0:0:0:0:0:1", ["2001:db8:0:0:0:0:0:1"], "2001:db8:0:0:0:0:0:1"),
            ("local address of six", "IPv6:fe80::1", [], "fe80::1"), ("no address of six", "xad::1z", [], ""), ("addresses of both kinds", "198.51.100.7] [2001:db8::a", ["198.51.100.7", "2001:db8::a"], "198.51.100.7 2001:db8::a"),
        )
    ),
    envelope("slow hop", "rcv-delay", set={"Received": [LAST, _EARLY.format("07:00:00 +0200")]}, delays=(None, 7210)),
    envelope("slow hop in a named zone", "rcv-delay", set={"Received": [LAST, _EARLY.format("01:00:00 EDT (summer)")]}, delays=(None, 7210)),
    envelope("quick hop in a named zone", set={"Received": [LAST, _EARLY.format("03:00:00 EDT")]}),
    envelope("old date", "date-skew", set={"Date": "Sat, 1 Aug 2026 09:00:00 +0200"}), envelope("no date at all", set={"Date": "someday"}),
    # subject
    envelope("haste", "subj-urgency", set={"Subject": "URGENTE: factura"}, subject="URGENTE: factura"),
    envelope("no haste without accents", set={"Subject": "ultimo aviso sancion"}, subject="ultimo aviso sancion"),
    envelope("coded haste", "subj-urgency", set={"Subject": "=?utf-8?Q?=C3=9Altimo?=\r\n =?iso-8859-1?q?_avis=6F?="}, subject="Último aviso"),
    envelope("blank before the colon", "subj-urgency", set={"Subject": [], "Subject-": "final notice"}, subject="final notice"),
    envelope("false answer", "subj-nothread", set={"Subject": "Re: hello"}, subject="Re: hello"), envelope("empty references", "subj-nothread", set={"Subject": "RE : hello", "References": ""}, subject="RE : hello"),
    envelope("real answer", set={"Subject": "Re: hello", "In-Reply-To": "<x@corp.example>"}, subject="Re: hello"),
    # markup and words
    envelope("form", "body-form", html='<form action="https://example.com/f"><input name="a"></form>', links=[("https://example.com/f", "example.com", "enlace", [])]),
    envelope("password field", "body-password", html="<input type='password'>"), envelope("script", "body-script", html="<script>a()</script>", seen="a()"),
    envelope("frame", "body-iframe", html='<iframe src="https://example.com/i"></iframe>', links=[("https://example.com/i", "example.com", "recurso", [])]),
    envelope("refresh", "body-refresh", html='<meta http-equiv="refresh" content="0;url=https://example.com/?url=https://example.net/b">', links=[("https://example.net/b", "example.net", "enlace", [])]),
    envelope("hidden text", "dmarc-absent body-hidden", set={"Authentication-Results": auth(dmarc="none")}, html='<p style="display: none">a</p><p style="font-size:0">b</p>', seen="a b", chips=("pass", "pass", "warn", "aligned", "aligned")),
    envelope("hidden text that is proven", html='<p style="display: none">a</p><p style="color:#ffffff">b</p>', seen="a b"),
    envelope("image only", "body-image", body='Content-Type: text/html\r\n\r\n<img src="https://example.com/x.png">', links=[("https://example.com/x.png", "example.com", "recurso", [])]),
    envelope("entities", "body-entities", html="&#65;" * 41, seen="A" * 41), envelope("few entities", html="&#65;" * 40, seen="A" * 40),
    envelope("empty body", "body-empty", body="Content-Type: multipart/mixed; boundary=b\r\n" + part("Content-Type: application/pdf; name=doc.pdf", "Content-Transfer-Encoding: base64", body=b64(b"%PDF-1.4 x")) + "\r\n--b--",
             files=[("doc.pdf", b"%PDF-1.4 x", "pdf", "PDF", [])]),
    envelope("crypto", html="<p>pay in bit<b></b>coin, one Bitcoin</p>", seen="pay in bit coin, one Bitcoin"),
    envelope("payment asked", set={"Reply-To": "ann@example.com"}, html="<p>a wire transfer please</p>", seen="a wire transfer please", risky=True),
    envelope("payment named", html="<p>a wire transfer please</p>", seen="a wire transfer please"), envelope("account", html="<p>IBAN ES91 2100 0418 4502 0005 1332</p>", seen="IBAN ES91 2100 0418 4502 0005 1332"),
    envelope("call nobody", body="Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nestoy en una reu=\r\nni=F3n", seen="estoy en una reunión"),
    # links
    envelope("link to an address", **link("http://203.0.113.5/x", "203.0.113.5", "url-ip")), envelope("link in punycode", **link("https://xn--exmple-cua.net/", "xn--exmple-cua.net", "url-punycode")),
    envelope("link with a user", **link("https://user@example.net/", "example.net", "url-userinfo")), envelope("short link", **link("https://bit.ly/x", "bit.ly", "url-shortener")),
    envelope("redirecting link", **link("https://click.example.net/", "click.example.net", "url-redirector")), envelope("link with a port", **link("https://example.net:8443/", "example.net", "url-port")),
    envelope("risky link", **link("https://example.top/", "example.top", "url-tld")), envelope("link to sign in", **link("https://example.net/a?next=LogIn", "example.net", "url-creds")),
    envelope("open link to sign in", **link("http://example.net/login", "example.net", "url-creds url-http")), envelope("deep link", **link("https://a.b.c.d.example.net/", "a.b.c.d.example.net", "url-subdomains")),
    envelope("link of a false brand", **link("https://paypal.example.net/", "paypal.example.net", "url-brand")), envelope("link to files", **link("https://docs.google.com/f", "docs.google.com", "url-filehost")),
    envelope("link with a trailing point", **link("HTTPS://Example.NET/a).", "example.net") | {"links": [("HTTPS://Example.NET/a", "example.net", "enlace", [])]}),
    envelope("link that shows another", html='<a href="https://example.net/">https://example.com/</a>', seen="https://example.com/",
             links=[("https://example.net/", "example.net", "enlace", ["url-mismatch"]), ("https://example.com/", "example.com", "recurso", [])]),
    envelope("link home", **link("https://www.example.com:8443/login", "www.example.com")), envelope("link home in punycode", **link("https://xn--a.example.com/login", "xn--a.example.com", "url-punycode")),
    envelope("link in plain text", body="Content-Type: text/plain\r\n\r\nsee www.example.net/a, or ftp://example.net/b", links=[("http://www.example.net/a", "www.example.net", "enlace", []), ("ftp://example.net/b", "example.net", "enlace", [])]),
    envelope("two links of a host", html='<a href="https://example.top/1">x</a><a href="https://example.top/2">y</a><a href="https://example.top/1">z</a>', seen="x y z",
             links=[("https://example.top/1", "example.top", "enlace", ["url-tld"]), ("https://example.top/2", "example.top", "enlace", ["url-tld"])]),
    # attachments
    envelope("program", **file("run.exe", b"x", "exe", None, "att-exec")), envelope("macros", **file("a.docm", b"PK\x03\x04x", "docm", "ZIP/OOXML", "att-macro")),
    envelope("container", **file("a.zip", b"PK\x03\x04y", "zip", "ZIP/OOXML", "att-container")), envelope("page", **file("a.html", b"<p>x", "html", None, "att-html", kind="text/html")),
    envelope("two extensions", **file("report.pdf.txt", b"x", "txt", None, "att-double")), envelope("turned name", **file("a\u202etxt.bin", b"x", "bin", None, "att-rtlo", disposition="Content-Disposition: attachment; filename*=utf-8''a%E2%80%AEtxt.bin")),
    envelope("hidden program", **file("a.bin", b"MZ\x90", "bin", "PE/DOS", "att-mismatch")), envelope("old office", **file("a.bin", bytes.fromhex("d0cf11e0a1"), "bin", "OLE2", "att-ole")),
    envelope("old office named so", **file("a.doc", bytes.fromhex("d0cf11e0a1"), "doc", "OLE2")), envelope("empty file", **file("a.txt", b"", "txt", None, "att-empty")),
    envelope("nested parts named as a file", parts=part('Content-Type: multipart/mixed; boundary="c"; name="x.exe"', "Content-Disposition: attachment", body="--c\r\nContent-Type: text/plain\r\n\r\ninner\r\n--c--"), seen="inner"),
    envelope("parts without parts", parts=part('Content-Type: multipart/x-own; name="c.bin"', body="hello"), files=[("c.bin", b"hello", "bin", None, [])]),
    envelope("empty name", parts=part('Content-Type: text/plain; name=""', body="more"), seen="more"),
    envelope("message within", parts=part("Content-Type: message/rfc822", body="Subject: urgente\r\nContent-Type: text/html\r\n\r\n<script>b</script>"), ids="body-script", seen="b"),
    # combinations
    envelope("chief asks for money", "from-freemail-cargo", set=sender("ann@gmail.com", '"Ann (CEO)"'), html="<p>wire transfer today</p>", seen="wire transfer today", **_FREE),
    envelope("false sign-in", "body-form body-password", html='<form action="http://203.0.113.5/login"><input type=password></form>', links=[("http://203.0.113.5/login", "203.0.113.5", "enlace", ["url-ip", "url-creds", "url-http"])]),
    envelope("urgent program", "subj-urgency", set={"Subject": "action required"}, subject="action required", **file("run.js", b"x", "js", None, "att-exec")),
    envelope("extortion", "from-tld", set=sender("ann@example.xyz"), sender="ann@example.xyz", emails=("ann@example.xyz",), html="<p>send USDT</p>", seen="send USDT"),
    envelope("all at once", "spf-fail dkim-absent dmarc-fail align-none rp-mismatch replyto-mismatch dn-brand from-tld mid-mismatch xmailer rcv-one subj-urgency body-form body-password",
             set={"Received": [LAST], "Authentication-Results": "mx; spf=fail smtp.mailfrom=b@bulk.example.net; dkim=none header.d=none; dmarc=fail header.from=example.tk", "Return-Path": "<b@bulk.example.net>", "From": "PayPal <pay@example.tk>",
                  "Reply-To": '"Help, now" <help@example.org>', "Subject": "=?utf-8?B?" + base64.b64encode("Acción requerida".encode()).decode() + "?=", "X-Mailer": "mass mailer"},
             html='<form action="https://paypal.example.net/login"><input type="password"></form>', links=[("https://paypal.example.net/login", "paypal.example.net", "enlace", ["url-creds", "url-brand"])],
             subject="Acción requerida", sender="pay@example.tk", emails=("pay@example.tk", "help@example.org", "b@bulk.example.net"), risky=True, chips=("fail", "warn", "fail", "not aligned", "unknown"), **_ONE_HOP),
]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
