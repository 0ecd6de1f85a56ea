"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text, with A-Z in small letters, and finds anchors:
at-signs, plus signs, digits, ``://``, identifier cues in any case ("iban", "account", "token", ...) and
the fixed beginnings of common keys. At each anchor a deterministic local parser expands to the
boundaries of the datum and validates it.

Kinds, in the order of results: email, ip, card, phone (defined by fixed patterns, leftmost and not
overlapping per kind); then what the method adds: ``address`` (the authority after a scheme, where it
names a user or a numeric host) and ``account``: an identifier after a cue, over linking words and marks
("no.", "is", ":", ...), with at least four digits; after "iban" it must pass the mod-97 test; after
"password" and the like and a colon or equals sign it may be any token that is no plain word; dates are
none, but its digits may stand in groups of two to four; after words for keys it may have no digits, if it mixes small
and large letters over sixteen characters. Keys with a known beginning, web tokens of three parts and private key blocks need no cue. One
narrow map over the scan, no shuffle.

Edge cases: null text is empty and has no spans; offsets are code points, ends exclusive; texts are
scanned whole, however long; repeated rows are scanned each for itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from larkstream.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = 4
#: Cues that announce an identifier, those that announce a secret, and beginnings of keys with the least length after them.
CUES = ("aba", "access key", "access_key", "account", "acct", "api key", "api-key", "api_key", "apikey", "bearer", "customer id", "customer number", "customer_id", "employee id", "employee number", "employee_id", "iban", "id card", "konto", "licence", "license", "medical record", "member id", "mrn", "national id", "passport", "patient id", "personal id", "policy", "routing", "social security", "ssn", "staff id", "student id", "tax id", "user id", "user_id")
SECRETS = ("client secret", "client_secret", "passphrase", "passwd", "password", "passwort", "pwd", "secret", "token")
KEY_CUES = ("access key", "access_key", "api key", "api-key", "api_key", "apikey", "bearer", "client secret", "client_secret", "secret", "token")
KEYS = {"AIza": 30, "AKIA": 16, "ASIA": 16, "ghp_": 20, "gho_": 20, "ghs_": 20, "ghu_": 20, "github_pat_": 20, "glpat-": 16, "rk_live_": 16, "sk_live_": 16, "sk_test_": 16, "sk-": 20, "xoxa-": 10, "xoxb-": 10, "xoxp-": 10, "npm_": 30, "SG.": 30}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_LINK = re.compile(r"(?:[\x20\t]*+(?:(?:no|nr|num)\.?(?![A-Za-z])|(?:number|nummer|id|key|code|value|is|was|ist)(?![A-Za-z])|=>|[:=#]))*+[\x20\t]*+[\"'(<\[]?(?=[A-Za-z0-9])", re.I)
_IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_./+~-]*[A-Za-z0-9])?={0,2}(?![A-Za-z0-9])")
_SECRET = re.compile(r"[^\s\"'<>,;]+")
_KEY_REST = re.compile(r"[A-Za-z0-9_.=-]*[A-Za-z0-9=]")
_WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*[A-Za-z0-9_]")
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})$")
_BLOCK = "-----BEGIN "
_BLOCK_HEAD = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_BLOCK_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
_GROUPED = re.compile(r"[0-9]{2,4}(?:[\x20-][0-9]{2,4})+(?![A-Za-z0-9])")
_SPACED_DATE = re.compile(r"(?:19|20)[0-9]{2}[\x20-][0-9]{2}[\x20-][0-9]{2}$|[0-9]{2}[\x20-][0-9]{2}[\x20-](?:19|20)[0-9]{2}$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for anchor in "@+0123456789":
        a.add_word(anchor, (anchor if anchor in "@+" else "0", 1, ""))
    a.add_word("://", ("/", 3, ""))
    for cue in CUES + SECRETS:
        a.add_word(cue, ("cue", len(cue), cue))
    for key in (*KEYS, "eyJ", _BLOCK):
        a.add_word(key.lower(), ("key", len(key), key))
    a.make_automaton()
    return a


_SMALL = {i: i + 32 for i in range(65, 91)}


def folded(text: str) -> str:
    """text with A-Z in small letters and every character in its place."""
    small = text.lower()
    return small if len(small) == len(text) else text.translate(_SMALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1  # small letters count as large ones


class Finder:
    """Finds the spans of one text after another."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[list[tuple[int, int]]]:
        """For each kind its spans by start."""
        found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        self.ends = True  # whether a key block may still end in this text
        done = [0] * len(KINDS)  # where each kind's next span may start
        for last, (anchor, length, name) in self.anchors.iter(folded(text)):
            at = last + 1 - length
            if anchor == "0":
                if at >= done[1]:
                    done[1] = self.ip(text, at, found[1])
                if at >= done[2]:
                    done[2] = self.card(text, at, found[2])
            elif anchor == "@":
                if at >= done[0]:
                    done[0] = self.email(text, at, done[0], found[0])
            elif anchor == "+":
                if at >= done[3]:
                    done[3] = self.phone(text, at, found[3])
            elif anchor == "/":
                if at >= done[4]:
                    done[4] = self.address(text, last + 1, found[4])
            elif at >= done[5] and (at == 0 or not text[at - 1].isalnum()):
                done[5] = self.key(text, at, name, found[5]) if anchor == "key" else self.account(text, last + 1, name, found[5])
        return found

    @staticmethod
    def email(text: str, at: int, least: int, out: list) -> int:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if not m:
            return least
        out.append((start, m.end()))
        return m.end()

    @staticmethod
    def ip(text: str, at: int, out: list) -> int:
        m = _IP.match(text, at)
        if not m:
            return _DIGITS.match(text, at).end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((at, m.end()))
        return m.end()

    @staticmethod
    def card(text: str, at: int, out: list) -> int:
        m = _CARD.match(text, at)
        if not m:
            return at + 1
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((at, m.end()))
        return m.end()

    @staticmethod
    def phone(text: str, at: int, out: list) -> int:
        m = _PHONE.match(text, at)
        if not m:
            return at + 1
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((at, m.end()))
        return m.end()

    @staticmethod
    def address(text: str, after: int, out: list) -> int:
        m = _AUTHORITY.match(text, after)
        if m and ("@" in m[0][1:-1] or _IP.match(m[0]) or m[0].startswith("[")):
            out.append((after, m.end()))
            return m.end()
        return after

    @staticmethod
    def account(text: str, after: int, cue: str, out: list) -> int:
        lead = _LINK.match(text, after)
        if not lead:
            return after
        marked = "=" in lead[0] or ":" in lead[0]
        if cue == "iban":
            m = _IBAN.match(text, lead.end())
            while m and not iban_ok(m[0]) and " " in m[0]:  # words after it may look like its last groups
                m = _IBAN.match(text, lead.end(), lead.end() + m[0].rindex(" "))
            ok = m and iban_ok(m[0])
        else:
            m = _GROUPED.match(text, lead.end())
            ok = m and sum(c in "0123456789" for c in m[0]) >= 7 and not _SPACED_DATE.match(m[0])
            if not ok:
                m = _IDENTIFIER.match(text, lead.end())
                ok = m and len(m[0]) >= 6 and sum(c in "0123456789" for c in m[0]) >= 4 and not _DATE.match(m[0])
            if not ok and m and cue in KEY_CUES:
                ok = marked and len(m[0]) >= 16 and not m[0].islower() and not m[0].isupper() and not m[0].istitle() and any(c.islower() for c in m[0])
            if not ok and cue in SECRETS:
                m = _SECRET.match(text, lead.end())
                ok = m and len(m[0]) >= 6 and not m[0].rstrip(".!?)").isalpha() and not m[0].startswith(("http:", "https:"))
                ok = ok and (marked or lead[0].rstrip(" \t\"'(<[").lower().endswith((" is", " was", " ist")) and any(c.isalpha() for c in m[0]) and any(c in "0123456789" for c in m[0]))
        if not ok:
            return after
        out.append((m.start(), m.end()))
        return m.end()

    def key(self, text: str, at: int, name: str, out: list) -> int:
        if not text.startswith(name, at):  # keys begin in the given case
            return at
        if name == _BLOCK:
            head = _BLOCK_HEAD.match(text, at)
            end = head and self.ends and _BLOCK_END.search(text, head.end())
            if head and not end:
                self.ends = False  # what has no end from here on has none later
            span = (at, end.end() if end else head.end()) if head else None
        elif name == "eyJ":
            m = _WEB_TOKEN.match(text, at)
            span = m and m.span()
        else:
            m = _KEY_REST.match(text, at + len(name))
            span = (at, m.end()) if m and len(m[0]) >= KEYS[name] and any(c in "0123456789" for c in m[0]) else None
        if not span:
            return at
        out.append(span)
        return span[1]


def _joined(found: list, kinds: int) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k in range(kinds) for a, b in found[k])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_address, n_account, n_spans (of all kinds)."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", *counts[:BASE], "base_sha256", "spans", *counts[BASE:], "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [finder.spans(t.as_py() or "") for t in batch.column(1)]
            n = [pa.array([len(f[k]) for f in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found], pa.string())
            spans = pa.array([_joined(f, len(KINDS)) for f in found], pa.string())
            total = pa.array([sum(map(len, f)) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *n[:BASE], digest, spans, *n[BASE:], total], names)

    longs = lambda c: ", ".join(f"{x} long" for x in c)
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {longs(counts[:BASE])}, base_sha256 string, spans string, {longs(counts[BASE:])}, n_spans long")
