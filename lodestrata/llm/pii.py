"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs,
schemes and identifier cues) in one pass over a text. Around each anchor a
small deterministic parser finds the boundaries of a span and validates it.
Text without anchors costs the automaton's pass alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces

#: Kinds in the order that breaks ties between spans with the same start.
KINDS = ("email", "ip", "card", "phone", "account", "url", "secret")
BASE_KINDS = KINDS[:4]

_CUES = {"account": ("iban", "ssn", "account", "acct", "passport"), "secret": ("token", "api_key", "apikey", "password", "passwd", "secret")}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[ \t]*(?:(?:no|nr|number)\.?)?[ \t]*[:#=]?[ \t]*([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[ \t]*[:#=]?[ \t]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"[ \t]*(?:(?:no|nr|number|id)\.?)?[ \t]*[:#=][ \t]*([A-Z]{0,3}[0-9](?:-?[0-9]){5,16})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_\-/+]{16,})(?![A-Za-z0-9])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_USERINFO = re.compile(r"[^\s/@\"<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"<>]*)?")

_AUTOMATON = None


def automaton() -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        made = ahocorasick.Automaton()
        made.add_word("@", ("@", 1))
        made.add_word("+", ("+", 1))
        made.add_word("://", ("://", 3))
        for d in "0123456789":
            made.add_word(d, ("0", 1))
        for kind, cues in _CUES.items():
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    made.add_word(form, (kind, len(form)))
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, end exclusive, by start and then kind.

    Spans of one kind never overlap. A candidate that fails validation is
    consumed and not tried again at a later start.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    email = ip = card = phone = account = url = secret = 0  # where each kind may start again
    run_end = 0
    for at, (anchor, size) in automaton().iter(text):
        i = at - size + 1
        if anchor == "0":
            if i >= card and (m := _CARD.match(text, i)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((i, 2, card))
            if i >= ip and i >= run_end:
                if m := _IP.match(text, i):
                    ip = m.end()
                    if all(map(_octet, m[0].split("."))):
                        found.append((i, 1, ip))
                else:  # later digits of the same run cannot match either
                    run_end = _DIGITS.match(text, i).end()
        elif anchor == "@":
            start = i
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append((start, 0, email))
        elif anchor == "+":
            if i >= phone and (m := _PHONE.match(text, i)):
                phone = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((i, 3, phone))
        elif anchor == "account":
            if (m := _IBAN.match(text, at + 1)) and m.start(1) >= account and _iban(m[1]) or (m := _SSN.match(text, at + 1) or _NUMBER.match(text, at + 1)) and m.start(1) >= account:
                account = m.end(1)
                found.append((m.start(1), 4, account))
        elif anchor == "://":
            if i >= url and (left := _SCHEME.search(text, max(url, i - 16), i)) and (m := _USERINFO.match(text, at + 1)):
                url = m.end()
                found.append((left.start(), 5, url))
        elif anchor == "secret":
            if (m := _SECRET.match(text, at + 1)) and m.start(1) >= secret and any(c.isdigit() for c in m[1]):
                secret = m.end(1)
                found.append((m.start(1), 6, secret))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def written(found: list[tuple[str, int, int]]) -> str:
    """Spans as ``kind:start:end``, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, a count for each base kind, ``base_sha256, spans``.

    Null and empty texts have no spans. Repeated rows give repeated rows; an
    empty table gives none; no other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            each = [spans(t) for t in batch.column("text").to_pylist()]
            base = [[x for x in s if x[0] in BASE_KINDS] for s in each]
            counts = [pa.array([sum(x[0] == k for x in s) for s in base], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *counts, digests, pa.array(map(written, each), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    id_type = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
