"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, schemes, plus signs, dots
between digits, long digit runs and words that announce an identifier. From each
anchor a small parser walks outwards over the characters its kind allows and checks
what it finds, so text without anchors costs one pass of the automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import whole

Span = tuple[int, int, str]

#: Kinds of the contract in its order, then those the cues add.
KINDS = ("email", "ip", "card", "phone", "url_login", "account")
RANK = {kind: i for i, kind in enumerate(KINDS)}

#: Words that announce an identifier in what follows.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "cuenta", "compte")
SCHEME = "://"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([A-Za-z0-9._%+-]+:[^\s/@:]+)@")
_IDENTIFIER = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|id)?[ \t]*[:#=]?[ \t]*([A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", SCHEME, *CUES):
        found.add_word(anchor, (anchor, len(anchor)))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> tuple[Span | None, int]:
    """The address around the at-sign that does not begin before ``after``."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return ((start, domain.end(), "email"), domain.end()) if domain else (None, after)


def _digits(text: str, start: int, after: dict[str, int], out: list[Span]) -> None:
    """Dotted quads and cards whose first digit is at ``start``."""
    if start >= after["ip"] and (m := _IP.match(text, start)):
        after["ip"] = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((start, m.end(), "ip"))
    if start >= after["card"] and (m := _CARD.match(text, start)):
        after["card"] = m.end()
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((start, m.end(), "card"))


def _login(text: str, at: int) -> Span | None:
    m = _LOGIN.match(text, at)
    return (m.start(1), m.end(1), "url_login") if m else None


def _account(text: str, start: int, end: int) -> Span | None:
    """An identifier of six characters or more, with six digits, right after a cue."""
    if start and text[start - 1].isalnum():
        return None
    m = _IDENTIFIER.match(text, end)
    if m and sum(c.isdigit() for c in m[1]) >= 6:
        return m.start(1), m.end(1), "account"
    return None


def find(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then kind; code points, end exclusive.

    Matches of one kind are the leftmost that do not overlap; one that fails its check is
    dropped and what it covers is not tried again. Null and empty texts have no spans.
    """
    text = whole(text)
    # The automaton reports cues in lower case; lower() may change lengths outside ASCII.
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    out: list[Span] = []
    after = {"email": 0, "ip": 0, "card": 0, "phone": 0, "run": 0}
    for end, (anchor, length) in _ANCHORS.iter(lowered):
        start = end - length + 1
        if anchor == "0":
            if start >= after["run"]:
                after["run"] = _DIGITS.match(text, start).end()
                _digits(text, start, after, out)
            # A card or quad may end inside a run of digits only at the run's end, so
            # the next try is at the next run.
        elif anchor == "@":
            span, after["email"] = _email(text, start, after["email"])
            if span:
                out.append(span)
        elif anchor == "+":
            if start >= after["phone"] and (m := _PHONE.match(text, start)):
                after["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((start, m.end(), "phone"))
        elif anchor == SCHEME:
            if span := _login(text, start):
                out.append(span)
        elif span := _account(text, start, end + 1):
            out.append(span)
    return sorted(set(out), key=lambda s: (s[0], RANK[s[2]]))


def redact(text: str | None, spans: Iterable[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first one."""
    text, parts, at = whole(text), [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPAN_TYPE = "array<struct<start:int,end:int,kind:string>>"


def spans(text: Column) -> Column:
    """The spans of a text column."""

    @F.pandas_udf(SPAN_TYPE)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in find(t)] for t in texts], dtype=object)

    return found(text)


def _redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, find(t)) for t in texts], dtype=object)

    return clean(text)


def digest(found: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its key and spans.

    Null and empty texts have an empty list; repeated rows stay repeated; other columns
    are not read.
    """
    return docs.select(F.col(key).alias("doc_id"), spans(F.col(text)).alias("found"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets; all other
    columns and null texts as they are."""
    return docs.withColumn(text, _redacted(F.col(text)))
