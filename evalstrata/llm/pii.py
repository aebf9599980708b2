"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
schemes, plus signs, identifier cues ("account", "IBAN", ...) and credential cues
("password", "token", ...); runs of digits are the anchors of numbers.  A deterministic parser expands each anchor to both
sides and validates what it got (labels of a domain, octets, Luhn, mod 97).
Every parser reads a stretch once, so a text costs time in proportion to its
length however hostile it is.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "userinfo", "credential")
CUES = ("account", "acct", "a/c", "iban", "konto", "kontonummer", "compte", "cuenta", "customer id", "passport", "ssn")
CREDENTIAL_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")
#: Fixed value: how the public form of an access key id begins; 16 capitals and digits follow.
KEY_ID = "AKIA"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?:[^\S\n]|[:#.=]|no|nr|number|is){0,12}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){0,40})", re.IGNORECASE)
_AUTHORITY = re.compile(r"[^\s/?#]+")
_CREDENTIAL = re.compile(r"[^\S\n]?[=:][^\S\n]?[\"']?([^\s\"']{8,})")
_KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://"):
        found.add_word(anchor, (anchor, len(anchor)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    for cue in CREDENTIAL_CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("credential", len(form)))
    found.add_word(KEY_ID, (KEY_ID, len(KEY_ID)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def octet(digits: str) -> bool:
    """At most 255, with any number of leading zeros."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _email(text: str, at: int, floor: int) -> Span | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    match = _DOMAIN.match(text, at + 1) if start < at else None
    return ("email", start, match.end()) if match else None


def _numbers(text: str) -> list[Span]:
    """Addresses (four runs of digits joined by points) and cards (runs joined by a space or hyphen)."""
    out: list[Span] = []
    dotted, joined = [], []  # runs of the chain so far

    def card() -> None:
        if joined:
            if 16 <= sum(b - a for a, b in joined) <= 19 and luhn("".join(text[a:b] for a, b in joined)):
                out.append(("card", joined[0][0], joined[-1][1]))

    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if dotted and not (a == dotted[-1][1] + 1 and text[a - 1] == "."):
            dotted = []
        dotted.append((a, b))
        if len(dotted) == 4:
            if all(octet(text[x:y]) for x, y in dotted):
                out.append(("ip", dotted[0][0], b))
            dotted = []
        if joined and not (a == joined[-1][1] + 1 and text[a - 1] in " -"):
            card()
            joined = []
        joined.append((a, b))
    card()
    return out


def _identifier(text: str, end: int) -> Span | None:
    """The account after a cue: an IBAN, or 6 to 18 digits at its start."""
    if end < len(text) and text[end].isalnum():
        return None
    match = _NUMBER.match(text, end)
    if not match:
        return None
    run, start = match[1], match.start(1)
    compact = re.sub(r"[ -]", "", run).upper()
    if re.match(r"[A-Z]{2}[0-9]{2}", compact):
        for n in range(min(34, len(compact)), 14, -1):
            if mod97(compact[:n]):
                at, seen = start, 0
                while seen < n:
                    seen += text[at].isalnum()
                    at += 1
                if at == len(text) or not text[at].isalnum():
                    return ("iban", start, at)
    digits = re.match(r"[0-9](?:[ -]?[0-9])*", run)
    if digits and 6 <= sum(c.isdigit() for c in digits[0]) <= 18 and not run[digits.end() : digits.end() + 1].isalpha():
        return ("account", start, start + digits.end())
    return None


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by kind as in KINDS, then by start; those beyond the base kinds never overlap one."""
    base, more, floor, read = [], [], 0, 0
    for last, (kind, length) in anchors.iter(text):
        if kind == "@":
            span = _email(text, last, floor)
            if span:
                base.append(span)
                floor = span[2]
        elif kind == "+":
            match = _PHONE.match(text, last)
            if match and 8 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
                base.append(("phone", last, match.end()))
        elif kind == "://":
            match = _AUTHORITY.match(text, last + 1)
            user = match[0].rpartition("@")[0] if match else ""
            if ":" in user:
                more.append(("userinfo", last + 1, last + 1 + len(user)))
        elif last + 1 - length > 0 and text[last - length].isalnum():
            continue
        elif kind == "credential":
            match = _CREDENTIAL.match(text, last + 1) if last >= read else None  # a cue inside an earlier value is none
            if match:
                read = match.end()
                value = match[1].rstrip(".,;:)]}>")
                if len(value) >= 8:
                    more.append(("credential", match.start(1), match.start(1) + len(value)))
        elif kind == KEY_ID:
            match = _KEY_ID.match(text, last + 1)
            if match:
                more.append(("credential", last + 1 - length, match.end()))
        else:
            span = _identifier(text, last + 1)
            if span:
                more.append(span)
    base += _numbers(text)
    starts, ends = [], []  # the stretches that base spans take, apart from each other, in order
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    floor = 0
    for span in sorted(set(more), key=lambda s: (s[1], -s[2])):
        before = bisect_left(starts, span[2]) - 1
        if span[1] >= floor and (before < 0 or ends[before] <= span[1]):
            base.append(span)
            floor = span[2]
    return sorted(base, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping ones become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """doc_id, row, a count of each base kind, n_spans (of all kinds), base and spans (kind:start:end, comma-joined) and redacted (the text without them).

    A null text is an empty one, without spans; repeated rows are searched each;
    other columns are ignored; an empty table gives no rows.  Without
    ``redacted`` that column is null.
    """

    def step(batch: pa.RecordBatch) -> dict:
        anchors = automaton()
        texts = [x.decode() for x in frames.blobs(batch["data"])]
        found = [find(t, anchors) for t in texts]
        out = {c: batch[c] for c in ("doc_id", "row")}
        for kind in BASE_KINDS:
            out[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in spans) for spans in found], pa.int64())
        out["n_spans"] = pa.array(map(len, found), pa.int64())
        out["base"] = [_joined([s for s in spans if s[0] in BASE_KINDS]) for spans in found]
        out["spans"] = [_joined(spans) for spans in found]
        out["redacted"] = pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)] if redacted else [None] * len(texts), pa.string())
        return out

    schema = "doc_id long, row int, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "n_spans long, base string, spans string, redacted string"
    return frames.columns(frames.documents(docs, id_col, text_col), schema, step)


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind in brackets; a null text stays null, an empty one empty."""

    def run(batches):
        anchors = automaton()
        for batch in batches:
            texts = [None if t is None else redact(t, find(t, anchors)) for t in batch[text_col].to_pylist()]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return frames.mapped(docs, run, docs.schema)
