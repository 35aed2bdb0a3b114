"""Personal data and secrets in documents, by anchors and local parsers.

An Aho-Corasick automaton finds the few characters and cues by which data can be told: at
signs, dots after digits, plus signs, digits, schemes and identifiers' names. From each
anchor a parser of its own expands to the borders of an address, number or account and
validates it. Spans of a kind don't overlap; the leftmost stays. Places are code points.

Base kinds: email, ip (parts up to 255), card (13 to 19 digits that pass Luhn), phone (9
to 15 digits). The method's own: url (with a scheme of letters, its last 12 if it has more),
secret (a token of SECRET characters at least, letters and digits among them, after a cue
such as `token =`), iban (anywhere, told by its country and checked by its remainder 97),
account (6 to 20 digits and hyphens after a cue such as `account no`).

Documents are handled one by one in Arrow batches; nothing is shuffled. Null texts count
as empty. Repeated rows are handled one by one. Extra columns are ignored by `find` and
kept by `redact`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
OWN_KINDS = ("url", "secret", "iban", "account")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn")
#: The least length of a secret.
SECRET = 16
# The countries of account numbers that have a check number.
COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY"
    " MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE"
).split()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"'|]+")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{%d,})" % SECRET)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_ACCOUNT = re.compile(r"(?:\s(?:no|nr|number|id))?[.:#=\s]{1,4}([0-9][0-9-]{4,18}[0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *((f"{d}", "digit") for d in range(10)), *((f"{d}.", "ip") for d in range(10))]:
        found.add_word(mark, (kind, len(mark)))
    for country in COUNTRIES:
        found.add_word(country, ("iban", len(country)))
    for kind, cues in (("secret", CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_end(found: str) -> int:
    """Where the longest account number at the beginning of found ends, which may have words
    in capitals after it; 0 without any."""
    ends = [len(found), *(i for i in range(len(found) - 1, 14, -1) if found[i] == " ")]
    for end in ends:
        s = found[:end].replace(" ", "")
        if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return end
    return 0


def spans_of(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in order. past: where the last match of a kind ended, valid or not."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *OWN_KINDS)}
    past = dict.fromkeys(out, 0)

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        past[kind] = end
        if valid:
            out[kind].append((start, end))

    for last, (kind, size) in automaton.iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= past["card"] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 13 <= len(digits) <= 19 and _luhn(digits))
            elif at >= past["card"]:
                past["card"] = at + 1
            continue
        if kind == "email" and at >= past["email"]:
            start = at
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end())
        elif kind == "ip" and last >= past["ip"]:
            start = at
            while start > past["ip"] and text[start - 1] in _DIGITS:
                start -= 1
            if start >= past["ip"] and (m := _QUAD.match(text, start)):
                # parts can be very long, and those with over three digits that count are too large
                take("ip", start, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()))
        elif kind == "phone" and at >= past["phone"]:
            if m := _PHONE.match(text, at):
                take("phone", at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif kind == "url" and at >= past["url"]:
            start = at
            while start > max(past["url"], at - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _URL.match(text, at)):
                take("url", start, start + len(text[start : m.end()].rstrip(".,;:!?)")))
        elif kind == "secret":
            if (m := _SECRET.match(text, last + 1)) and m.start(1) >= past["secret"]:
                value = m[1]
                take("secret", m.start(1), m.end(1), any(c in _DIGITS for c in value) and any(c.isalpha() for c in value))
        elif kind == "account":
            if (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= past["account"]:
                take("account", m.start(1), m.end(1))
        elif kind == "iban" and at >= past["iban"] and not (at and text[at - 1].isalnum()):
            if (m := _IBAN.match(text, at)) and (end := _iban_end(m[0])):
                take("iban", at, at + end)
    return out


def _listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in slices(batches):
        found = [spans_of(t.as_py() or "", automaton) for t in batch.column("text")]
        counts = [pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS]
        digests = pa.array([hashlib.sha256(_listed(s, KINDS).encode()).hexdigest() for s in found], pa.string())
        spans = pa.array([_listed(s, (*KINDS, *OWN_KINDS)) for s in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans, each
    kind:start:end) and spans (all of them)."""
    kind = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_find, kind)


def redacted(text: str, automaton: ahocorasick.Automaton) -> str:
    """The text with the name of its kind in place of each span; of overlapping spans the
    one that starts first, and then the longer one."""
    spans = sorted((a, -b, k) for k, own in spans_of(text, automaton).items() for a, b in own)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = -b
        elif -b > at:  # the rest of a span that another one has begun
            at = -b
    return "".join([*out, text[at:]])


def _redact(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        at = columns.index("text")
        for batch in slices(batches):
            texts = [None if (s := t.as_py()) is None else redacted(s, automaton) for t in batch.column("text")]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with personal data replaced in text; n_chars, if there, follows it."""
    out = docs.mapInArrow(_redact(docs.columns), docs.schema)
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out
