"""Full-text search: vectors of terms with positions, queries, matches and ranks.

All of it is column expressions. A text's vector is its terms with their positions, which
are counted from 1 before stop words go. Queries are constants: they are parsed once, on
the driver, and become conditions on the vector, each a pass over it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The english dictionary's stop words.
STOP_WORDS = "a an and are as at be by for from in into is it of on or that the their there this to was were with".split()


# The english dictionary's endings, in the order in which they are tried. A word
# longer than `least` that has the ending (and not `unless`) loses `cut` letters and gets
# `more`; `vowel`: only if what is left has a vowel.
ENDINGS = [
    # ending, least, cut, more, vowel, unless
    ("ies", 5, 3, "y", False, None),
    ("sses", 5, 2, "", False, None),
    ("ing", 4, 3, "", True, None),
    ("ed", 4, 2, "", True, None),
    ("es", 4, 2, "", False, None),
    ("s", 3, 1, "", False, "ss"),
]
VOWELS = "[aeiouy]"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))


def _stem(w: Column) -> Column:
    out = w
    for ending, least, cut, more, vowel, unless in reversed(ENDINGS):
        left = F.substring(w, F.lit(1), F.length(w) - cut)
        fits = (F.length(w) > least) & w.endswith(ending)
        fits = fits & ~w.endswith(unless) if unless else fits
        out = F.when(fits & left.rlike(VOWELS) if vowel else fits, F.concat(left, F.lit(more))).otherwise(out)
    return out


def _stem_word(w: str) -> str:
    for ending, least, cut, more, vowel, unless in ENDINGS:
        if len(w) > least and w.endswith(ending) and not (unless and w.endswith(unless)) and (not vowel or re.search(VOWELS, w[:-cut])):
            return w[:-cut] + more
    return w


def normalise(word: str, config: str = "simple") -> str:
    """A query word as the dictionary has it; empty for stop words."""
    low = word.lower()
    if config not in ("simple", "english"):
        raise ValueError(f"unknown dictionary: {config!r}")
    return low if config == "simple" else "" if low in STOP_WORDS else _stem_word(low)


def vector(text: Column, config: str = "simple") -> Column:
    """array<struct<t: term, p: position>>, in the order of positions."""
    found = F.transform(words(text), lambda w, i: F.struct(F.lower(w).alias("t"), (i + 1).alias("p")))
    if config == "english":
        found = F.transform(F.filter(found, lambda x: ~x["t"].isin(STOP_WORDS)), lambda x: F.struct(_stem(x["t"]).alias("t"), x["p"].alias("p")))
    elif config != "simple":
        raise ValueError(f"unknown dictionary: {config!r}")
    return found


def vector_text(v: Column) -> Column:
    """term:position,position for each term, in the terms' order."""
    rows = F.array_sort(v)
    before = F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0)))
    first = F.transform(F.slice(rows, 1, 1), lambda x: F.concat(x["t"], F.lit(":"), x["p"].cast("string")))
    rest = F.zip_with(
        F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
        before,
        lambda x, y: F.when(x["t"] == y["t"], F.concat(F.lit(","), x["p"].cast("string"))).otherwise(F.concat(F.lit(" "), x["t"], F.lit(":"), x["p"].cast("string"))),
    )
    return F.array_join(F.concat(first, rest), "")


def positions(v: Column, term: str, prefix: bool = False) -> Column:
    same = (lambda x: x["t"].startswith(term)) if prefix else (lambda x: x["t"] == term)
    return F.transform(F.filter(v, same), lambda x: x["p"])


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    node: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


def _join(kind, nodes: list):
    nodes = [n for n in nodes if n is not None]
    out = nodes[0] if nodes else None
    for n in nodes[1:]:
        out = kind(out, n)
    return out


def _words(text: str, config: str) -> list[str]:
    return [t for w in re.findall(r"[^\W]+", text) if (t := normalise(w, config))]


def plain_query(text: str, config: str = "simple"):
    """All words."""
    return _join(Both, [Term(t) for t in _words(text, config)])


def phrase_query(text: str, config: str = "simple"):
    """The words one after the other."""
    found = _words(text, config)
    return Phrase(tuple(found)) if len(found) > 1 else Term(found[0]) if found else None


def web_query(text: str, config: str = "simple"):
    """Words, "phrases", OR between them, and - before what must not stand."""
    groups: list[list] = [[]]
    for minus, quoted, word in re.findall(r"(-?)(?:\"([^\"]*)\"|([^\s\"]+))", text):
        if word.upper() == "OR" and not minus:
            groups.append([])
            continue
        node = phrase_query(quoted, config) if quoted else plain_query(word, config)
        if node is not None:
            groups[-1].append(Not(node) if minus else node)
    return _join(Either, [_join(Both, g) for g in groups])


def query(text: str, config: str = "simple"):
    """Terms with & | ! ( ) <-> and :* for beginnings."""
    tokens = re.findall(r"<->|[&|!()]|[^\s&|!()<]+", text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def single():
        token = peek()
        if token is None:
            return None
        take()
        if token == "!":
            inner = single()
            return None if inner is None else Not(inner)
        if token == "(":
            inner = either()
            if peek() == ")":
                take()
            return inner
        prefix = token.endswith(":*")
        term = normalise(token.removesuffix(":*").strip("'"), config)
        return Term(term, prefix) if term else None

    def following():
        left = single()
        while peek() == "<->":
            take()
            right = single()
            terms = [t for n in (left, right) if n for t in (n.terms if isinstance(n, Phrase) else (n.text,) if isinstance(n, Term) else ())]
            left = Phrase(tuple(terms)) if len(terms) > 1 else left or right
        return left

    def both():
        parts = [following()]
        while peek() == "&":
            take()
            parts.append(following())
        return _join(Both, parts)

    def either():
        parts = [both()]
        while peek() == "|":
            take()
            parts.append(both())
        return _join(Either, parts)

    return either()


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def matches(v: Column, node) -> Column:
    """False for an empty query."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Term):
        return F.exists(v, (lambda x: x["t"].startswith(node.text)) if node.prefix else (lambda x: x["t"] == node.text))
    if isinstance(node, Phrase):
        places = [_moved(positions(v, t), i) for i, t in enumerate(node.terms)]
        both = places[0]
        for p in places[1:]:
            both = F.array_intersect(both, p)
        return F.size(both) > 0
    if isinstance(node, Not):
        return ~matches(v, node.node)
    left, right = matches(v, node.left), matches(v, node.right)
    return left & right if isinstance(node, Both) else left | right


def _positive(node) -> int:
    if isinstance(node, Term):
        return 1
    if isinstance(node, Phrase):
        return len(node.terms)
    return 0 if node is None or isinstance(node, Not) else _positive(node.left) + _positive(node.right)


def _value(v: Column, node) -> Column:
    if isinstance(node, Term):
        count = F.size(positions(v, node.text))
        if node.prefix:
            count = F.when(count > 0, count).otherwise(F.size(positions(v, node.text, True)))
        return count.cast("double")
    if isinstance(node, Phrase):
        return F.when(matches(v, node), float(len(node.terms))).otherwise(0.0)
    if isinstance(node, Not):
        return F.lit(0.0)
    left, right = _value(v, node.left), _value(v, node.right)
    return left + right if isinstance(node, Both) else F.greatest(left, right)


def rank(v: Column, node, normalization: int = 0) -> Column:
    """0 unless the query matches; else occurrences (and: added, or: the larger, phrases by
    their length) over the number of positive terms, divided as the bits 1, 2, 8 and 16 of
    normalization say: 1 + ln(words), words, distinct words, 1 + ln(distinct words)."""
    n = _positive(node)
    if not n:
        return F.lit(0.0)
    total = F.greatest(F.size(v), F.lit(1)).cast("double")
    distinct = F.greatest(F.size(F.array_distinct(F.transform(v, lambda x: x["t"]))), F.lit(1)).cast("double")
    out = _value(v, node) / n
    for bit, by in ((1, 1 + F.log(total)), (2, total), (8, distinct), (16, 1 + F.log(distinct))):
        if normalization & bit:
            out = out / by
    return F.when(matches(v, node), out).otherwise(0.0)
