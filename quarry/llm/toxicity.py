"""Toxicity of documents: a learned lexicon in a trie, matched by Levenshtein automata, with
context windows.

1. Words and word beginnings are counted in labelled rows (not the held-out ones), toxic and
   clean ones alike. Copies and near copies count once: of rows with the same label whose
   smallest hash of five words is the same, the one with the smallest doc_id. Terms that
   favour toxic rows beyond chance (log-likelihood ratio above a bound that grows with the
   number of terms tested) are the lexicon, beside a few seed terms. It is learned from
   `labelled` rows at most, by a hash of doc_id, and so its size doesn't grow with the data.
2. The terms stand in a trie. Levenshtein automata of all terms run together with it: a
   state is the set of trie nodes with the errors on the way to them, and states are made
   when first met, so that a word costs a table look-up for each letter. Short terms match
   exactly, longer ones with one or two errors; beginnings match exactly.
3. A match counts by its term's weight, its errors, and its context: words around it that
   tell of quotation or report (and quotation marks at the word) lower it, words of address
   raise it. Weights of a term's misspelled matches are learned as their own, since some
   terms have harmless neighbours.
4. A document's sum is over its distinct matched words; its score is the logistic
   function of the sum, with slope and prior fitted on the same labelled rows (by a
   histogram of their sums, which has a fixed number of bins).

Labels are read only where crc32(doc_id as text) mod 3 is not 1; label, lang, source and
doc_id are no inputs of a score. Null and empty texts get the prior's score. Repeated rows
get the same score. Extra columns are ignored. Without labels the seed terms decide. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, written
from .textnum import Words, place, runs

LABELLED = 200_000
#: Terms that count without any labels.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "scumbag")
SEED_WEIGHT = 4.0
QUOTATION = frozenset("said says quoted quote quotes wrote writes called word words term terms phrase reported report example alleged".split())
ADDRESS = frozenset("you your youre u are".split())
AROUND, QUOTED, ADDRESSED = 4, 0.5, 1.2
PREFIXES = (4, 5, 6)
BIN, BINS = 0.25, 400


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Lexicon:
    """weights: (term, kind) to weight; kind 0: whole word, 1: misspelled, 2: beginning."""

    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    prior: float = -2.0
    slope: float = 1.0

    def terms(self) -> list[tuple[str, int, int]]:
        """(term, kind, errors): terms whose misspelled matches weigh nothing allow none."""
        near = {t for t, kind in self.weights if kind == 1}
        return sorted({(t, 2, 0) if kind == 2 else (t, 0, errors_for(t) if t in near else 0) for t, kind in self.weights})


def errors_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Levenshtein automata of all terms over one trie, made deterministic as words come."""

    def __init__(self, terms: list[tuple[str, int, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.begin: list[str | None] = [None]
        self.most = [0]  # the errors that the longest term below a node may have
        self.errors = {term: k for term, kind, k in terms if kind == 0}
        for term, kind, k in terms:
            node = 0
            self.most[0] = max(self.most[0], k)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.whole.append(None)
                    self.begin.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], k)
            if kind == 0:
                self.whole[node] = term
            else:
                self.begin[node] = term
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[list[tuple[str, int]]] = []
        self.starts: list[list[tuple[str, int]]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # terms' letters that the word lacks
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.most[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.accepts.append([(t, min(e, 1)) for n, e in key if (t := self.whole[n]) and e <= self.errors[t]])
            self.starts.append([(t, 2) for n, e in key if e == 0 and (t := self.begin[n])])
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.most[child] and cost < after.get(child, 9):
                    after[child] = cost
            if e + 1 <= self.most[node] and e + 1 < after.get(node, 9):
                after[node] = e + 1
        to = self._state(after) if after else -1
        self.next[state][letter] = to
        return to

    def match(self, word: str) -> tuple[tuple[str, int], ...]:
        """(term, kind) for each term that the word is, nearly is, or begins with."""
        state, found = self.start, []
        for letter in word:
            to = self.next[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return tuple(found)
            if self.starts[state]:
                found += self.starts[state]
        return tuple(found + self.accepts[state])


def _bare(word: str) -> str:
    return word.strip("\"'«»“”‘’()[]{}.,;:!?#*$%&|<>-_…")


def _kinds_of(words: int = 5):
    """(doc_id, toxic, kind): kind the smallest hash of `words` words of a row; of all words
    where there are fewer. Rows that are nearly the same mostly share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column("text"), lower=True)
            h, first = w.hashes(), w.first
            grams = runs(h, words)
            kinds = np.zeros(batch.num_rows, np.uint64)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                if b > a:
                    kinds[i] = grams[a : b - words + 1].min() if b - a >= words else runs(h[a:b], int(b - a))[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(place(kinds))], ["doc_id", "toxic", "kind"])

    return run


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, clean, toxic): of words and beginnings, in how many rows of a slice they stand."""
    for batch in slices(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {_bare(w) for w in (text or "").lower().split()} - {""}
            own = {(w, 0) for w in words}
            own.update((w[:k], 2) for w in words for k in PREFIXES if k < len(w))
            counts[toxic].update(own)
        keys = list(counts[0].keys() | counts[1].keys())
        if keys:
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "kind", "clean", "toxic"])


def _hits_of(lexicon: Lexicon):
    """(term, kind, clean, toxic): in how many rows of a slice the lexicon matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon.terms())
        for batch in slices(batches):
            counts: dict[tuple[str, int], list[int]] = {}
            toxic = batch.column("toxic").to_pylist()
            for i, found in enumerate(_found(batch.column("text"), matcher)):
                for hit in {h for _, hits in found for h in hits}:
                    counts.setdefault(hit, [0, 0])[toxic[i]] += 1
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["term", "kind", "clean", "toxic"])

    return run


def _found(texts: pa.Array, matcher: Matcher, words: Words | None = None) -> list[list[tuple[int, tuple]]]:
    """For each text the places of its words with matches, and these."""
    w = words or Words(texts)
    _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    hits = [matcher.match(_bare(w.text(i).lower())) for i in first]
    some = np.fromiter((bool(h) for h in hits), bool, len(hits))
    out: list[list[tuple[int, tuple]]] = [[] for _ in range(len(texts))]
    at = np.flatnonzero(some[back]) if len(back) else []
    for i, row in zip(at, np.searchsorted(w.first, at, "right") - 1):
        out[row].append((int(i), hits[back[i]]))
    return out


def _context(w: Words, low: int, high: int, i: int) -> float:
    own = w.text(i)
    around = [_bare(w.text(k).lower()) for k in range(max(low, i - AROUND), min(high, i + AROUND + 1)) if k != i]
    quoted = own[0] in "\"'«“‘„" or own.rstrip(".,;:!?")[-1:] in ("\"", "'", "»", "”", "’") or any(x in QUOTATION for x in around)
    return (QUOTED if quoted else 1.0) * (ADDRESSED if any(x in ADDRESS for x in around) else 1.0)


def _sums(batch: pa.RecordBatch, lexicon: Lexicon, matcher: Matcher) -> list[tuple[float, set[str]]]:
    """For each row the sum of its matches, and their terms."""
    w = Words(batch.column("text"))
    out = []
    for row, found in enumerate(_found(batch.column("text"), matcher, w)):
        best: dict[str, float] = {}
        terms = set()
        for i, hits in found:
            term, weight = max(((t, lexicon.weights.get((t, kind), 0.0)) for t, kind in hits), key=lambda x: x[1])
            if weight > 0:
                word = _bare(w.text(i).lower())
                best[word] = max(best.get(word, 0.0), weight * _context(w, w.first[row], w.first[row + 1], i))
                terms.add(term)
        out.append((sum(best.values()), terms))
    return out


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon.terms())
        for batch in slices(batches):
            sums = _sums(batch, lexicon, matcher)
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.prior + lexicon.slope * x)))) for x, _ in sums]
            terms = [",".join(sorted(t)) for _, t in sums]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.7) for x in scores], pa.int32()), pa.array(terms, pa.string())], ["doc_id", "held_out", "score", "predicted", "terms"])

    return run


def _binned(lexicon: Lexicon):
    """(bin, clean, toxic): rows by their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon.terms())
        counts = np.zeros((2, BINS), np.int64)
        for batch in slices(batches):
            for (x, _), toxic in zip(_sums(batch, lexicon, matcher), batch.column("toxic").to_pylist()):
                counts[toxic, min(BINS - 1, int(x / BIN + 0.5))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], ["bin", "clean", "toxic"])

    return run


def fit_logistic(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope is held by a small ridge."""
    a, b, n = math.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0, clean + toxic
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(toxic - n * p).sum() - ridge * a, ((toxic - n * p) * x).sum() - ridge * b])
        v = n * p * (1 - p)
        h = np.array([[v.sum() + ridge, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _ratio(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Twice the log-likelihood ratio of a term's counts, 0 where it doesn't favour toxic rows."""
    n, share = n_clean + n_toxic, n_toxic / max(1, n_clean + n_toxic)
    with_term = clean + toxic
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    rest = n - with_term
    g = 2 * (part(toxic, with_term * share) + part(clean, with_term * (1 - share)) + part(n_toxic - toxic, rest * share) + part(n_clean - clean, rest * (1 - share)))
    return F.when(toxic > with_term * share, g).otherwise(0.0)


def _pruned(weights: dict[tuple[str, int], float]) -> dict[tuple[str, int], float]:
    """Without words and beginnings that a shorter beginning of about their weight covers:
    they add nothing, and the automaton stays small."""
    out = {}
    for (term, kind), weight in sorted(weights.items(), key=lambda x: (len(x[0][0]), x[0])):
        covered = any(out.get((term[:k], 2), 0.0) >= 0.7 * weight for k in PREFIXES if k < len(term))
        if not covered or (term in SEEDS and kind == 0):
            out[term, kind] = weight
    return out


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Lexicon:
    """The lexicon from labelled rows that aren't held out, at most `labelled` of them."""
    marks = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = bounded(marks.filter("toxic in (0, 1)"), "doc_id", labelled)
    rows = lambda of: docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(of), "doc_id")
    kinds = rows(marks).select("doc_id", "toxic", "text").mapInArrow(_kinds_of(), "doc_id long, toxic int, kind long")
    one = written(kinds.groupBy("toxic", "kind").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct())
    rows = rows(one).select("text", "toxic")
    n = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    prior = math.log((n_toxic + 1) / (n_clean + 10)) if n_toxic else -2.0
    lexicon = Lexicon({(t, 0): SEED_WEIGHT for t in SEEDS}, min(prior, -1.0))
    if not n_clean or not n_toxic:
        return lexicon
    shape = "term string, kind int, clean long, toxic long"
    counted = rows.mapInArrow(_terms_of, shape).groupBy("term", "kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.withColumn("ratio", _ratio(F.col("clean"), F.col("toxic"), n_clean, n_toxic))
    # beyond chance for all terms that were tested; that are about as many as their rows
    bound = 2 * math.log(1000 * (n_clean + n_toxic)) + 2
    weight = lambda clean, toxic: math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    chosen = counted.filter(F.col("ratio") >= bound).filter(F.col("toxic") * n_clean > 4 * F.col("clean") * n_toxic)
    # terms come to the driver; each has some of the labelled rows' toxic ones to itself
    found = {(r["term"], r["kind"]): r for r in chosen.collect()}
    whole = sorted((t, r["toxic"]) for (t, kind), r in found.items() if kind == 0)
    for (term, kind), r in found.items():
        # a beginning has to stand for more words than one
        one = max((n for t, n in whole[bisect_left(whole, (term, 0)) : bisect_left(whole, (term + "\U0010ffff", 0))]), default=0)
        if kind == 0 or 10 * r["toxic"] > 11 * one:
            lexicon.weights[term, kind] = weight(r["clean"], r["toxic"])
    lexicon.weights = _pruned(lexicon.weights)
    for term, kind in list(lexicon.weights):
        if kind == 0 and errors_for(term):
            lexicon.weights[term, 1] = 0.0
    hits = rows.mapInArrow(_hits_of(lexicon), shape).groupBy("term", "kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = {(r["term"], r["kind"]): (r["clean"], r["toxic"]) for r in hits.collect()}  # three for each term at most
    for key in list(lexicon.weights):
        term, kind = key
        clean, toxic = seen.get(key, (0, 0))
        if kind == 1:
            # a neighbour that never came: trust it by its term's weight, less if toxic rows are few
            own = lexicon.weights[term, 0]
            lexicon.weights[key] = min(own, 0.7 * own) if clean == 0 else max(0.0, min(0.7 * own, weight(clean, toxic)))
            if lexicon.weights[key] <= 0.0:
                del lexicon.weights[key]
        elif term in SEEDS and kind == 0:
            lexicon.weights[key] = max(0.0, weight(clean, toxic)) if clean + toxic else SEED_WEIGHT
    bins = rows.mapInArrow(_binned(lexicon), "bin int, clean long, toxic long").groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    prior, slope = fit_logistic(bins["bin"].to_numpy() * BIN, bins["clean"].to_numpy(float), bins["toxic"].to_numpy(float))
    if slope > 0:
        lexicon.prior, lexicon.slope = prior, slope
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row doc_id, held_out, score, predicted, and terms, the lexicon's terms found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_score(lexicon), "doc_id long, held_out boolean, score double, predicted int, terms string")
