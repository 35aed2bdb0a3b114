"""Removal of word passages that already stand earlier in the corpus.

A window is `window` consecutive words of one document. Each word goes that a window
covers whose word sequence also starts earlier: in a document with a smaller doc_id, or
earlier in the same one.

1. Each window has an anchor, its smallest hash of `gram` words (the first such). Equal
   windows have equal anchors, so only anchors that occur twice can belong to a repeated
   window. Each task counts its anchors before they are shuffled.
2. A bit table of `bits` bits, of the anchors found twice, is broadcast: its size is a
   parameter and doesn't grow with the data. What it lets through is compared exactly,
   so a full table costs time and not results.
3. Windows that pass are compared inside their task first. All but the first of equals
   are repeats; only that first one is shuffled. So a passage in a third of all documents
   is a row for each task and not for each document.
4. The repeats of a document are put together and its kept words are joined again. A second
   bit table, of `ID_BITS` bits at most, tells which documents may have repeats; the others
   are done where they are read.

Suffix automata of reference shards that are broadcast to all documents aren't used: each
document would have to run through each shard's automaton, which is quadratic in the
corpus (see the README for figures). The hashes are of 96 bits.

Null and empty texts have no words and stay as they are. Rows that repeat a doc_id are put
in order by a hash of their text, and then stand for one document after the other; of rows
with the same text the first stays whole. They are written once, to number them. A null
doc_id comes before all others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, holds
from .common import slices, written
from .textnum import Words, mix, place, runs

WINDOW, GRAM, BITS, ID_BITS = 20, 5, 1 << 27, 1 << 24
_U = np.uint64


def _anchors(h: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where windows start that lie in one document; for each the place of its
    anchor, and all hashes of `gram` words."""
    grams = runs(h, gram)
    ends = np.cumsum(counts)
    starts = np.arange(max(0, len(h) - window + 1))
    if not len(starts):
        return starts, starts, grams
    row = np.repeat(np.arange(len(counts)), counts)[: len(starts)]
    at = np.arange(len(grams))
    best, reach, most = grams, 1, window - gram + 1
    while reach < most:  # the least of 1, 2, 4, ... and at last of `most` grams
        step = min(reach, most - reach)
        a, b = best[: len(best) - step], best[step:]
        left = a <= b
        at = np.where(left, at[: len(a)], at[step:])
        best = np.where(left, a, b)
        reach += step
    whole = starts + window <= ends[row]
    return starts[whole], at[: len(starts)][whole], grams


def _count_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column("text"))
            _, at, grams = _anchors(w.hashes(), w.counts(), window, gram)
            if len(at):
                found, n = np.unique(grams[at[np.flatnonzero(np.diff(at, prepend=-1))]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place(found)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _candidates(table, window: int, gram: int):
    """Windows with an anchor that occurs twice: one row (h, g, doc, start, 0) for the
    first of equals in a slice, and (0, 0, doc, start, number) for runs of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=6 << 20):
            w = Words(batch.column("text"))
            h, counts = w.hashes(), w.counts()
            starts, at, grams = _anchors(h, counts, window, gram)
            if not len(starts):
                continue
            starts = starts[holds(table.value, grams[at])]
            if not len(starts):
                continue
            h1 = runs(h, window)[starts]
            h2 = runs(mix(h + _U(77)), window)[starts] >> _U(32)
            row = np.searchsorted(w.first, starts, "right") - 1
            doc = batch.column("id").to_numpy()[row]
            copy = batch.column("copy").to_numpy()[row]
            here = starts - w.first[row]
            order = np.lexsort((here, copy, doc, h2, h1))
            again = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            again[1:] = (h1[a] == h1[b]) & (h2[a] == h2[b])
            sure = np.sort(order[again])
            first = order[~again]
            yield _rows(h1[first], h2[first], doc[first], copy[first], here[first], np.zeros(len(first), np.int64))
            if len(sure):
                cut = np.flatnonzero(np.diff(starts[sure], prepend=-9) != 1)
                cut = np.union1d(cut, np.flatnonzero(np.diff(row[sure], prepend=-9)))
                n = np.diff(np.append(cut, len(sure)))
                s = sure[cut]
                yield _rows(mix(starts[s].astype(_U) + doc[s].view(_U) * _U(31)), np.zeros(len(s), _U), doc[s], copy[s], here[s], n)

    return run


def _rows(h, g, doc, copy, start, sure) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place(h)), pa.array(g.astype(np.int64)), pa.array(doc), pa.array(copy), pa.array(start.astype(np.int32)), pa.array(sure.astype(np.int32))], ["h", "g", "id", "copy", "start", "sure"])


def _listed(table, batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row's id may be in the bit table."""
    return holds(table.value, batch.column("id").to_numpy().view(_U))


def _sifted(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_listed(table, batch)))

    return run


def _strip(window: int, texts: bool, table=None):
    """Kept words of rows with their spans; or, with a table, of rows that aren't in it and
    so have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if table is not None:
                batch = batch.filter(pa.array(~_listed(table, batch)))
            w = Words(batch.column("text"))
            spans = batch.column("spans") if table is None else pa.nulls(batch.num_rows)
            n, removed, digest, kept_text = [], [], [], []
            for i, span in enumerate(spans):
                low, high = int(w.first[i]), int(w.first[i + 1])
                drop = np.zeros(high - low + 1, np.int32)
                if span.is_valid:
                    start = span.values.field(0).to_numpy()
                    np.add.at(drop, start, 1)
                    np.add.at(drop, start + span.values.field(1).to_numpy() + window - 1, -1)
                keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0) + low
                text = b" ".join([w.data[a:b].tobytes() for a, b in zip(w.starts[keep], w.ends[keep])])
                n.append(high - low)
                removed.append(high - low - len(keep))
                digest.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept_text.append(text.decode())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + texts], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts])

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order of id and text as copy. They are dealt by range and
    written once, so that each row keeps its number and no id's rows meet in one task."""
    order = ["id", "copy", "_place"]
    placed = rows.select("doc_id", "id", F.xxhash64("text").alias("copy"), "text", F.monotonically_increasing_id().alias("_place"))
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("doc_id", "id", F.monotonically_increasing_id().alias("copy"), "text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS, texts: bool = True) -> DataFrame:
    """Per row doc_id, n_words, n_removed, kept_sha256 and, with `texts`, kept_text, its kept
    words.

    `window` words make a passage; `gram` words an anchor; bits: a power of two.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.lit(0).cast("long").alias("copy"),
        "text",
    )
    # copy tells apart rows that share an id, also those of one text; where none do, it stays 0, which takes less room
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = _numbered(rows)
    found = rows.select("text").mapInArrow(_count_anchors(window, gram), "anchor long, n long")
    twice = found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(twice, bits))
    windows = rows.select("id", "copy", "text").mapInArrow(_candidates(table, window, gram), "h long, g long, id long, copy long, start int, sure int")
    equal = Window.partitionBy("h", "g").orderBy("id", "copy", "start")
    again = (
        windows.withColumn("n", F.row_number().over(equal))
        .filter("sure > 0 or n > 1")
        .select("id", "copy", "start", F.greatest("sure", F.lit(1)).alias("n"))
    )
    # a document's repeats are at most as many as its words
    spans = written(again.groupBy("id", "copy").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    # only documents that may have repeats are shuffled
    some = docs.sparkSession.sparkContext.broadcast(bit_table(spans.select("id"), min(bits, ID_BITS)))
    kind = "doc_id long, id long, copy long, text string"
    joined = rows.mapInArrow(_sifted(some), kind).join(spans, ["id", "copy"], "left").select("doc_id", "text", "spans")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return joined.mapInArrow(_strip(window, texts), out).unionAll(rows.mapInArrow(_strip(window, texts, some), out))
