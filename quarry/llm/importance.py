"""Selection of documents by importance resampling over hashed n-grams.

1. Words and pairs of neighbouring words are hashed into `buckets` buckets. Their counts
   over the target rows (labelled as good) and over all rows are two bags of n-grams, with
   add-one smoothing. Each task adds up its own counts, so that `buckets` rows leave it.
2. A document's log weight is the sum, over its n-grams, of the logarithm of the ratio of
   the two models' probabilities.
3. Gumbel top-k: to the log weight comes noise with the Gumbel distribution, made from a
   hash of doc_id and a seed, so it is the same in each run and on each retry. The k rows
   with the largest keys are a sample without replacement by weight.
4. The k-th key is found by narrowing a histogram of keys, which has `BINS` rows at most in
   each round; no rows are sorted or collected. Ties go to the smaller doc_id.

k: the share of good rows among the labelled ones, of all rows, unless a share is given.
Null and empty texts have no n-grams and log weight 0, which is neither good nor bad; they
are never selected. Repeated rows get the same key and are selected one by one. Rows with
a null doc_id are weighed, with noise of their text. Extra columns are ignored. Without
labelled rows all weights are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, written
from .textnum import Words, runs

BUCKETS, SEED, BINS, LABELLED = 1 << 16, 1, 1024, 1_000_000
_U = np.uint64


def _grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and neighbouring pairs, and the rows that they are in."""
    w = Words(texts, lower=True)
    h, counts = w.hashes(), w.counts()
    row = np.repeat(np.arange(len(counts)), counts)
    pairs = runs(h, 2)
    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    bucket = np.concatenate([h, pairs[inside[: len(pairs)]]]) & _U(buckets - 1)
    return bucket.astype(np.int64), np.concatenate([row, row[1:][inside]])


def _count(buckets: int):
    """(bucket, target, raw): sums of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in slices(batches):
            bucket, row = _grams(batch.column("text"), buckets)
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            sums[0] += np.bincount(bucket[good[row]], minlength=buckets)
            sums[1] += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "target", "raw"])

    return run


def _weigh(ratios, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, row = _grams(batch.column("text"), buckets)
            sums = np.bincount(row, ratios.value[bucket], minlength=batch.num_rows).astype(np.float64)
            n = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), pa.array(sums), pa.array(n.astype(np.int64))], ["doc_id", "noise", "log_weight", "n_grams"])

    return run


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> np.ndarray:
    """log(target / raw) for each bucket: raw from all documents, target from those that are
    labelled as good, at most about `labelled` of them."""
    marks = bounded(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "doc_id", labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks.withColumn("good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(_count(buckets), "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.ones(buckets), np.ones(buckets)
    at = sums["bucket"].to_numpy()
    target[at] += sums["target"].to_numpy()
    raw[at] += sums["raw"].to_numpy()
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """Per row doc_id, log_weight, n_grams and key, the log weight with Gumbel noise."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (-F.log(-F.log(uniform))).alias("noise"), "text")
    found = rows.mapInArrow(_weigh(table, len(ratios)), "doc_id long, noise double, log_weight double, n_grams long")
    return found.select("doc_id", "log_weight", "n_grams", (F.col("log_weight") + F.col("noise")).alias("key"))


def top_k(rows: DataFrame, k: int, column: str = "key", tie: str = "doc_id") -> DataFrame:
    """The k rows with the largest values, of equal ones those with the smaller tie. rows
    should be a table: they are read several times."""
    if k <= 0:
        return rows.limit(0)
    bounds = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    low, high, n = bounds
    if n is None or n <= k:
        return rows.filter(F.col(column).isNotNull())
    above = 0  # rows over high
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        narrowed = (b["low"], b["high"])
        if narrowed == (low, high) or b["n"] == 1:
            low, high = narrowed
            break
        low, high = narrowed
    sure = rows.filter(F.col(column) > high)
    if low == high:
        equal = rows.filter(F.col(column) == high)
        count = equal.count()
        if count == k - above:
            return sure.union(equal)
        if equal.agg(F.min(tie) == F.max(tie)).first()[0]:  # nothing tells them apart
            return sure.union(equal.limit(k - above))
        negative = equal.withColumn("_tie", -F.col(tie))
        return sure.union(top_k(negative, k - above, "_tie", tie).drop("_tie"))
    rest = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
    return sure.union(rest.orderBy(F.desc(column), tie).limit(k - above))


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The selected rows' doc_id, log_weight, n_grams, key and kept (always true)."""
    if share is None:
        n = labels.filter("quality is not null").agg(F.avg("quality")).first()[0]
        share = 1.0 if n is None else n
    weighed = written(weigh(docs, log_ratios(docs, labels, buckets), seed))
    some = weighed.filter("n_grams > 0")
    return top_k(some, round(share * weighed.count())).withColumn("kept", F.lit(True))
