"""Documents packed into training sequences, shortest pack first.

1. Texts become ids where they are read. A document is its ids and an end id; it is cut
   into pieces of `length` ids and a rest. Only (document, start, length, checksum) goes
   on, not the ids.
2. The histogram of piece lengths, which has `length` rows at most, comes to the driver.
   Lengths are placed longest first, each into the shortest pack, the pattern with the most
   room, if it fits there; else a new pattern starts. Patterns and counts are updated for
   all documents of a length at once, so the work depends on the number of lengths and not
   on documents.
3. Each piece gets its rank among pieces of its length and with it the pattern, sequence
   and offset. Ranks are counted within buckets of documents and the buckets' sizes are
   added up, so one length that a third of all pieces have doesn't meet in one task.

Padding is what patterns leave free. Null texts are empty: their only id is
the end id. Rows that share a doc_id are packed one by one. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

LENGTH, END, VOCABULARY = 1024, 0, "byte_bpe_50k"
#: White space in a row that tiktoken's pattern engine is given at most; it took 700,000 and not 1,100,000.
RUN = 100_000
_WHITE = re.compile(r"\s+")


def encoder(vocabulary: str = VOCABULARY):
    """A function from texts to ids, those of the tokenizers file by its own defaults: an
    added token in a text is one id. The ranks file has the same vocabulary and gives the
    same ids at a fifth of the cost; texts that its pattern engine refuses go through the
    other. vocabulary: a name in the public tokenizers, or a path without its ending."""
    import base64
    import json

    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    at = (lambda end: vocabulary + end) if "/" in vocabulary else (lambda end: files.path(vocabulary + end))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at(".tiktoken"), "rb"))}
    with open(at(".json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        # beyond its stack the pattern engine panics on white space
        if len(text) <= RUN or max(map(len, _WHITE.findall(text)), default=0) <= RUN:
            try:
                if any(t in text for t in added):
                    return np.array(fast.encode(text, allowed_special="all"), np.uint32)
                return np.array(fast.encode_ordinary(text), np.uint32)
            except BaseException as refused:  # the pattern engine's own limit
                # a panic is no Exception, and its type can't be imported
                if isinstance(refused, MemoryError) or not isinstance(refused, Exception) and type(refused).__name__ != "PanicException":
                    raise
        if not slow:
            slow.append(Tokenizer.from_file(at(".json")))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _pieces(length: int, end: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in slices(batches, most=1 << 20):
            doc, start, size, crc, total = [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), length):
                    own = ids[at : at + length]
                    doc.append(i)
                    start.append(at)
                    size.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences each has, by shortest pack first:
    each length, from the longest on, goes into the open pattern with the most room, and
    where even that has too little starts a new one."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # rooms with open patterns, sorted

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_by_room:
            insort(rooms, room)
            open_by_room[room] = {}
        open_by_room[room][pattern] = open_by_room[room].get(pattern, 0) + n

    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        while left:
            if rooms and rooms[-1] >= size:
                room = rooms[-1]
                pattern, n = open_by_room[room].popitem()
                if not open_by_room[room]:
                    del open_by_room[rooms.pop()]
                used = min(n, left)
                if n > used:
                    add(room, pattern, n - used)
                add(room - size, (*pattern, size), used)
                left -= used
            else:
                # one after the other each new pack is the shortest until it is full
                times = min(length // size, left)
                n = left // times
                add(length - times * size, (size,) * times, n)
                left -= n * times
    merged: dict[tuple[int, ...], int] = {}
    for own in open_by_room.values():
        for pattern, n in own.items():
            merged[pattern] = merged.get(pattern, 0) + n
    return sorted(merged.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset) in the order of ranks: the
    ranks from one row to the next take sequences one after the other, at that offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        at = 0
        for size in pattern:
            first = ranks.get(size, 0)
            rows.setdefault(size, []).append((first, sequence, at))
            ranks[size] = first + n
            at += size
        sequence += n
    return {size: np.array(x, np.int64) for size, x in rows.items()}


def _assign(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                rows = table.value[int(s)]
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own] = rows[k, 1] + rank[own] - rows[k, 0]
                offset[own] = rows[k, 2]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(texts.mapInArrow(_pieces(length, end, vocabulary), shape))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(buckets)))
    # one row for each length and bucket
    sizes = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, length)))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(_assign(table), shape + ", sequence_id long, offset long")
