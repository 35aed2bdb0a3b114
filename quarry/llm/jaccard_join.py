"""Near duplicates by Jaccard similarity of word shingles, exact, with sets light or heavy.

Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct shingles
of `words` words; a document of fewer words has its whole sequence as its only shingle.

Light sets, up to a size found by cost (`light_size`), list all subsets that are large
enough to be the common part with any partner; linked light sets share such a subset of
the same size. Pairs with a heavy set share an element of their prefixes: the elements of
a set stand in one order for all sets, and a set of n elements keeps the first
n - ceil(t n) + 1. Frequent elements come last in that order, so that passages which many
documents share hardly get into prefixes. The shares, subsets or elements, are keys of
inverted lists.

A list is never expanded into all its pairs. Exact copies are put together first. Then
each document is compared with the one that leads most of its lists, and what these links
connect becomes a component. A few rounds follow: in each list that has members of several
components, each member proposes the next one of another component, and of what is proposed
for two components one pair is compared, so that a round costs less than a comparison for
each member and at least halves the components that it can connect. Only members that are
in different components when no round finds links any more are compared with each other.
So all pairs of a list are in the end compared, or known to be connected; components are
exact. Before whole sets are compared a pair is ruled out by sizes, by the places of its
first common element, and by parities: each set has about as many bits as elements, each
the parity of the elements that hash to it, and two sets differ by as many elements at
least as bits.

A list with more than `hot` members is dealt over blocks: a round looks at each block by
itself, in other blocks each time, and the last pass at each pair of blocks, so that a
list's work is spread over tasks.

How frequent elements are is told by a table of 2 ** `sketch_bits` counters that elements
share by their hash; it has that size whatever the number of documents, and is broadcast.
Its counts only order elements, in the same way for all sets, so that a crowded counter
can cost time and not results.

Null texts and texts without words have no set and link with nothing. Rows that repeat a
doc_id count as one document that has the links of all its rows; rows with a null doc_id
link with nothing. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, holds
from .common import discard, slices, written
from .textnum import Words, mix, place, runs

WORDS, PERCENT, SUBSETS, BITS, SKETCH_BITS, ROUNDS, HOT = 5, 80, 256, 1 << 24, 22, 2, 4096
#: Pairs that are compared for two components in a round, and members that a member looks at.
TRIES, REACH = 3, 256
#: Counters that go together, and times the mean count from which elements come late.
CHUNK, LATE = 1 << 16, 1
#: Members of a list up to which each is looked at with each before the list is written.
NEAR = 64
#: Sizes that may be light, and counters for the elements of such sets.
SMALL, SMALL_COUNTERS = 24, 4 * CHUNK
_U = np.uint64


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least common part of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def least(n: int, percent: int = PERCENT) -> int:
    """The least common part with any partner, which is also a partner's least size."""
    return -(-percent * n // 100)


def subsets_of(n: int, percent: int = PERCENT) -> int:
    """How many subsets a light set of n elements lists."""
    return sum(math.comb(n, c) for c in range(least(n, percent), n + 1))


def light_size(sizes: dict[int, int], shared: float, percent: int = PERCENT, subsets: int = SUBSETS) -> int:
    """The boundary between light and heavy sets that costs least: a light set costs a row
    for each subset; a heavy one, for each element of its prefix, a row and a look at the
    other sets of that element's list. sizes: how many sets of each size there are; shared:
    how many small sets an element has; subsets: what a set may list at most."""
    heavy = lambda n: (n - least(n, percent) + 1) * (1 + shared)
    best, saved, most = 1, 0.0, 0.0
    for n in range(2, SMALL + 1):
        if subsets_of(n, percent) > subsets:
            break
        saved += sizes.get(n, 0) * (heavy(n) - subsets_of(n, percent))
        if saved > most:
            best, most = n, saved
    return best


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets' shingles, each set sorted, one after the other; where each set begins."""
    w = Words(texts, lower=True)
    h, counts = w.hashes(), w.counts()
    row = np.repeat(np.arange(len(counts)), counts)
    grams = runs(h, words)
    ends = w.first[1:]
    at = np.arange(len(grams))
    whole = at + words <= ends[row[: len(grams)]]
    values, rows = [grams[whole]], [row[: len(grams)][whole]]
    for k in range(1, words):
        short = np.flatnonzero(counts == k)
        if len(short):
            values.append(mix(runs(h, k)[w.first[short]] + _U(k)))
            rows.append(short)
    value, row = values[0], rows[0]
    if len(values) > 1:
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        value, row = np.concatenate(values)[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    value = value.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def _digest(value: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(value ^ _U(seed)))])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _parities(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set bits that tell whether an odd number of its elements hash to them; as
    many as the power of two from its size on, 64 at least."""
    n = np.diff(first)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64))
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + (mix(value + _U(11)) & (bits[row] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool), bitorder="little")
    return [packed[a >> 3 : b >> 3].tobytes() for a, b in zip(base[:-1], base[1:])]


def _describe(words: int, sketch_bits: int):
    """For each row doc_id, n, f1, f2 and parity, its set's size, digests and parities. At
    a task's end rows (chunk, counts) with its counters, deflated; the last SMALL_COUNTERS
    of these are for small sets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((1 << sketch_bits) + SMALL_COUNTERS, np.uint32)
        names = ["doc_id", "n", "f1", "f2", "parity", "chunk", "counts"]
        for batch in slices(batches, most=8 << 20):
            value, first = _sets(batch.column("text"), words)
            n, nothing = np.diff(first), [None] * batch.num_rows
            small = value[np.repeat((n > 1) & (n <= SMALL), n)]
            for k, own in ((_counter(value, sketch_bits), 0), ((mix(small) % _U(SMALL_COUNTERS)).astype(np.int64), 1 << sketch_bits)):
                at, times = np.unique(k, return_counts=True)
                counters[at + own] += times.astype(np.uint32)
            columns = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(place(_digest(value, first, 1))), pa.array(place(_digest(value, first, 2))), pa.array(_parities(value, first), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nothing, pa.int32()), pa.array(nothing, pa.binary())], names)
        if counters.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in counters.reshape(-1, CHUNK)]
            empty = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(parts), pa.binary()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names)

    return run


def _counter(value: np.ndarray, sketch_bits: int) -> np.ndarray:
    return (value >> _U(64 - sketch_bits)).astype(np.int64)


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each chunk, of its counts and of their squares, and one byte for each
    counter: 0 or the logarithm's digits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            own = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
            sums[chunk] = sums.get(chunk, 0) + own.astype(np.int64)
    for chunk, own in sums.items():
        levels = np.round(4 * np.log2(own + 1)).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([own.sum()], pa.int64()), pa.array([(own.astype(float) ** 2).sum()]), pa.array([levels], pa.binary())], ["chunk", "total", "squares", "levels"])


def _levels(parts: DataFrame, sketch_bits: int) -> tuple[np.ndarray, float]:
    """For each counter 0, or a number that grows with its count where that is over the
    mean by more than chance; and how many small sets an element of such has, the mean over
    the sets' elements. One byte for each counter comes to the driver."""
    rows = parts.repartition("chunk").mapInArrow(_add_counters, "chunk int, total long, squares double, levels binary").toArrow()
    out = np.zeros(1 << sketch_bits, np.uint8)
    total, small, squares = 0, 0, 0.0
    for chunk, count, square, levels in zip(rows["chunk"].to_pylist(), rows["total"].to_pylist(), rows["squares"].to_pylist(), rows["levels"]):
        if chunk * CHUNK < len(out):
            total += count
            out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(levels.as_buffer(), np.uint8)
        else:
            small, squares = small + count, squares + square
    mean = total / len(out)
    out[out < round(4 * math.log2(mean + LATE * (4 * mean**0.5 + 4) + 1))] = 0
    # what chance puts into a counter beside an element goes
    return out, max(1.0, squares / small - small / SMALL_COUNTERS) if small else 1.0


def _shares(levels, words: int, percent: int, light: int):
    """(key, id, n, at): the keys of each set, once for equal sets in a task; at: where the
    key's element stands in the set's order, or -1 for subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches, most=8 << 20):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            value, first = _sets(batch.column("text"), words)
            digest = list(zip(_digest(value, first, 1).tolist(), _digest(value, first, 2).tolist()))
            n = np.diff(first)
            new = np.array([bool(s) and d not in seen and not seen.add(d) for s, d in zip(n, digest)], bool)
            row = np.repeat(np.arange(len(n)), n)
            late = levels.value[_counter(value, len(levels.value).bit_length() - 1)]
            # a set's order: elements that aren't frequent by their hash, then the others
            prefix = n - (-(-percent * n // 100)) + 1
            early = late == 0
            at = np.cumsum(early) - early
            at -= at[np.minimum(first[:-1], max(len(at) - 1, 0))][row] if len(at) else 0
            several = np.bincount(row[early], minlength=len(n)) < prefix
            for i in np.flatnonzero(several & new):
                a, b = first[i], first[i + 1]
                own = np.lexsort((value[a:b], late[a:b]))
                at[a:b][own] = np.arange(b - a)
                early[a:b] = True
            take = early & new[row] & (at < prefix[row]) & (n[row] >= least(light + 1, percent))
            if take.any():
                yield _batch(key=place(value[take]), id=ids[row[take]], n=n[row[take]].astype(np.int32), at=at[take].astype(np.int32))
            keys, owners = [], []
            for i in np.flatnonzero(new & (n <= light)):
                own = [int(x) for x in value[first[i] : first[i + 1]]]
                own.sort()
                for c in range(least(len(own), percent), len(own) + 1):
                    for subset in combinations(own, c):
                        keys.append(sum(subset) * 0x9E3779B97F4A7C15 + c & 0xFFFFFFFFFFFFFFFF)
                        owners.append(i)
            if keys:
                owners = np.array(owners)
                yield _batch(key=place(mix(np.array(keys, _U) + _U(5))), id=ids[owners], n=n[owners].astype(np.int32), at=np.full(len(owners), -1, np.int32))

    return run


def fits(n: np.ndarray, at: np.ndarray, m: np.ndarray, there: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n elements can link with sets of m >= n, if the first element that is
    common to both stands at these places (-1: unknown)."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    most = np.where((at < 0) | (there < 0), n, np.minimum(n - at, m - there))
    return (n * 100 >= m * percent) & (most * (100 + percent) >= percent * (n + m))


def _lists(percent: int):
    """From rows sorted by key, n and id, the lists of at least two members: each member
    with the list's first, its lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("key", "id", "n", "at")
        rest, lead = None, None
        for batch in batches:
            key, i, n, at = (batch.column(c).to_numpy() for c in columns)
            if rest is not None:  # the last row may begin a list
                key, i, n, at = (np.concatenate([a, b]) for a, b in zip(rest, (key, i, n, at)))
            begins = np.ones(len(key), bool)
            begins[1:] = key[1:] != key[:-1]
            where = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
            leads = np.zeros(len(key), bool)
            leads[:-1] = begins[:-1] & ~begins[1:]
            own = [i[where], n[where], at[where]]
            if lead is not None:
                leads[0] = False  # given before
                own = [np.where(where == 0, x, o) for x, o in zip(lead, own)]
            out = ~begins | leads
            # members that fit none of the members about them go, if all of those are here
            keep = np.zeros(len(key), bool)
            whole = np.flatnonzero(begins)
            ends = np.append(whole[1:], len(key))
            sizes = ends - whole
            open_end = np.repeat((sizes > NEAR) | (ends == len(key)) | ((whole == 0) & (rest is not None)), sizes)
            x = np.arange(len(key) - 1)
            for d in range(1, NEAR):
                x = x[x + d < len(key)]
                x = x[key[x] == key[x + d]]
                if not len(x):
                    break
                good = x[fits(n[x], at[x], n[x + d], at[x + d], percent)]
                keep[good] = keep[good + d] = True
            out &= keep | open_end
            if out.any():
                yield _batch(key=key[out], id=i[out], n=n[out], at=at[out], lead=own[0][out], lead_n=own[1][out], lead_at=own[2][out])
            rest = tuple(a[-1:] for a in (key, i, n, at))
            going_on = not begins[-1] or (lead is not None and len(key) == 1)
            lead = tuple(o[-1] for o in own) if going_on else None

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list]:
    """The columns of rows that agree in `by`, of sorted rows; small groups come together,
    with a last column that numbers them."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        if rest.num_rows < NEAR * NEAR:
            continue
        begins = _begins(rest, by)
        whole = int(begins[-1])
        if whole:
            yield [*_columns(rest.slice(0, whole), columns), np.searchsorted(begins, np.arange(whole), "right")]
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield [*_columns(rest, columns), np.searchsorted(_begins(rest, by), np.arange(rest.num_rows), "right")]


def _begins(rows: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in by:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _columns(rows: pa.Table, columns: tuple[str, ...]) -> list:
    return [rows.column(c).combine_chunks() if c == "parity" else rows.column(c).to_numpy() for c in columns]


def _differ(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """By how many elements linked sets of n and m elements differ at most."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


class Parities:
    """Parities of sets, as many 64-bit words for each as a power of two."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.words = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(_U)
        self.first, self.width = (offsets[:-1] - offsets[0]) >> 3, np.diff(offsets) >> 3

    def _rows(self, x: np.ndarray, width: int, to: int) -> np.ndarray:
        out = self.words[self.first[x][:, None] + np.arange(width)]
        while out.shape[1] > to:  # as if made with half the bits
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return out

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By how many elements the sets x[k] and y[k] differ at least."""
        out = np.zeros(len(x), np.int64)
        widths = self.width[x] << 32 | self.width[y]
        for both in np.unique(widths):
            v, w = int(both >> 32), int(both & 0xFFFFFFFF)
            own = np.flatnonzero(widths == both)
            step = max(1, (1 << 20) // max(v, w))
            for k in range(0, len(own), step):
                i = own[k : k + step]
                out[i] = np.bitwise_count(self._rows(x[i], v, min(v, w)) ^ self._rows(y[i], w, min(v, w))).sum(axis=1, dtype=np.int64)
        return out


def _proposals(percent: int):
    """From lists' blocks, sorted, for each member the one of another component that seems
    most alike among those about it: (a, b, ca, cb, room), room telling how much further
    the sets might differ than their parities do, as a share of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, n, at, comp, parity, group in _groups(batches, ("key", "block"), ("id", "n", "at", "component", "parity")):
            parity = Parities(parity)
            best, partner = np.full(len(i), -1.0), np.zeros(len(i), np.int64)
            x = np.arange(len(i) - 1)
            for d in range(1, REACH):
                x = x[x + d < len(i)]
                x = x[group[x] == group[x + d]]
                if not len(x):
                    break
                a = x[comp[x] != comp[x + d]]
                a = a[fits(n[a], at[a], n[a + d], at[a + d], percent)]
                if len(a):
                    room = (_differ(n[a], n[a + d], percent) - parity.apart(a, a + d)) / (n[a] + n[a + d])
                    for own, other in ((a, a + d), (a + d, a)):
                        more = room > best[own]
                        best[own[more]], partner[own[more]] = room[more], other[more]
            x = np.flatnonzero(best >= 0)
            if len(x):
                y = partner[x]
                swap = comp[x] > comp[y]
                x, y, room = np.where(swap, y, x), np.where(swap, x, y), best[x]
                yield _batch(a=i[x], b=i[y], ca=comp[x], cb=comp[y], room=room)

    return run


def _across(percent: int, most: int = 1 << 16):
    """From pairs of lists' blocks, sorted, pairs of members in different components whose
    sizes, places and parities let them link; of two blocks only pairs across them."""

    def pairs(a: int, b: int, i, n, at, comp, own, parity: Parities) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for x in range(a, b):
            # members are sorted by n, so partners that come later have up to n / t
            y = np.arange(x + 1, a + int(np.searchsorted(n[a:b], int(n[x]) * 100 // percent, "right")))
            y = y[(comp[y] != comp[x]) & ((own[y] != own[x]) | (own[x] < 0))]
            y = y[fits(n[x : x + 1], at[x : x + 1], n[y], at[y], percent)]
            if len(y):
                y = y[parity.apart(np.full(len(y), x), y) <= _differ(n[x : x + 1], n[y], percent)]
            if len(y):
                found.append((np.minimum(i[x], i[y]), np.maximum(i[x], i[y])))
                size += len(y)
            if size > most or (found and x == b - 1):
                yield _batch(a=np.concatenate([x for x, _ in found]), b=np.concatenate([y for _, y in found]))
                found, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, n, at, comp, low, high, own, parity, group in _groups(batches, ("key", "low", "high"), ("id", "n", "at", "component", "low", "high", "block", "parity")):
            own = np.where(low == high, -1, own)
            ends = np.flatnonzero(np.diff(group, append=group[-1] + 1)) + 1
            parity = Parities(parity)
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
                yield from pairs(a, b, i, n, at, comp, own, parity)

    return run


def _blobs(words: int, table):
    """(id, elements) for documents whose id may be in the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            batch = batch.filter(pa.array(holds(table.value, batch.column("doc_id").to_numpy().view(_U))))
            value, first = _sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["id", "elements"])

    return run


def _verify(percent: int):
    """Pairs (a, b, left, right) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])

    return run


def _may_link(percent: int):
    """Of rows with two sets' sizes and parities (a, b, n, left, m, right) pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.arange(batch.num_rows)
            apart = Parities(pa.concat_arrays([batch.column("left"), batch.column("right")])).apart(k, k + len(k))
            keep = apart <= _differ(batch.column("n").to_numpy(), batch.column("m").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that may link by their sizes and parities."""
    left = sets.select(F.col("doc_id").alias("a"), "n", F.col("parity").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_may_link(percent), "a long, b long")


def _links(docs: DataFrame, pairs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """Those of pairs (a, b) that link, by comparing their sets, which are made where
    documents are read, for those that a bit table lets through."""
    pairs = written(pairs.filter("a < b").distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids, bits))
    sets = written(docs.mapInArrow(_blobs(words, table), "id long, elements binary"))
    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    found = written(pairs.join(left, "a").join(right, "b").mapInArrow(_verify(percent), "a long, b long").distinct())
    discard(sets)
    discard(pairs)
    return found


def _stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """What links (a, b) of a task connect, as links of each id with the smallest one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def stars() -> pa.RecordBatch:
        ids = [x for x in up if up[x] != x]
        return _batch(a=np.array(ids, np.int64), b=np.array([top(x) for x in ids], np.int64))

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > most:
            yield stars()
            up.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids of links (a, b), component the smallest id that links
    reach. Links become stars around smallest ids, in each task by itself first; then in
    turn each id's larger neighbours and its smaller ones are linked with its smallest one
    instead, until each id has one link and no centre has a larger one."""
    kind = "a long, b long"
    edges = written(links.select("a", "b").filter("a <> b").mapInArrow(_stars, kind))
    made = [edges]
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("low"), F.lit(False).alias("centre")).union(edges.select("b", F.lit(None), F.lit(True)))
        ends = ends.groupBy("id").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.max("centre").alias("centre"))
        if ends.filter("low < high or low is not null and centre").isEmpty():
            break
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("b"), F.least("a", "low").alias("low"))
        larger = edges.join(near, "b").select("a", F.col("low").alias("b")).distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        smaller = larger.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.*")
        edges = written(smaller.filter("a <> b").distinct().mapInArrow(_stars, kind))
        made.append(edges)
    out = edges.distinct()
    out = written(out.select(F.col("a").alias("id"), F.col("b").alias("component")).union(out.select("b", "b")).distinct())
    for edges in made:
        discard(edges)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after what links (a, b) connect."""
    ends = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    merged = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    known = labels.join(merged.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(known.union(merged.join(labels, "id", "left_anti").select("id", "component")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, subsets: int = SUBSETS, bits: int = BITS, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    words: of a shingle; percent: the similarity from which sets link; sketch_bits: of the
    number of counters that tell frequent elements, 16 at least; subsets: what a light set may
    list at most; bits: of the tables that let through documents whose sets are compared;
    rounds: of comparisons between components by one pair, at most, before all pairs; hot:
    members of a list from which it is dealt over blocks of about so many.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    rows = written(docs.mapInArrow(_describe(words, sketch_bits), "doc_id long, n long, f1 long, f2 long, parity binary, chunk int, counts binary"))
    sets = rows.filter("chunk is null").select("doc_id", "n", "f1", "f2")
    full = sets.filter("n > 0 and doc_id is not null")
    bit_sets = rows.filter("chunk is null and n > 0 and doc_id is not null").select("doc_id", "n", "parity")
    levels, shared = _levels(rows.filter("chunk is not null").select("chunk", "counts"), sketch_bits)
    levels = spark.sparkContext.broadcast(levels)
    sizes = {r["n"]: r["count"] for r in full.filter(F.col("n") <= SMALL).groupBy("n").count().collect()}  # SMALL rows
    light = light_size(sizes, shared, percent, subsets)

    # equal sets count as their smallest doc_id; also rows that share a doc_id
    same = written(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    copies = full.join(same, ["n", "f1", "f2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    copies = written(copies)

    shares = known.mapInArrow(_shares(levels, words, percent, light), "key long, id long, n int, at int")
    sorted_shares = shares.repartition("key").sortWithinPartitions("key", "n", "id")
    kind = "key long, id long, n int, at int, lead long, lead_n int, lead_at int"
    lists = written(sorted_shares.mapInArrow(_lists(percent), kind))

    # the first common element tells how much can still be common; the lead is no larger
    after = F.when(F.col("at") < 0, F.col("lead_n")).otherwise(F.least(F.col("n") - F.col("at"), F.col("lead_n") - F.col("lead_at")))
    fit = (F.col("lead_n") * 100 >= F.col("n") * percent) & (after * (100 + percent) >= percent * (F.col("n") + F.col("lead_n")))
    led = lists.filter(fit & (F.col("id") != F.col("lead"))).groupBy("id", "lead").count()
    first = led.groupBy("id").agg(F.max(F.struct("count", "lead")).alias("x")).select(F.least("id", "x.lead").alias("a"), F.greatest("id", "x.lead").alias("b"))
    labels = components(_links(known, _likely(first, bit_sets, percent), words, percent, bits).union(copies))

    def mixed(rows: DataFrame) -> DataFrame:
        """Of lists those with members of several components, and their sizes."""
        own = rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high")
        return own.join(several.select("key", "size"), "key")

    def with_parities(rows: DataFrame) -> DataFrame:
        own = bit_sets.select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "parity")
        return rows.join(own, ["id", "n"])

    rest = written(mixed(lists.select("key", "id", "n", "at")))
    discard(lists)
    blocks, tried = F.ceil(F.col("size") / hot), None
    for turn in range(rounds):
        draw = F.xxhash64("id", F.lit(turn))
        dealt = with_parities(rest.withColumn("block", F.pmod(draw, blocks)).drop("size")).repartition("key", "block").sortWithinPartitions("key", "block", "n", F.xxhash64("id", F.lit(turn)))
        some = dealt.select("key", "block", "id", "n", "at", "component", "parity").mapInArrow(_proposals(percent), "a long, b long, ca long, cb long, room double").distinct()
        some = some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb", "room")
        if tried is not None:
            some = some.join(tried, ["a", "b"], "left_anti")
        # for two components the pairs that seem most alike
        best = Window.partitionBy("ca", "cb").orderBy(F.desc("room"), "a", "b")
        some = written(some.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= TRIES).select("a", "b").distinct())
        more = _links(known, some, words, percent, bits)
        tried = some if tried is None else written(tried.union(some))
        if more.isEmpty():
            break
        labels = _merged(labels, more)
        before, rest = rest, written(mixed(rest.drop("component", "size")))
        discard(before)
    # each pair of a list's blocks; most lists are one block
    across = with_parities(rest.withColumn("block", F.pmod(F.xxhash64("id"), blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    across = across.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n", "at", "component", "parity")
    across = across.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "id")
    last = across.mapInArrow(_across(percent), "a long, b long")
    if tried is not None:
        last = last.distinct().join(tried, ["a", "b"], "left_anti")
    last = _links(known, last, words, percent, bits)
    final = _merged(labels, last).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    discard(rest)
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of documents without near duplicates, of each group of these the document
    with the smallest doc_id, and all rows without a doc_id. Of a document's rows (they share
    the doc_id) those with the same text count once: the one whose columns, as JSON, come first."""
    found = near_duplicates(docs, **parameters)
    gone = written(found.filter("component_id <> doc_id").select("doc_id").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.join(gone, rows["_id"] == gone["doc_id"], "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept.select("_row.*")
    order = Window.partitionBy("_id", F.sha2("_row.text", 256)).orderBy(F.to_json("_row"))
    one = kept.filter("_id is not null").withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("_row.*")
    return one.union(kept.filter("_id is null").select("_row.*"))
