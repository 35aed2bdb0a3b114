"""Benchmark items in documents, also where numbers, names or units were replaced; with
built-in functions only.

Texts become words in lower case in which numbers, names (capitalised words inside a
sentence) and units after numbers are typed placeholders that keep their value. Windows of
`window` words, placeholders without value, are hashed and joined with those of the
benchmark; a hit's slots are the values of its placeholders on both sides. Hits of one
document and item that stand at the same distance are one match. In it each value of the
item must always have the same counterpart in the document, or the hit doesn't count. A
document is contaminated by an item if hits on one distance number `hits` at least, or all
windows of the item if these are fewer.

Only windows with `solid` words that aren't placeholders tell anything. Items without such
a window are found otherwise. One of fewer than `window` words, `solid` of them plain, is
one window of its own length. Any other, very short or mostly numbers, is found where it
stands with its own values: its windows are of words as they are, and all of them must hit.
Documents have windows of the lengths that such items need, and no more.

The benchmark is broadcast after its size was checked; beyond `broadcast_rows` windows its
side is shuffled. Documents' windows are joined where they are read and aren't shuffled
then; only hits are.

Names are told by their capital, so a copy in lower case shares only windows without names.
Items without words and null and empty texts contain nothing. Repeated items count once;
items that share an id and differ in text are put together. Rows that share
a doc_id are told apart by their text; in `contamination` their results are put together.
Extra columns are ignored by it and kept by `clean`. An empty table of either side gives
an empty result, and leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import _run_hashes, _shifted

WINDOW, SOLID, HITS, BROADCAST_ROWS = 8, 5, 4, 1 << 20
NAME, NUMBER, UNIT = "0name", "0num", "0unit"
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons pound pounds ounce ounces"
    " ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years ml l liter liters litre litres"
    " gallon gallons percent degree degrees c f k w kw kwh v a hz khz mhz ghz b kb mb gb tb dollar dollars euro euros cent cents usd eur"
).split()


def _valued(text: Column) -> Column:
    """Words between single spaces; names and numbers begin with their marks."""
    marked = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;]\s{1,4})", NAME)
    low = F.lower(marked)
    joined = F.when(low.rlike("[0-9][.,][0-9]"), F.regexp_replace(low, "(?<=[0-9])[.,](?=[0-9])", "d")).otherwise(low)
    return F.btrim(F.regexp_replace(joined, r"[^\p{L}\p{M}\p{N}]+", " "))


def _plain(valued: Column) -> Column:
    """The same without values."""
    numbers = F.regexp_replace(valued, r"(?<![^ ])(?!0name)[0-9][0-9d]*(?![^ ])", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<![^ ])0num (?:{'|'.join(UNITS)})(?![^ ])", f"{NUMBER} {UNIT}")
    names = F.regexp_replace(units, r"(?<![^ ])0name[^ ]*", NAME)
    return F.when(valued.rlike("[0-9]"), names).otherwise(valued)


def _unnamed(valued: Column) -> Column:
    return F.regexp_replace(valued, r"(?<![^ ])0name", "")


def _words(c: Column) -> Column:
    return F.when(c != "", F.split(c, " ")).otherwise(F.array().cast("array<string>"))


def _is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def _runs(hashes: Column, words: Column, length: int) -> Column:
    """Hashes of all runs of `length` words: of the powers of two it is made of."""
    out, have = None, 0
    for k in range(length.bit_length()):
        if length >> k & 1:
            own = _run_hashes(hashes, words, 1 << k)
            if out is None:
                out = own
            else:
                n = F.greatest(words - (have + (1 << k) - 1), F.lit(0))
                out = F.zip_with(_shifted(out, 0, n), _shifted(own, have, n), lambda a, b: F.xxhash64(a, b))
            have += 1 << k
    return out


def _windows(texts: DataFrame, key: list[str], window: int, others: list[tuple[bool, int]] = ()) -> DataFrame:
    """A row (key, at, h) for each window of plain words, and for those of `others`: whether
    words keep their values, and how many they are."""
    valued = texts.select(*key, _valued(F.col("text")).alias("valued"))
    words = valued.select(*key, _words(_unnamed(F.col("valued"))).alias("values") if any(own for own, _ in others) else F.lit(None).alias("values"), _words(_plain(F.col("valued"))).alias("words"))
    hashed = words.select(*key, F.size("words").alias("n"), *(F.transform(c, lambda w: F.xxhash64(w)).alias(c) for c in (["words", "values"] if any(own for own, _ in others) else ["words"])))
    main = _runs(F.col("words"), F.col("n"), window)
    if not others:
        return hashed.select(*key, F.posexplode(main).alias("at", "h"))
    numbered = F.transform(main, lambda h, i: F.struct(i.alias("at"), h.alias("h")))
    for own, length in others:
        runs = _runs(F.col("values" if own else "words"), F.col("n"), length)
        numbered = F.concat(numbered, _numbered(runs, _salt(own, length)))
    return hashed.select(*key, F.inline(numbered).alias("at", "h"))


def _salt(valued: bool, length: int) -> int:
    """What tells windows of other kinds from the main ones and from each other."""
    return 2 * length + valued


def _numbered(runs: Column, salt: int) -> Column:
    return F.transform(runs, lambda h, i: F.struct(i.alias("at"), F.xxhash64(h, F.lit(salt)).alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int, solid: int) -> DataFrame:
    """(h, item_id, item_at, slots, n_windows, valued, length, all_of) for each window of an
    item that tells anything; slots: an entry for each word, its value where it is a
    placeholder and else null; all_of: whether all of the item's windows must hit."""
    items = benchmark.filter("text is not null").select("item_id", _valued(F.col("text")).alias("valued"))
    items = items.select("item_id", _words(F.col("valued")).alias("values"), _words(_unnamed(F.col("valued"))).alias("own"), _words(_plain(F.col("valued"))).alias("words")).withColumns({"n": F.size("words"), "version": F.xxhash64("values")}).filter("n > 0").distinct()
    slots = F.zip_with("words", "values", lambda w, v: F.when(_is_slot(w), v))
    hashed = written(items.select("item_id", "version", "n", F.transform("words", lambda w: F.xxhash64(w)).alias("plain_hashes"), F.transform("own", lambda w: F.xxhash64(w)).alias("value_hashes"), slots.alias("all_slots")))
    n_solid = lambda a: F.size(F.filter(a, lambda x: x.isNull()))
    own = F.slice("all_slots", F.col("at") + 1, F.lit(window))
    main = hashed.select("*", F.posexplode(_runs(F.col("plain_hashes"), F.col("n"), window)).alias("at", "h")).withColumn("slots", own).filter(n_solid("slots") >= solid)
    main = written(main.select("h", "item_id", F.col("at").alias("item_at"), "slots", F.lit(False).alias("valued"), F.lit(window).alias("length"), F.lit(False).alias("all_of"), "version").distinct())
    # items that share an id and differ in text are told apart by version
    rest = hashed.join(main.select("version").distinct(), "version", "left_anti")

    def by_length(hashes: str, valued: bool, most: int) -> Column:
        out = F.array().cast("array<struct<at:int,h:bigint>>")
        for length in range(1, most + 1):
            out = F.when(F.least("n", F.lit(most)) == length, _numbered(_runs(F.col(hashes), F.col("n"), length), _salt(valued, length))).otherwise(out)
        return F.transform(out, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.lit(valued).alias("valued")))

    whole = F.when((F.col("n") < window) & (n_solid("all_slots") >= solid), by_length("plain_hashes", False, window - 1)).otherwise(F.array())
    part = rest.select("*", F.least("n", F.lit(window)).alias("length"), F.inline(F.concat(by_length("value_hashes", True, window), whole)).alias("item_at", "h", "valued"))
    nothing = F.transform(F.sequence(F.lit(1), F.col("length")), lambda _: F.lit(None).cast("string"))
    part = part.select("h", "item_id", "item_at", F.when(F.col("valued"), nothing).otherwise(F.col("all_slots")).alias("slots"), "valued", "length", F.lit(True).alias("all_of"), "version")
    rows = written(main.unionByName(part.distinct()))
    return rows.join(rows.groupBy("version").agg(F.countDistinct("item_at").alias("n_windows")), "version")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, solid: int, broadcast_rows: int) -> DataFrame:
    """(id, copy, at, item_id, version, item_at, n_windows, all_of, same) for all windows
    that stand in an item with slots that agree; same: their values are the item's own."""
    texts = docs.filter("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("copy"), "text")
    items = written(benchmark_windows(benchmark, window, solid))
    others = [(r["valued"], r["length"]) for r in items.filter("all_of").select("valued", "length").distinct().orderBy("valued", "length").collect()]  # 2 * window at most
    keys = items.select("h").distinct()
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    found = written(_windows(texts, ["id", "copy"], window, others).join(keys, "h").distinct())
    hits = found.join(items, "h").withColumn("slotted", F.exists("slots", lambda x: x.isNotNull()))
    columns = ["id", "copy", "at", "item_id", "version", "item_at", "n_windows", "all_of"]
    plain = hits.filter("not slotted").select(*columns, F.lit(True).alias("same"))
    slotted = hits.filter("slotted").select(*columns, "length", "slots")
    # the document's values, from the texts of those few documents that need them
    wanted = written(slotted.select("id", "copy", "at", "length").distinct())
    by_doc = wanted.groupBy("id", "copy").agg(F.collect_set(F.struct("at", "length")).alias("ats"))
    t = texts.alias("t").join(by_doc.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.copy") == F.col("w.copy"))).select("t.id", "t.copy", "w.ats", _words(_valued(F.col("t.text"))).alias("values"))
    own = t.select("id", "copy", "values", F.inline("ats").alias("at", "length")).select("id", "copy", "at", "length", F.slice("values", F.col("at") + 1, F.col("length")).alias("values")).distinct()
    s, o = slotted.alias("s"), own.alias("o")
    both = s.join(o, F.col("s.id").eqNullSafe(F.col("o.id")) & (F.col("s.copy") == F.col("o.copy")) & (F.col("s.at") == F.col("o.at")) & (F.col("s.length") == F.col("o.length")))
    both = both.select(*(f"s.{c}" for c in columns), "s.slots", "o.values").withColumn("distance", F.col("at") - F.col("item_at"))
    match = ["id", "copy", "item_id", "version", "distance"]
    pairs = both.withColumn("pair", F.explode(F.filter(F.zip_with("slots", "values", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda p: p["item"].isNotNull())))
    broken = pairs.groupBy(*match, "pair.item").agg(F.min("pair.doc").alias("low"), F.max("pair.doc").alias("high")).filter("low <> high").select(*match, "item")
    broken = written(broken.groupBy(*match).agg(F.collect_set("item").alias("items")))
    b, k = both.alias("b"), broken.alias("k")
    equal = F.col("b.copy") == F.col("k.copy")
    for c in ("id", "item_id", "version", "distance"):
        equal &= F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}"))
    judged = b.join(k, equal, "left")
    agreed = judged.filter(F.col("k.items").isNull() | ~F.arrays_overlap("b.slots", "k.items"))
    same = F.forall(F.zip_with("b.slots", "b.values", lambda x, y: x.isNull() | (x == y)), lambda x: x)
    return plain.union(agreed.select(*(f"b.{c}" for c in columns), same.alias("same")))


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, solid: int, hits: int, broadcast_rows: int) -> DataFrame:
    found = _hits(docs, benchmark, window, solid, broadcast_rows)
    matches = found.groupBy("id", "copy", "item_id", "version", (F.col("at") - F.col("item_at")).alias("distance")).agg(
        F.countDistinct("item_at").alias("n_hits"), F.max("n_windows").alias("n_windows"), F.max("all_of").alias("all_of"), F.min("at").alias("first_word"), F.min("same").alias("same")
    )
    return matches.filter(F.col("n_hits") >= F.when(F.col("all_of"), F.col("n_windows")).otherwise(F.least(F.lit(hits), F.col("n_windows"))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, solid: int = SOLID, hits: int = HITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each document and item in it: doc_id, item_id, n_hits (windows on the best
    distance), coverage (of the item's windows), first_word (from 0, the first such), same
    (all values are the item's own)."""
    found = _matches(docs, benchmark, window, solid, hits, broadcast_rows)
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.max("n_hits").alias("n_hits"),
        F.max(F.col("n_hits") / F.col("n_windows")).alias("coverage"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("same").alias("same"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, solid: int = SOLID, hits: int = HITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of documents that contain no item, unchanged."""
    found = written(_matches(docs, benchmark, window, solid, hits, broadcast_rows).select("id", "copy").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_copy"))
    return rows.join(found, rows["_id"].eqNullSafe(found["id"]) & (rows["_copy"] == found["copy"]), "left_anti").select("_row.*")
