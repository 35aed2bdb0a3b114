"""Line-first cleaning of documents, with built-in functions only.

Each line of a document is judged by itself; a document that loses too much text with the
lines that fail, or that is too short or repeats itself, is rejected.

A line with words fails by
- symbols: more than `symbols` symbol characters a word, as in tables of links (a | b | c);
- shouting: more than `shouts` exclamation marks a word, or capital letters only, from
  `shout_words` words on;
- stutter: more than `stutter_percent` of it are words that follow their like;
- punctuation: at least `run_on_words` words without a mark that ends or joins sentences;
- boilerplate: a phrase of cookie, log-in, copyright or navigation notices.

`clean` returns the other documents without the lines that fail; blank lines stay, and a
document of which no line fails stays as it is.

All of it stays in the row: there is no shuffle. Texts are split into lines and these into
words once. Repeated 8-word windows are found by 64-bit hashes of the windows of one document.

Null texts count as empty; these have no words and are rejected. Repeated rows are judged
one by one. Extra columns pass through `clean` and are ignored by `measure`. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "accept (all )?cookies|uses cookies|cookie (policy|settings)|privacy policy|terms (of (use|service)|and conditions)"
    "|all rights reserved|enable javascript|skip to (main )?content|sign (in|up) (to|now)|log ?in to|subscribe to our"
    "|click here|read more|share (this|on)|back to top|previous (post|page)|next (post|page)|lorem ipsum"
)

#: One of these stands in each text that has such a phrase.
BOILERPLATE_KEYS = ("cookie", "privacy policy", "terms ", "rights reserved", "javascript", "skip to", "sign in ", "sign up ", "log in to", "login to", "subscribe to", "click here", "read more", "share ", "back to top", "previous p", "next p", "lorem ipsum")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    symbols: float = 0.3
    shouts: float = 0.3
    shout_words: int = 5
    run_on_words: int = 60
    stutter_percent: int = 50
    lost_percent: int = 40


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed != "", F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _shifted(a: Column, by: int, keep: Column) -> Column:
    return F.slice(a, F.lit(1 + by), keep)


def window_hashes(words: Column, window: int) -> Column:
    """Hashes of all runs of `window` words; window is a power of two."""
    return _run_hashes(F.transform(words, lambda w: F.xxhash64(w)), F.size(words), window)


def _run_hashes(hashes: Column, words: Column, window: int) -> Column:
    size = 1
    while size < window:
        n = F.greatest(words - (2 * size - 1), F.lit(0))
        hashes = F.zip_with(_shifted(hashes, 0, n), _shifted(hashes, size, n), lambda a, b: F.xxhash64(a, b))
        size *= 2
    return hashes


def _repeated_words(hashes: Column, window: int) -> Column:
    """Words in windows that stand twice or more, from places of such windows in order."""
    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)
    again = F.filter(
        F.zip_with(rows, _shifted(rows, 1, n - 1), lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), (a["h"] == b["h"]).alias("same"))),
        lambda p: F.coalesce(p["same"], F.lit(False)),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(p["a"], p["b"])))))
    gaps = F.zip_with(_shifted(places, 0, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(window)))
    return F.aggregate(gaps, F.lit(window).cast("int"), lambda x, g: x + g)


def _failing(line: Column, own: Column, marks: Column, stutters: Column, rules: Rules) -> Column:
    """Whether a line, whose words are own, fails. marks tells what stands anywhere in the
    text, so that most lines are spared tests."""
    n = F.size(own)
    shouting = marks["shouts"] & (n >= rules.shout_words) & (_count(line, "!") > n * rules.shouts)
    capitals = (n >= rules.shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
    rest = F.greatest(n - 1, F.lit(0))
    again = F.size(F.filter(F.zip_with(_shifted(own, 0, rest), _shifted(own, 1, rest), lambda a, b: a == b), lambda x: x))
    stutter = stutters & (again * 100 > n * rules.stutter_percent)
    run_on = (n >= rules.run_on_words) & ~line.rlike(r"[.!?;:,…。]")
    symbols = (marks["n_symbols"] > 0) & (_symbols(line) > n * rules.symbols)
    return (n > 0) & (symbols | shouting | capitals | run_on | stutter | (marks["phrases"] & F.lower(line).rlike(BOILERPLATE)))


def _may_stutter(again: Column, n_again: Column, rules: Rules) -> Column:
    """Whether a line may fail by stutter: where more than half of its words follow their
    like, a word stands three times in a row."""
    if rules.stutter_percent < 50:
        return n_again > 0
    pairs = F.greatest(F.size(again) - 1, F.lit(0))
    return F.when(n_again > 1, F.exists(F.zip_with(_shifted(again, 0, pairs), _shifted(again, 1, pairs), lambda a, b: a & b), lambda x: x)).otherwise(False)


def _measured(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with _quality, measures and verdict, and _left, the text without failing lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    first = docs.select(
        "*",
        F.struct(
            F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("text"), words_of(x).alias("words"))).alias("lines"),
            _symbols(text).alias("n_symbols"),
            F.contains(text, F.lit("!")).alias("shouts"),
            reduce(or_, [F.contains(low, F.lit(k)) for k in BOILERPLATE_KEYS]).alias("phrases"),
        ).alias("_1"),
    )
    m = first["_1"]
    words = first.select("*", F.flatten(m["lines"]["words"]).alias("_w"))
    hashed = words.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    h, size = hashed["_h"], F.size(hashed["_h"])
    again = F.zip_with(_shifted(h, 0, F.greatest(size - 1, F.lit(0))), _shifted(h, 1, F.greatest(size - 1, F.lit(0))), lambda a, b: a == b)
    paired = hashed.select("*", again.alias("_a"))
    h, size, again = paired["_h"], F.size(paired["_h"]), paired["_a"]
    n_again = F.size(F.filter(again, lambda x: x))
    second = paired.select(
        "*",
        F.struct(size.alias("n"), _run_hashes(h, size, rules.window).alias("hashes"), _may_stutter(again, n_again, rules).alias("stutters")).alias("_2"),
    )
    w = second["_2"]
    third = second.select(
        "*",
        F.when(F.size(F.array_distinct(w["hashes"])) == F.size(w["hashes"]), 0).otherwise(_repeated_words(w["hashes"], rules.window)).alias("_3"),
        F.transform(m["lines"], lambda x: F.struct(x["text"].alias("text"), F.size(x["words"]).alias("n"), _failing(x["text"], x["words"], m, w["stutters"], rules).alias("bad"))).alias("_4"),
    )
    judged = third["_4"]
    worded = F.filter(judged, lambda x: x["n"] > 0)["text"]
    fourth = third.select("*", F.aggregate(judged, F.lit(0), lambda lost, x: lost + F.when(x["bad"], x["n"]).otherwise(0)).alias("_5"), F.struct(F.size(worded).alias("n"), F.size(F.array_distinct(worded)).alias("different")).alias("_6"))
    n, lost = w["n"], fourth["_5"]
    base = (n < rules.min_words) | (100 * third["_3"] > rules.repeat_percent * n)
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        m["n_symbols"].cast("long").alias("n_symbols"),
        (fourth["_6"]["n"] - fourth["_6"]["different"]).cast("long").alias("n_dup_lines"),
        third["_3"].cast("long").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (100 * lost <= rules.lost_percent * n)).alias("kept"),
        F.when(n > 0, lost / n).otherwise(0.0).alias("lost_share"),
    )
    left = F.when(lost > 0, F.array_join(F.filter(judged, lambda x: ~x["bad"])["text"], "\n")).otherwise(F.col("text"))
    return fourth.select(*(F.col(f"`{c}`") for c in docs.columns), measures.alias("_quality"), left.alias("_left"))


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and the measures and verdict of each row."""
    return _measured(docs.select("doc_id", "text"), rules).select("doc_id", "_quality.*")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of documents that aren't rejected, without the lines that fail; n_chars, if
    there, follows the text where lines went."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    # an explode and no filter: a filter would be moved below the measures, and repeat them
    kept = _measured(rows, rules).select("_row", F.explode(F.when(F.col("_quality.kept"), F.array(F.struct(F.col("_left").alias("text"), (F.col("_quality.lost_share") > 0).alias("changed"))))).alias("_left"))
    row = F.col("_row").withField("text", F.col("_left.text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("_left.changed"), F.length("_left.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
        row = row.withField("n_chars", n)
    return kept.select(row.alias("_row")).select("_row.*")
