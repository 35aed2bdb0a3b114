"""The operators of quarry.llm against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_extract, importance, jaccard_join, license_scan, packing, pii, quality_rules, substring_dedup, toxicity
from quarry.llm.queries import queries
from quarry.llm.textnum import Words, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {a: a + 32 for a in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ids that repeat, and columns with odd names."""
    long = " ".join(f"w{i % 977}x{i % 53}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "one", "a b c d e f g h", long, long, "É" * 10, "x\x0by\x1fz", "same text here " * 30]
    df = frame(spark, texts, [1, 2, 3, 4, 4, None, 6, 7, 8, 9, 9])
    return df.withColumns({"id": F.lit(5), "key": F.lit("k"), "n": F.lit(1), "copy": F.lit(2), "words": F.lit("w"), "start": F.lit(3), "component_id": F.lit(0), "_1": F.lit(0)})


def words_of(text):
    return WORD.findall(text or "")


# --- helpers ----------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a b", "", None, " x\ty ", "zé\x0bq", "a", "b", "a b c d e f a b c d e f", "   "]
    w = Words(pa.array(texts))
    assert [w.text(i) for i in range(len(w.starts))] == [x for t in texts for x in words_of(t)]
    assert w.counts().tolist() == [len(words_of(t)) for t in texts]
    h = w.hashes()
    names = [w.text(i) for i in range(len(h))]
    assert len(set(h.tolist())) == len(set(names))
    for k in (1, 2, 3, 5, 7, 8, 20):
        r = runs(h, k)
        groups = defaultdict(set)
        for i in range(len(h) - k + 1):
            groups[tuple(names[i : i + k])].add(int(r[i]))
        assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


# --- 1 ----------------------------------------------------------------------------------


def licence_brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences(spark, docs):
    extra = ["under the MIT License, under the mit license", None, "", "cc-by-nc CC BY NC", "Apache License, Version 2.0; apache license version 2x", "İ ſ K under the mit license"]
    rows = docs.select("doc_id", "text").union(frame(spark, extra, range(-len(extra), 0)).select("doc_id", "text"))
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.scan(rows).collect()}
    assert got == {r["doc_id"]: licence_brute(r["text"]) for r in rows.collect()}


def test_licence_rules_and_containment(spark):
    texts = {
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
        "licensed under the GNU General Public License, version 3.": "gpl-3",
        "This is released under the terms of the BSD 3-Clause License": "bsd-3-clause",
        "see the Creative Commons Attribution-ShareAlike 4.0 license": "cc-by-sa",
        "Mit freundlichen Worten under und mit allem": "",
        "released into the public domain. Also the MIT license": "mit,public-domain",
    }
    got = [r["labels"] for r in license_scan.scan(frame(spark, list(texts))).orderBy("doc_id").collect()]
    assert got == list(texts.values())
    assert len(license_scan.rules()) > 200


def detections_brute(text):
    """(label, first, end) of all rules' matches that no earlier one of the same or a higher priority contains, and the best score."""
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) + " "
    hits = []
    for k, rule in enumerate(license_scan.rules()):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", words):
            first = words[: m.start()].count(" ") - 1
            hits.append((first, -(first + m[0].count(" ") + 1), -rule.priority, k, rule.label, rule.score))
    kept = []
    for h in sorted(hits):
        if not any(o[1] <= h[1] and o[2] <= h[2] for o in sorted(hits) if o[:4] < h[:4]):
            kept.append((h[4], h[0], -h[1], h[5]))
    return kept


def test_detections_against_brute_force(spark, docs):
    rng = random.Random(21)
    notices = ["SPDX-License-Identifier: {}", "released under the terms of the {} license", "{} licence", "license: {}", "This is licensed under {}."]
    names = ["MIT", "GPL-2.0", "GNU General Public License v3", "LGPL 2.1", "Apache 2.0", "BSD 3-Clause", "Mozilla Public License 2.0", "CC BY-NC-SA 4.0", "ISC", "EPL 2.0", "zlib"]
    plain = lambda p: re.sub(r"\?|\.\{[^}]*\}", "", re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", re.sub(r"\[(.)[^\]]*\]", r"\1", p)))
    texts = [plain(p) for _, p, _ in license_scan.TEXTS]
    extra = [" and ".join([rng.choice(notices).format(rng.choice(names)), *rng.sample(texts, 2), rng.choice(notices).format(rng.choice(names))]) for _ in range(80)]
    extra += [f"Some words. {t.capitalize()}, then more." for t in texts] + [None, "", "all rights reserved. All rights reserved", "under the MIT license " * 3]
    rows = frame(spark, extra)
    want = {k: detections_brute(t) for k, t in enumerate(extra)}
    got = defaultdict(list)
    for r in license_scan.detections(rows).collect():
        got[r["id"]].append((r["label"], r["first"], r["end"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    for r in license_scan.scan(rows).collect():
        base = licence_brute(extra[r["doc_id"]])
        assert r["labels"] == ",".join(sorted({*filter(None, base[4].split(",")), *(x[0] for x in want[r["doc_id"]])}))
        assert r["score"] == max([0.9] * bool(base[4]) + [x[3] for x in want[r["doc_id"]]], default=0.0)
    found = {x[0] for v in want.values() for x in v}
    assert len(found) > 50 and len(license_scan.TEXTS) > 80


def written_as(rng, pattern):
    """A text that a rule's pattern matches."""
    p = re.sub(r"\.\{(\d+),(\d+)\}", lambda m: "".join(rng.choice("ab ") for _ in range(rng.randint(int(m[1]), int(m[2])))), pattern)
    p, q = re.sub(r"\[(\w+)\]", lambda m: rng.choice(m[1]), p), None
    while q != p:
        q, p = p, re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|")), p)
    return re.sub(r"([\w ])\?", lambda m: rng.choice([m[1], ""]), p)


def test_a_rule_is_tried_on_what_it_matches(spark):
    rng, rules, head = random.Random(22), license_scan.rules(), license_scan.heads()
    starts, seen, texts = re.compile(license_scan._starts(set(head.values()))), Counter(), []
    for k, r in enumerate(rules):
        short = r.keyword == "cc by n"  # tried on texts with these words alone, though a name may be written out
        for _ in range(20):
            text = " " + re.sub(" +", " ", written_as(rng, r.pattern)).strip() + " "
            if not re.search(f"(?<= )(?:{r.pattern})(?= )", text) or short and r.keyword not in text:
                continue
            seen[k] += 1
            found = {h[1:] for h in starts.findall(text)}
            assert re.search(license_scan.gate(), text) and r.keyword in text, (r, text)
            assert any(p in text and head[p] in found for p in r.phrases), (r, text)
        texts.append(text if not short or r.keyword in text else "")
    assert len(seen) > 0.95 * len(rules)
    rng.shuffle(texts)
    texts = [" and, ".join(texts[i : i + 10]).upper() for i in range(0, len(texts), 10)]
    got = defaultdict(list)
    for r in license_scan.detections(frame(spark, texts)).collect():
        got[r["id"]].append((r["label"], r["first"], r["end"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(d) for k, t in enumerate(texts) if (d := detections_brute(t))}


def test_few_rules_are_tried(spark, docs):
    texts = ["Licensed under the MIT License.", "the vim of an unlicensed, undercooked apache", "all rights reserved; cc by nc", "plain words under no notice", None]
    got = Counter(r["id"] for r in license_scan.tried(frame(spark, texts)).collect())
    assert 1 <= got[0] <= 10 and got[1] <= 10 and 2 <= got[2] <= 40 and not got[3]
    assert license_scan.tried(docs).count() <= docs.count()


# --- 2 ----------------------------------------------------------------------------------


def quality_brute(text):
    w = words_of(text)
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    covered = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def fails_brute(line, rules=quality_rules.Rules()):
    own = words_of(line)
    n = len(own)
    if not n:
        return False
    return (
        sum(c in "#*$%&|<>" for c in line) > n * rules.symbols
        or n >= rules.shout_words and line.count("!") > n * rules.shouts
        or n >= rules.shout_words and not regex.search(r"\p{Ll}", line) and bool(regex.search(r"\p{Lu}", line))
        or n >= rules.run_on_words and not re.search("[.!?;:,…。]", line)
        or 100 * sum(a == b for a, b in zip(own, own[1:])) > rules.stutter_percent * n
        or bool(re.search(quality_rules.BOILERPLATE, line.lower()))
    )


def verdict_brute(text):
    """kept, the share that is lost, and what is left."""
    n, *_, failed = quality_brute(text)
    lines = (text or "").split("\n")
    bad = [fails_brute(x) for x in lines]
    lost = sum(len(words_of(x)) for x, b in zip(lines, bad) if b)
    return not failed and 100 * lost <= 40 * n, lost / n if n else 0.0, "\n".join(x for x, b in zip(lines, bad) if not b) if lost else text


def test_quality_measures(spark, docs, odd):
    for rows in (docs, odd):
        got = sorted((tuple(r)[:7], r["kept"], round(r["lost_share"], 9)) for r in quality_rules.measure(rows).collect() if r["doc_id"] is not None)
        texts = [(r["doc_id"], r["text"]) for r in rows.collect() if r["doc_id"] is not None]
        assert got == sorted(((i, *quality_brute(t)), verdict_brute(t)[0], round(verdict_brute(t)[1], 9)) for i, t in texts)
        left = sorted((r["doc_id"], r["text"]) for r in quality_rules.clean(rows).collect() if r["doc_id"] is not None)
        assert left == sorted((i, verdict_brute(t)[2]) for i, t in texts if verdict_brute(t)[0])


def test_lines_are_judged_alone(spark):
    plain = [f"Line{k} has words{k} that none{k} repeats{k}." for k in range(14)]
    texts = [
        "\n".join([*plain, *(f"{w} {w} {w} {w} {w}{k} {w}{k} {w}{k}" for k, w in enumerate("abcdefghijkl"))]),  # stutter in half of the lines
        "\n".join([*plain[:7], "This site uses cookies to work.", "", *plain[7:]]),
        "\n".join(" " * 80 + " ".join(x.split()[:4]).rstrip(".") for x in plain),  # white space isn't words
    ]
    got = quality_rules.measure(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["kept"], r["lost_share"]) for r in got] == [(v[0], pytest.approx(v[1])) for v in map(verdict_brute, texts)]
    assert [r["kept"] for r in got] == [False, True, True] and got[0]["lost_share"] > 0.4 and got[2]["lost_share"] == 0
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality_rules.clean(frame(spark, texts)).collect()}
    cut = "\n".join([*plain[:7], "", *plain[7:]])
    assert left == {1: (cut, len(cut)), 2: (texts[2], len(texts[2]))}


def test_quality_verdicts(spark, docs, folder):
    good = " ".join(f"word{i} and more," for i in range(15)) + " to end."
    bad = ["a1 | b2 | c3 | d4 | e5 | f6 | g7 | h8 | i9 | " * 3, "\n".join(f"BUY{i} THIS{i} NOW{i} CHEAP{i} TODAY{i}" for i in range(10)), "\n".join(f"We use{i} cookies here now; our cookie policy tells{i} more." for i in range(9)), " ".join(f"w{i} w{i} w{i} w{i}" for i in range(20))]
    got = [r["kept"] for r in quality_rules.measure(frame(spark, [good, *bad])).orderBy("doc_id").collect()]
    assert got == [True, False, False, False, False]
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    n = labels.join(quality_rules.measure(docs), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in n.collect()}
    assert share[1] > 0.9 and share[0] < 0.1


def test_stutter_is_judged_by_lines(spark):
    stutter = " ".join((" ".join(["a"] * 13), *(f"b{k}" for k in range(10))))  # 12 of 23 words
    plain = "\n".join(f"Line{k} has words, of{k} which{k} none{k} repeats{k}." for k in range(4))
    texts = [f"{stutter}\n{plain}", f"{plain}\n\n{plain.replace('Line', 'Row').replace('has', 'with')}\n{stutter}", plain]
    share = [23 / 51, 23 / 79, 0.0]
    rows = frame(spark, texts)
    got = quality_rules.measure(rows).orderBy("doc_id").collect()
    assert [r["lost_share"] for r in got] == pytest.approx(share) and [r["kept"] for r in got] == [False, True, True]
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality_rules.clean(rows).collect()}
    cut = texts[1].rsplit("\n", 1)[0]
    assert left == {1: (cut, len(cut)), 2: (plain, len(plain))}


# --- 3 ----------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_equal_edit_distance():
    rng = random.Random(2)
    terms = ["abcde", "abcabcabc", "bbbbb", "ccc", "aabbccdda"]
    m = toxicity.Matcher([(t, 0, toxicity.errors_for(t)) for t in terms])
    for _ in range(4000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        assert {t for t, _ in m.match(w)} == {t for t in terms if edits(w, t) <= toxicity.errors_for(t)}
    assert toxicity.Matcher([("lowei", 2, 0)]).match("loweichen") == (("lowei", 2),)


def test_toxicity_context_and_misspelling(spark):
    lexicon = toxicity.Lexicon({("idiot", 0): 4.0, ("idiot", 1): 3.0}, -4.0)
    texts = ["plain words here", "what an idiot", "what an idi0t", 'they wrote the word "idiot" here', "you idiot", None, ""]
    s = [r["score"] for r in toxicity.score(frame(spark, texts), lexicon).orderBy("doc_id").collect()]
    assert s[0] == s[5] == s[6] < s[3] < s[2] < s[1] < s[4]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = queries()["op3_toxicity"](spark, folder)
    assert got.count() == rows.count()
    for r in got.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = got.filter("held_out").join(labels.filter("toxic is not null"), "doc_id").select("score", "toxic").collect()
    good, bad = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.75
    assert toxicity.learn(rows, labels.limit(0)).weights.keys() == {(t, 0) for t in toxicity.SEEDS}


# --- 4 ----------------------------------------------------------------------------------


def test_odd_labels(spark, odd, folder):
    """Labels that are null, repeated or contradict each other: of several the largest counts."""
    plain, bad = "words that are plain and calm in here", "you utter nitwit of a man go away"
    texts = [f"{bad if k % 3 == 0 else plain} {k} {k * 7 % 11}" + f" w{k} v{k % 5}" * 3 for k in range(300)]
    rows = frame(spark, [*texts, None, ""], [*range(300), 300, 301])
    marks = [(k, int(k % 3 == 0), k % 2) for k in range(300)] + [(3, 0, None), (3, 1, 1), (3, 1, 1), (None, 1, 1), (4, None, None), (900, 1, 1), (300, 0, 0), (301, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(rows, labels)
    clean = toxicity.learn(rows, labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    assert lexicon == clean and ("nitwit", 0) in lexicon.weights and all(r["held_out"] is not None for r in toxicity.score(rows, lexicon).collect())
    kept = importance.select(rows, labels, share=0.5)
    assert kept.count() == round(0.5 * rows.count()) and importance.select(rows, labels.limit(0), share=0.5).count() in (0, round(0.5 * rows.count()))


def test_top_k_equals_sort(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, float(rng.choice([1, 2, 2, 3, rng.random() * 9]))) for i in range(400)], "doc_id long, key double").cache()
    want = sorted((-r["key"], r["doc_id"]) for r in rows.collect())
    for k in (0, 1, 37, 250, 400, 999):
        assert sorted((-r["key"], r["doc_id"]) for r in importance.top_k(rows, k).collect()) == want[:k]


def test_importance_weights_and_selection(spark):
    folder = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    buckets = 1 << 10
    target, raw, grams = np.ones(buckets), np.ones(buckets), {}
    for r in rows.collect():
        w = Words(pa.array([r["text"]]), lower=True)
        g = (np.concatenate([w.hashes(), runs(w.hashes(), 2)]) & np.uint64(buckets - 1)).astype(int)
        grams[r["doc_id"]] = g
        np.add.at(raw, g, 1)
        if r["doc_id"] in good:
            np.add.at(target, g, 1)
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(importance.log_ratios(rows, labels, buckets), ratios)
    for r in importance.weigh(rows, ratios).collect():
        assert r["log_weight"] == pytest.approx(ratios[grams[r["doc_id"]]].sum(), abs=1e-6)
    kept = {r["doc_id"] for r in importance.select(rows, labels).collect()}
    n = labels.agg(F.avg("quality")).first()[0]
    assert len(kept) == round(n * rows.count())
    junk = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    assert len(good & kept) / len(good) > 0.95 and len(junk & kept) / len(junk) < 0.3


# --- 5 ----------------------------------------------------------------------------------


def test_plan_places_all():
    rng = random.Random(3)
    for length in (8, 16, 1024):
        for _ in range(100):
            histogram = {rng.randint(1, length): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
            placed = Counter()
            for pattern, n in packing.plan(histogram, length):
                assert sum(pattern) <= length and n > 0
                for s in pattern:
                    placed[s] += n
            assert placed == histogram


def shortest_pack_first(histogram, length):
    """One length after the other."""
    packs = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            k = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
            if k is not None and sum(packs[k]) + size <= length:
                packs[k].append(size)
            else:
                packs.append([size])
    return Counter(map(tuple, packs))


def test_plan_is_shortest_pack_first():
    assert dict(packing.plan({700: 1, 600: 1, 300: 1}, 1024)) == {(700,): 1, (600, 300): 1}
    rng = random.Random(6)
    for _ in range(200):
        histogram = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        got = Counter({sum(p): 0 for p, _ in packing.plan(histogram, 64)})
        for p, n in packing.plan(histogram, 64):
            got[sum(p)] += n
        want = Counter()
        for p, n in shortest_pack_first(histogram, 64).items():
            want[sum(p)] += n
        assert got == want


def check_packed(pieces, texts, length=1024):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert own.keys() == ids.keys()
    for i, found in own.items():
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= length
    return sum(p["length"] for p in pieces) / (length * len(sequences))


def test_packing_round_trip(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {-1: None, -2: "", -3: "<|endoftext|> x", -6: "a <|endoftext|><|endoftext|>b", -4: "  \n" * 3000, -5: "a" * 5000}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_packed(packing.pack(rows).collect(), texts) > 0.97
    assert packing.pack(rows.limit(0)).count() == 0


def test_long_white_space_is_encoded(monkeypatch):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(files.path("byte_bpe_50k.json")), packing.encoder()
    assert encode("<|endoftext|> x").tolist() == [50256, 2124]
    texts = [" " * 1_100_000 + "x", "a" + "\n" * 1_100_000 + "x", "b<|endoftext|>" + " " * 1_100_000]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [encode(x).tolist() for x in texts] == want
    monkeypatch.setattr(packing, "RUN", 1 << 30)  # so that the engine panics
    assert [encode(x).tolist() for x in texts] == want


# --- 6 ----------------------------------------------------------------------------------


def shingles(text, k=5):
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups_brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_components(spark, docs):
    rng = random.Random(11)
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 120").collect()}
    base = [f"t{rng.randint(0, 50)}" for _ in range(120)]
    for k in range(60):  # a group of near copies of which many don't link directly
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
        texts[1000 + k] = " ".join(w)
    for k in range(80):  # light sets about the bounds
        texts[2000 + k] = " ".join(f"s{x}" for x in range(rng.randint(0, 2), rng.randint(3, 18)))
    for k in range(30):  # a passage that many share
        texts[3000 + k] = " ".join(f"p{x}" for x in range(40)) + " " + " ".join(f"u{k}_{x}" for x in range(rng.randint(1, 60)))
    texts |= {4000: None, 4001: "", 4002: "A b", 4003: "a B", 4004: "a b c"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = groups_brute(texts)
    for parameters in ({}, {"rounds": 1, "hot": 5, "subsets": 1}):  # also lists dealt over blocks
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(rows, sketch_bits=16, **parameters).collect()}
        assert got == want
    kept = {r["doc_id"] for r in jaccard_join.one_of_each(rows, sketch_bits=16).collect()}
    assert kept == {c for _, c in got.values()}


def test_one_of_each_keeps_a_documents_rows(spark):
    base = " ".join(f"t{k}" for k in range(30))
    rows = [(1, base, "a"), (1, base, "b"), (1, "another text", "a"), (2, f"{base} end", "a"), (3, "third text", "z"), (None, base, "a"), (None, base, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    got = sorted(tuple(map(str, r)) for r in jaccard_join.one_of_each(df, sketch_bits=16).collect())
    assert got == sorted(tuple(map(str, r)) for r in (rows[0], rows[2], rows[4], rows[5], rows[6]))


def test_links_become_stars(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(200, 0, -1)] + [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(300)]
    up = {x: x for pair in links for x in pair}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    for parts in (1, 7):
        df = spark.createDataFrame(links, "a long, b long").repartition(parts)
        got = {r["id"]: r["component"] for r in jaccard_join.components(df).collect()}
        assert got == {x: c for x, c in up.items() if any(x in pair and pair[0] != pair[1] for pair in links)}


def test_parities_understate_differences():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 3, 70, 90, 200, 300, 1000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, 1 + len(s) // 10).astype(np.uint64)])) for s in sets]
    first = np.cumsum([0, *map(len, sets)])
    p = jaccard_join.Parities(pa.array(jaccard_join._parities(np.concatenate(sets), first), pa.binary()))
    for a, x in enumerate(sets):
        apart = p.apart(np.full(len(sets), a), np.arange(len(sets)))
        assert apart[a] == 0 and all(d <= len(np.setxor1d(x, y)) for d, y in zip(apart, sets))
    assert p.apart(np.array([6]), np.array([13]))[0] > 100


def test_light_sets_list_subsets():
    light = lambda sizes, shared: jaccard_join.light_size(sizes, shared)
    sizes = dict.fromkeys(range(30), 100)
    assert light({}, 9.0) == 1 and light(sizes, 1.0) < light(sizes, 5.0) <= light(sizes, 500.0)
    assert jaccard_join.subsets_of(light(sizes, 500.0)) <= jaccard_join.SUBSETS
    for a in range(1, 30):
        for b in range(jaccard_join.least(a), a + 1):
            c = jaccard_join.needed(a, b)
            assert 100 * c >= 80 * (a + b - c) and 100 * (c - 1) < 80 * (a + b - c + 1)
            assert jaccard_join.least(a) <= c <= max(b, c)


# --- 7 ----------------------------------------------------------------------------------

BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_brute(text):
    out = {}
    for kind, pattern in BASE_PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_spans_equal_patterns():
    rng, automaton = random.Random(1), pii._automaton()
    parts = ["@", "a", "b.c", ".", "1", "23", "4111111111111111", " ", "-", "+", "+1 (555) 123-4567", "1.2.3.4", "256.1.1.1", "x@y.z", "é", "(", ")", "a@b.c", "\n", "0", "99", 'token = "abcdef0123456789abcdef"', "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = pii.spans_of(text, automaton)
        assert {k: got[k] for k in pii.KINDS} == spans_brute(text), text


def iban(country, body):
    digits = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def own_spans_brute(text):
    """Spans of the method's own kinds, by plain patterns."""
    out = {}
    out["url"] = [(m.start(), m.start() + len(m[0].rstrip(".,;:!?)"))) for m in re.finditer(r"[A-Za-z]{1,12}://[^\s<>\"'|]+", text)]
    cues = "|".join(x for c in pii.CUES for x in (c, c.upper(), c.capitalize()))
    out["secret"] = [m.span(1) for m in re.finditer(rf"(?:{cues})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([A-Za-z0-9+/_.~-]{{16,}})", text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    cues = "|".join(x for c in pii.ACCOUNT_CUES for x in (c, c.upper(), c.capitalize()))
    out["account"] = [m.span(1) for m in re.finditer(rf"(?:{cues})(?:\s(?:no|nr|number|id))?[.:#=\s]{{1,4}}([0-9][0-9-]{{4,18}}[0-9])", text)]
    found, at = [], 0
    while m := re.compile(rf"(?<![^\W_])(?:{'|'.join(pii.COUNTRIES)})[0-9]{{2}}").search(text, at):
        at = m.start() + 1
        ends = [e for e in range(len(text), m.start(), -1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", text[m.start() : e])]
        for e in ends[:1] + [x for x in ends[1:] if text[x : x + 1] == " "]:
            s = text[m.start() : e].replace(" ", "")
            if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                found.append((m.start(), e))
                at = e
                break
    out["iban"] = found
    return out


def test_own_kinds_against_patterns():
    rng, automaton = random.Random(17), pii._automaton()
    secret = lambda n: "".join(rng.choice("abcXYZ019_-") for _ in range(n))
    body = lambda: "".join(rng.choice("0123456789") for _ in range(18))
    spaced = lambda s: " ".join(s[k : k + 4] for k in range(0, len(s), 4))
    for _ in range(6000):
        makers = [lambda: f"http://h.org/{secret(3)}.", lambda: f"token = '{secret(rng.randint(12, 24))}'", lambda: f"API_KEY: {secret(20)}", lambda: f"account no {rng.randint(10**4, 10**9)}", lambda: "SSN: 123-45-6789", lambda: iban("DE", body()), lambda: spaced(iban("FR", body())) + " THEN", lambda: spaced(iban("NO", "86011117947")), lambda: "DE12 3456", lambda: "plain words", lambda: "IBAN", lambda: "x@y.z"]
        text = " ".join(rng.choice(makers)() for _ in range(rng.randint(1, 6)))
        got = pii.spans_of(text, automaton)
        assert {k: got[k] for k in pii.OWN_KINDS} == own_spans_brute(text), text


def test_personal_data(spark, docs):
    for r, d in zip(pii.find(docs).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        want = spans_brute(d["text"] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
    text = 'mail a@b.c, +1 (555) 123-4567, iban DE89 3704 0044 0532 0130 00, token = "abcdef0123456789abcdef" http://x.y/z?q=a@b.cd. end'
    out = pii.redact(frame(spark, [text, None])).orderBy("doc_id").collect()
    assert out[0]["text"] == 'mail <email>, <phone>, iban <iban>, token = "<secret>" <url>. end' and out[0]["n_chars"] == len(out[0]["text"]) and out[1]["text"] is None


# --- 8 ----------------------------------------------------------------------------------


def test_main_text(spark, folder):
    import html

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", source[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_main_text_is_the_same_beyond_the_broadcast(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert sorted(map(tuple, html_extract.extract(pages, hosts=0, salts=3).collect())) == sorted(map(tuple, html_extract.extract(pages).collect()))


def test_main_text_by_template_and_names(spark):
    shell = "<html><body><div><p>Welcome to our site</p></div><div><p>{}</p><p>A<i>b</i> &lt;c&gt;</p></div><div><p>All about us</p></div></body></html>"
    rows = [(k, f"http://h.org/{k}", shell.format(f"Story {k}")) for k in range(4)]
    rows += [(10, "http://x.org", '<header>H</header><div class="content">Hi <b>y</b>ou<p>par<ul><li>one<li>two</ul><div class="comments">no</div><div class=ad>n</div><form>f</form></div><aside>z</aside><script>s</script>'), (11, None, None), (12, "u", "")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story 0 Ab <c>" or got[0].startswith("Story 0")
    assert got[10] == "Hi you par one two" and got[11] == "" and got[12] == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(rng, name, n):
    """Pages without an article or telling names, and their main texts."""
    say = lambda k: " ".join(rng.choice("alder birch cedar dune ember fjord grove heath inlet knoll".split()) + str(rng.randint(0, 99)) for _ in range(k))
    pages = []
    for k in range(n):
        entries = "".join(f"<li><p>{say(2)}</p><p>Open</p></li>" for _ in range(rng.randint(1, 4)))
        story = [say(rng.randint(20, 40)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in story)
        html = f"<html><head><title>T</title></head><body><div id=x1><p>Our site</p><ul>{entries}</ul></div><div id=x2><h2>{say(3)}</h2>{body}<div id=x5><p>Filed under news</p></div></div><div id=x3><p>{say(3)}</p></div></body></html>"
        head = re.search("<h2>(.*?)</h2>", html)[1]
        pages.append((f"http://{name}/{k}", html, " ".join([head, *story])))
    return pages


def test_main_slot_of_a_template(spark):
    rng = random.Random(12)
    rows = [*site(rng, "a.org", 9), *site(rng, "b.org", 5)]
    rows += [("http://a.org/none", None, ""), ("http://a.org/empty", "", ""), ("http://a.org/404", "<html><body><p>Not found</p></body></html>", "Not found")]
    rows += [(u, h, t) for u, h, t in rows[:1]]  # a page that repeats
    rows.append(("http://open.org/", "<html><head><title>x<body><div class=content><p>Text of it</p></div></body>", "Text of it"))
    want = {k: t for k, (_, _, t) in enumerate(rows)}
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages, hosts=0, salts=2).collect()} == want


def test_classes_equal_vectors(spark):
    rows = [(u, h) for u, h, _ in [*site(random.Random(13), "a.org", 8), *site(random.Random(14), "b.org", 4)]]
    counts = defaultdict(lambda: defaultdict(dict))
    for k, (u, h) in enumerate(rows):
        blocks, tags = html_extract.blocks_of(h)
        for token, n in Counter([*tags, *(f"{p}>{t}" for t, p, _ in blocks)]).items():
            counts[u.split("/")[2]][html_extract._key(token)][k] = n
    want = set()
    for host, tokens in counts.items():
        n, groups = len({k for v in tokens.values() for k in v}), defaultdict(set)
        for token, v in tokens.items():
            if len(v) >= 3 and 2 * len(v) >= n:
                groups[tuple(sorted(v.items()))].add(token)
        want |= {(host, frozenset(g)) for g in groups.values()}
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {(r["host"], frozenset(t["token"] for t in r["tokens"])) for r in html_extract.classes(pages).collect()}
    assert got <= want and all(len(g) == 1 for _, g in want - got) and len(got) >= 6  # all but blocks without an element


def test_odd_pages(spark):
    long = "<div><p>" + "word " * 200_000 + "</p></div>" * 2
    rows = [(1, "http://x.org/1", long), (1, "http://x.org/1", long), (None, None, None), (2, "", "no tags"), (3, "::", "<p>open"), (4, "http://x.org/2", "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "template", "salt", "key", "fixed", "main", "token", "n", "vector")})
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:9], r["n_chars"]) for r in html_extract.extract(df).collect()), key=str)
    words = ("word word", 999_999)
    assert got == sorted([(1, "http://x.org/1", *words), (1, "http://x.org/1", *words), (0, None, "", 0), (2, "", "no tags", 7), (3, "::", "open", 4), (4, "http://x.org/2", "<" * 9, 5000)], key=str)


# --- 9 ----------------------------------------------------------------------------------


def test_contamination(spark, docs, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").lower().split())
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if flat(i["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == want
    rest = decontaminate.clean(docs, items)
    assert rest.columns == docs.columns and {r["doc_id"] for r in rest.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}
    assert {tuple(r) for r in decontaminate.contamination(docs, items, broadcast_rows=0).collect()} == {tuple(r) for r in decontaminate.contamination(docs, items).collect()}


def test_short_and_numeric_items(spark):
    items = spark.createDataFrame(
        [(1, "What is the capital of France"), (2, "Compute 12 + 35 + 47 + 81 and then divide by 7"), (3, "Yes"), (4, ""), (5, "..."), (1, "What is the capital of France"), (6, "seven plain words stand in this one"), (6, "Name 3"), (None, "odd little item")],
        "item_id long, text string",
    )
    texts = [
        "He asked, What is the capital of\nFrance and left", "what is the CAPITAL of france", "Then: what is the capital of Spain?", "compute 12 + 35 + 47 + 81 and then divide by 7!", "compute 12 + 35 + 47 + 82 and then divide by 7",
        "compute 12 + 35 + 47 + 81 and then", "oh yes", "so seven plain words stand in this one. Name 3", "an odd little item", "yesterday", None,
    ]
    for rows in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): (r["n_hits"], r["coverage"], r["same"]) for r in decontaminate.contamination(frame(spark, texts), items, broadcast_rows=rows).collect()}
        assert got == {(0, 1): (1, 1.0, True), (1, 1): (1, 1.0, True), (2, 1): (1, 1.0, False), (3, 2): (3, 1.0, True), (6, 3): (1, 1.0, True), (7, 6): (1, 1.0, True), (8, None): (1, 1.0, True)}
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, texts), items).collect()} == {4, 5, 9, 10}


WORDS_OF_ITEM = re.compile(r"[^\W_]+")


def typed(text):
    """(word, value) for each word, value None where it isn't a placeholder."""
    low, out = text, []
    for m in WORDS_OF_ITEM.finditer(re.sub("(?<=[0-9])[.,](?=[0-9])", "d", low)):
        w, before = m[0], re.sub(r"\s+", " ", text[: m.start()])
        if re.fullmatch("[0-9][0-9d]*", w):
            out.append(("#", w))
        elif out and out[-1][0] == "#" and w.lower() in decontaminate.UNITS:
            out.append(("%", w.lower()))
        elif w[:1].isupper() and w[1:2].islower() and re.search("[a-z0-9,;] $", before):
            out.append(("@", w.lower()))
        else:
            out.append((w.lower(), None))
    return out


def contaminated_brute(texts, items, window=8, solid=5, hits=4):
    found = {}
    for i, text in texts.items():
        doc = typed(text)
        for j, item in items.items():
            own = typed(item)
            at = [k for k in range(len(own) - window + 1) if sum(v is None for _, v in own[k : k + window]) >= solid]
            best = []
            for distance in range(-len(own), len(doc)):
                pairs = {k: list(zip(own[k : k + window], doc[k + distance : k + distance + window])) for k in at if 0 <= k + distance <= len(doc) - window}
                pairs = {k: p for k, p in pairs.items() if all(a[0] == b[0] for a, b in p)}
                counterparts = defaultdict(set)
                for a, b in (x for p in pairs.values() for x in p if x[0][1] is not None):
                    counterparts[a[1]].add(b[1])
                good = [p for p in pairs.values() if all(a[1] is None or len(counterparts[a[1]]) == 1 for a, _ in p)]
                if len(good) >= min(hits, len(at)) and good:
                    best.append((len(good), all(a[1] == b[1] for p in good for a, b in p)))
            if best:
                found[i, j] = (max(n for n, _ in best), any(same for _, same in best))
    return found


def test_templates_against_brute_force(spark):
    rng = random.Random(9)
    plain = "the of trains moves towards old cities while people count their coins and walk along rivers until night falls over hills".split()
    names, units = ["Paris", "Rome", "Oslo", "Lima"], ["km", "kg", "hours"]

    def word():
        r = rng.random()
        return rng.choice(names) if r < 0.12 else str(rng.randint(1, 4)) if r < 0.22 else f"{rng.randint(1, 3)} {rng.choice(units)}" if r < 0.28 else rng.choice(plain) + rng.choice(["", "", "", ",", "."])

    items = {k: " ".join(["so", *(word() for _ in range(rng.randint(14, 26)))]) for k in range(12)}

    def again(item):
        change = {x: rng.choice(names) for x in names} | {str(x): str(rng.randint(1, 4)) for x in range(1, 5)}
        keep = rng.random() < 0.6
        return re.sub(r"\w+", lambda m: m[0] if m[0] not in change else change[m[0]] if keep else rng.choice(names if m[0] in names else ["1", "2"]), item)

    texts = {k: " ".join(filter(None, ["and", word(), rng.choice([items[k % 12], again(items[k % 12]), again(items[k % 12]), ""]), word(), word()])) for k in range(60)}
    got = {(r["doc_id"], r["item_id"]): (r["n_hits"], r["same"]) for r in decontaminate.contamination(frame(spark, list(texts.values())), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = contaminated_brute(texts, items)
    assert got == want and len(want) > 20 and {same for _, same in want.values()} == {True, False}


def test_reparameterised_questions(spark):
    question = "A train leaves and {a} is {x} km away from where {b} stands. If {a2} sends {n} cars to the far city of {b2} then what remains of {n2} in the old town hall"
    items = spark.createDataFrame([(1, question.format(a="Paris", a2="Paris", b="Berlin", b2="Berlin", x=120, n=35, n2=35)), (2, "too short"), (3, None)], "item_id long, text string")
    same = "intro here. " + question.format(a="London", a2="London", b="Madrid", b2="Madrid", x="7.5", n=12, n2=12) + ". bye"
    mixed = question.format(a="London", a2="Rome", b="Madrid", b2="Oslo", x=7, n=12, n2=14)
    texts = [same, mixed, None, "", "nothing of that kind stands in here at all, and Paris is far"]
    got = {(r["doc_id"], r["item_id"]): r["same"] for r in decontaminate.contamination(frame(spark, texts), items).collect()}
    assert got == {(0, 1): False}
    assert decontaminate.contamination(frame(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.clean(frame(spark, texts), items.limit(0)).count() == 5


# --- 10 ---------------------------------------------------------------------------------


def repeats_brute(texts, window):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words_of(texts[i])
        drop = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            drop.update(range(k, k + window)) if key in seen else seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        out[i] = (len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_repeats(spark, docs):
    rng = random.Random(8)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    passage = " ".join(f"q{x}" for x in range(60))
    texts |= {1000 + k: " ".join(f"r{rng.randint(0, 5)}" for _ in range(rng.randint(0, 90))) for k in range(40)}
    texts |= {2000 + k: f"start {k} {passage} end {k}" for k in range(40)}
    texts |= {3000: "z " * 70, 3001: "z " * 25, 3002: None, 3003: "", 3004: "a b " * 30}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    for window, gram in ((20, 5), (7, 3)):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(rows, window, gram, bits=1 << 16).collect()}
        assert got == repeats_brute(texts, window)


def test_equal_rows_leave_one_whole(spark):
    passage, other = " ".join(f"q{x}" for x in range(60)), " ".join(f"o{x}" for x in range(40))
    rows = frame(spark, [passage, passage, passage, other, other, f"{other} end", f"{other} end", passage], [1, 1, 1, None, None, 5, 5, 7]).repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(rows, bits=1 << 16).collect())
    assert got == [(0, 40, 0), (0, 40, 40), (1, 60, 0), (1, 60, 60), (1, 60, 60), (5, 41, 40), (5, 41, 41), (7, 60, 60)]


# --- odd tables -------------------------------------------------------------------------


def test_odd_rows(spark, odd, folder):
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    n = odd.count()
    assert license_scan.scan(odd).count() == n
    assert quality_rules.measure(odd).count() == n and set(quality_rules.clean(odd).columns) == set(odd.columns)
    assert toxicity.score(odd, toxicity.learn(odd, labels)).count() == n
    assert importance.select(odd, labels, share=1.0).count() == n - 3
    assert sorted({p["doc_id"] or 0 for p in packing.pack(odd).collect()}) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    found = jaccard_join.near_duplicates(odd, sketch_bits=16)
    assert found.count() == n and {r["component_id"] for r in found.filter("doc_id in (6, 7)").collect()} == {6}
    assert found.filter("doc_id is null").first()["component_id"] is None
    kept = jaccard_join.one_of_each(odd, sketch_bits=16)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 9] and kept.columns == odd.columns
    assert pii.find(odd).count() == n and pii.redact(odd).columns == odd.columns
    assert decontaminate.contamination(odd, items).count() == 0 and decontaminate.clean(odd, items).count() == n
    left = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd).collect()}
    assert (7, 60_000) in left and (None, 0) in left


def test_empty_tables(spark, odd, folder):
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    none = odd.limit(0)
    for out in (
        license_scan.scan(none), quality_rules.measure(none), quality_rules.clean(none), toxicity.score(none, toxicity.learn(none, labels)), importance.select(none, labels), packing.pack(none),
        jaccard_join.near_duplicates(none, sketch_bits=16), jaccard_join.one_of_each(none, sketch_bits=16), pii.find(none), pii.redact(none), decontaminate.contamination(none, items), decontaminate.clean(none, items), substring_dedup.remove_repeats(none),
    ):
        assert out.count() == 0
