"""Licence notices in documents, with built-in functions only.

Rules are ordered regular expressions over a text's words (A-Z in lower case, one space
between words): each licence's name in each of several kinds of notice, and sentences of
licences' texts and file headers, which are written out one by one. A rule has a
keyword and phrases, names or what its pattern has of fixed words: all its matches contain
the keyword and one of the phrases, and it is tried only on texts that do. Overlapping
detections are resolved by priority and containment: one whose words lie within those of
another of the same or a higher priority goes.

The rules are a constant table of under 1,000 rows that is broadcast. Only texts with a
keyword meet it, by the longest words of its phrases; only places of detections are
shuffled, by document, and the largest group is one document's detections.

Null texts count as empty and have no words. Rows with equal doc_id and text have equal
results, and rows that share only the doc_id are told apart by their text. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licences: label, what its name looks like in words, phrases: one of them is in each of these, with the spaces around it.
NAMES = [
    ("mit", "(?:mit|expat)(?: x11)?", " mit | expat "),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version| v)? ?1 1", "apache"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", " bsd | freebsd "),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd"),
    ("bsd", "(?:bsd|berkeley software distribution)", " bsd | berkeley software distribution "),
    ("isc", "(?:isc|internet systems consortium)", " isc | internet systems consortium "),
    ("zlib", "(?:zlib|zlib libpng)", "zlib"),
    ("boost-1", "boost software license(?: version| v)? ?1(?: 0)?", "boost software"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)(?: version| v)?(?: 2)?", " wtfpl | do what the fuck "),
    ("artistic-1", "(?:perl )?artistic license(?: version| v)? ?1(?: 0)?", "artistic"),
    ("artistic-2", "artistic license(?: version| v)? ?2(?: 0)?", "artistic"),
    ("ms-pl", "(?:ms pl|microsoft public license)", " ms pl | microsoft public license "),
    ("ms-rl", "(?:ms rl|microsoft reciprocal license)", " ms rl | microsoft reciprocal license "),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("php-3", "php license(?: version| v)? ?3(?: 01| 0)?", "php"),
    ("python-2", "(?:python software foundation|psf)(?: license)?(?: version| v)?(?: 2(?: 0)?)?", " python software foundation | psf "),
    ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"),
    ("ofl-1.1", "(?:sil )?open font license(?: version| v)?(?: 1 1)?", "open font"),
    ("odbl-1", "(?:open data commons )?open database license(?: version| v)?(?: 1 0)?", "open database"),
    ("cc0-1", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", " cc0 | creative commons zero "),
]
#: Families with versions: label, name, phrases, versions.
FAMILIES = [
    ("gpl", "(?:gnu )?(?:general public license|gpl)", " general public license | gpl ", (1, 2, 3)),
    ("lgpl", "(?:gnu )?(?:lesser general public license|library general public license|lgpl)", " lesser general public license | library general public license | lgpl ", (2, "2 1", 3)),
    ("agpl", "(?:gnu )?(?:affero general public license|agpl)", " affero general public license | agpl ", (1, 3)),
    ("gfdl", "(?:gnu )?(?:free documentation license|gfdl|fdl)", " free documentation license | gfdl | fdl ", ("1 1", "1 2", "1 3")),
    ("mpl", "(?:mozilla public license|mpl)", " mozilla public license | mpl ", ("1 0", "1 1", "2 0")),
    ("epl", "(?:eclipse public license|epl)", " eclipse public license | epl ", ("1 0", "2 0")),
    ("cddl", "(?:common development and distribution license|cddl)", " common development and distribution license | cddl ", ("1 0", "1 1")),
    ("eupl", "(?:european union public licen[cs]e|eupl)", " european union public licen| eupl ", ("1 0", "1 1", "1 2")),
    ("osl", "(?:open software license|osl)", " open software license | osl ", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "(?:academic free license|afl)", " academic free license | afl ", ("1 1", "2 0", "2 1", "3 0")),
    ("cc-by", "(?:cc by|creative commons attribution)", " cc by | creative commons attribution ", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", " cc by sa | creative commons attribution share", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", " cc by nd | creative commons attribution no", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", " cc by nc | creative commons attribution non", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", " cc by nc sa | creative commons attribution non", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", " cc by nc nd | creative commons attribution non", ("1 0", "2 0", "2 5", "3 0", "4 0")),
]
LICENCE = "(?: public)? licen[cs]e"
VERB = "licensed|released|distributed|available|provided|published|covered|redistributed?"
GRANT = f"(?:{VERB})" + "(?: only| also)? (?:under|according to|subject to)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: gnu)? "
#: Kinds of notice: what stands around a name, keyword, priority, score.
NOTICES = [
    ("spdx license identifier {name}(?: or later| only)?", "spdx license identifier", 3, 1.0),
    (GRANT + "{name}(?:" + LICENCE + ")?", "", 2, 0.9),
    ("{name}" + LICENCE, " licen", 1, 0.7),
    ("licen[cs]e {name}", "licen", 1, 0.6),
]
#: Notices without a licence's name.
PLAIN = [
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 2, 0.9),
    ("proprietary", "all rights reserved", "all rights reserved", 1, 0.5),
    ("proprietary", "(?:proprietary|commercial) licen[cs]e", " licen", 1, 0.5),
    ("permissive-text", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 2, 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source", 2, 0.9),
]


#: Sentences of licences' texts and file headers: label, pattern, keyword.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy .{0,400}to permit persons to whom the software is furnished to do so the software is provided", "permission is hereby granted"),
    ("x11", "except as contained in this notice the name of .{1,60} shall not be used in advertising or otherwise to promote the sale", "except as contained in this notice"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided", "permission to use"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted", "permission to use"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "permission to use"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must"),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of (?:its|his|their|other) contributors may be used to endorse or promote products derived from this software", "neither the name of"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following two conditions", "redistribution and use in source"),
    ("apache-2", "licensed under the apache license version 2 0(?: the license)? you may not use this (?:file|software|work) except in compliance with the license", "apache"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "licen"),
    ("apache-2", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", "licen"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name", "apache"),
    ("gpl", "this (?:program|file|software|package|script) is free software(?: you can redistribute it| and| you can)?.{0,40}under the terms of the gnu general public license", "free software"),
    ("gpl-1", "gnu general public license as published by the free software foundation either version 1", "free software"),
    ("gpl-2", "gnu general public license(?: version 2)? as published by the free software foundation (?:either )?version 2", "free software"),
    ("gpl-2", "gnu general public license version 2(?: only)? as published by the free software foundation", "free software"),
    ("gpl-3", "gnu general public license(?: version 3)? as published by the free software foundation (?:either )?version 3", "free software"),
    ("gpl", "you should have received a copy of the gnu general public license along with", "licen"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "licen"),
    ("lgpl", "this (?:library|program|file|software) is free software.{0,40}under the terms of the gnu (?:lesser|library) general public license", "free software"),
    ("lgpl-2", "gnu library general public license as published by the free software foundation either version 2", "free software"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", "free software"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3", "free software"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", "licen"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3", "free software"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with", "licen"),
    ("agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network", "your modified version must"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted"),
    ("gfdl", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", "with no invariant sections"),
    ("mpl-1", "the contents of this file are subject to the mozilla public license version 1 0", "licen"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "licen"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", "licen"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license", "licen"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1", "licen"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2", "licen"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", "licen"),
    ("cpl-1", "the accompanying program is provided under the terms of this common public license", "licen"),
    ("ipl-1", "the accompanying program is provided under the terms of this ibm public license", "licen"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "licen"),
    ("cpal-1", "the contents of this file are subject to the common public attribution license", "licen"),
    ("eupl", "you may not use this work except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at.{0,60}(?:joinup|eupl)", "licen"),
    ("osl", "licensed under the open software license version", "licen"),
    ("afl", "licensed under the academic free license version", "licen"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "this software is provided"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented"),
    ("libpng", "the contributing authors and group 42 inc disclaim all warranties", "the contributing authors"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("wtfpl", "you just do what the fuck you want to", "what the fuck"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain this notice"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain", "public domain"),
    ("cc0-1", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights", "neighboring rights"),
    ("cc-by", "you are free to share.{0,120}adapt.{0,200}you must give appropriate credit provide a link to the license and indicate if changes were made", "licen"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "transform or build upon"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "transform or build upon"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "for commercial purposes"),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", "the intent of this document"),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package", "licen"),
    ("python-2", "psf is making python available to licensee on an as is basis", "licen"),
    ("python-2", "this license agreement is between the python software foundation", "licen"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", "this product includes cryptographic software written by eric young", "this product includes"),
    ("php-3", "this product includes php software freely available from", "php"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim copies"),
    ("vim", "vim is charityware", "vim"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "open font"),
    ("ofl-1.1", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", "the font software may"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "licen"),
    ("sspl-1", "server side public license version 1", "server side public"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licen"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("commons-clause", "the license does not grant to you the right to sell the software", "licen"),
    ("json", "the software shall be used for good not evil", "not evil"),
    ("ecl-2", "educational community license version 2", "educational community"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "redistributions of source code must"),
    ("upl-1", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsl-patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants", "licen"),
    ("proprietary", "(?:this (?:software|document|file) is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", "(?:no part of this (?:publication|work|book|document)) may be reproduced", "may be reproduced"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|work|document)", " unauthori"),
    ("public-domain", "this (?:work|file|software|document|code|image) is in the public domain", "public domain"),
    ("public-domain", "the authors? (?:hereby )?disclaims? copyright to this source code", "copyright to this source code"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    score: float
    phrases: tuple[str, ...]


def _fixed(pattern: str, keyword: str) -> tuple[str]:
    """The longest stretch of a pattern that has no group, class or repeat, or its keyword."""
    whole = None
    while whole != pattern:
        whole, pattern = pattern, re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]|\.\{[^}]*\}|[\w ]\?", "\n", pattern)
    return (max(keyword, *pattern.split("\n"), key=len),)


def rules() -> list[Rule]:
    """All rules in their order."""
    named = [(label, name, tuple(phrases.split("|"))) for label, name, phrases in NAMES]
    for label, name, phrases, versions in FAMILIES:
        phrases = tuple(phrases.split("|"))
        named.append((label, name, phrases))
        for v in versions:
            version = f"(?:v|version |v )?{v}" if " " in str(v) else f"(?:v|version |v )?{v}(?: 0)?"
            major = str(v).replace(" ", ".").removesuffix(".0")
            named.append((f"{label}-{major}" if not label.startswith("cc") else label, f"{name} {version}", phrases))
    out = []
    for label, name, phrases in named:
        for around, gate, priority, score in NOTICES:
            out.append(Rule(label, around.replace("{name}", name), gate, priority, score, phrases))
    # short names of their own: three words that hardly stand by chance
    out += [Rule(label, name, "cc by n", 1, 0.6, phrases) for label, name, phrases in named if label.startswith("cc-by") and "cc by n" in name]
    out += [Rule(label, pattern, keyword, 2, 0.9, _fixed(pattern, keyword)) for label, pattern, keyword in TEXTS]
    return out + [Rule(*x, _fixed(x[1], x[2])) for x in PLAIN]


def _spaced(text: Column) -> Column:
    """The words of a text, each between single spaces. Other letters than A-Z may be
    changed too, but to none that a rule has, and words stay words."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(words: Column) -> Column:
    """(count, first, last, label) for each base phrase that stands in the words."""
    found = []
    for phrase, label in BASE.items():
        own = F.lit(f" {phrase} ")
        twice, wide = F.replace(words, F.lit(" "), F.lit("  ")), F.lit(f" {phrase.replace(' ', '  ')} ")
        found.append(
            F.when(
                F.contains(words, own),
                F.struct(
                    F.round((F.length(twice) - F.length(F.replace(twice, wide, F.lit("")))) / F.length(wide)).cast("long").alias("n"),
                    _spaces(F.substring_index(words, f" {phrase} ", 1)).cast("long").alias("first"),
                    (_spaces(words) - 1 - len(phrase.split()) - _spaces(F.substring_index(words, f" {phrase} ", -1))).cast("long").alias("last"),
                    F.lit(label).alias("label"),
                ),
            )
        )
    return F.array_compact(F.array(*found))


def _starts(phrases: set[str]) -> str:
    """A pattern for the start of a word where one of the phrases stands. It goes by first
    letters, and from one space to the next, since alternatives are tried one after the other."""
    by: dict[str, list[str]] = {}
    for p in sorted(phrases):
        by.setdefault(p[0], []).append(p[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def _shortest(phrases: set[str]) -> set[str]:
    """Those that don't begin with another one."""
    return {p for p in phrases if not any(p.startswith(o) for o in phrases - {p})}


def gate() -> str:
    """A pattern that stands in the words of each text with a match of a rule, and in few others.
    Grants have no keyword; their verbs stand for them."""
    keywords = _shortest({r.keyword.strip() for r in rules()} - {""})
    return _starts(keywords | {f"{verb}(?: only| also)? (?:under|according to|subject to) " for verb in VERB.split("|")})


def heads() -> dict[str, str]:
    """For each phrase of a rule how its longest word begins. No such beginning begins another.
    What stands first in a phrase may be the end of a word, and counts if there is no other."""
    longest = {p: max(re.findall("(?<= )[^ ]+", p) or p.split(), key=len) for r in rules() for p in r.phrases}
    short = _shortest(set(longest.values()))
    return {p: next(h for h in short if w.startswith(h)) for p, w in longest.items()}


def tried(docs: DataFrame) -> DataFrame:
    """The rules that are tried on each text, one as often as it has phrases there: id, copy, words, and the rule's columns."""
    head = heads()
    table = docs.sparkSession.createDataFrame(
        [(head[p], p, i, r.label, f"(?<= )(?:{r.pattern})(?= )", r.keyword, r.priority, r.score) for i, r in enumerate(rules()) for p in r.phrases],
        "head string, phrase string, rule int, label string, pattern string, keyword string, priority int, score double",
    )
    # as an array's element the words of a text are worked out once. Short names may also be
    # written out where `cc by n` stands inside a longer word
    words = F.filter(F.array(_spaced(F.col("text"))), lambda w: w.rlike(gate()) | F.contains(w, F.lit("cc by n")))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("copy"), F.explode(words).alias("words"))
    found = F.array_distinct(F.regexp_extract_all("words", F.lit(_starts(set(head.values()))), F.lit(0)))
    pairs = texts.withColumn("head", F.explode(found)).withColumn("head", F.ltrim("head")).join(F.broadcast(table), "head")
    return pairs.filter(F.contains("words", F.col("phrase")) & F.contains("words", F.col("keyword"))).drop("head", "phrase", "keyword")


def detections(docs: DataFrame) -> DataFrame:
    """Detections that aren't contained in others: id, copy (a hash of the text), label,
    first and end (words from 0), priority, score."""
    found = (
        tried(docs)
        .withColumn("hits", F.regexp_extract_all("words", F.col("pattern"), F.lit(0)))
        .filter(F.size("hits") > 0)
        .withColumn("around", F.split("words", F.col("pattern"), -1))
        .select("id", "copy", "rule", "label", "priority", "score", F.posexplode(F.arrays_zip(F.col("hits").alias("hit"), F.slice("around", 1, F.size("hits")).alias("before"))).alias("at", "x"))
        .select("id", "copy", "rule", "label", "priority", "score", "at", _spaces(F.col("x.before")).alias("before"), (_spaces(F.col("x.hit")) + 1).alias("long"), (_spaces(F.col("x.hit")) + _spaces(F.col("x.before"))).alias("step"))
        .distinct()
    )
    # words before a match: those between and inside the earlier matches of its rule
    passed = Window.partitionBy("id", "copy", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.repartition("id", "copy").withColumn("through", F.sum("step").over(passed))
    placed = placed.withColumn("first", F.col("through") - F.col("long")).withColumn("end", F.col("through"))
    before = Window.partitionBy("id", "copy").orderBy("first", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    for p in (1, 2, 3):
        placed = placed.withColumn(f"_{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before))
    covered = F.coalesce(F.element_at(F.array("_1", "_2", "_3"), F.col("priority")) >= F.col("end"), F.lit(False))
    return placed.filter(~covered).select("id", "copy", "label", "first", "end", "priority", "score")


def scan(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    by_doc = detections(docs).groupBy("id", "copy").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_copy"), _spaced(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "_copy", (F.greatest(_spaces(F.col("words")) - 1, F.lit(0)) - F.when(F.col("words") == "  ", 1).otherwise(0)).cast("long").alias("n_words"), _base(F.col("words")).alias("base"))
    rows = rows.join(by_doc, (rows["doc_id"].eqNullSafe(by_doc["id"])) & (rows["_copy"] == by_doc["copy"]), "left")
    base = F.col("base")
    labels = F.array_sort(F.array_distinct(base["label"]))
    both = F.array_sort(F.array_union(labels, F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_base"),
        F.array_min(base["first"]).alias("first_word"),
        F.array_max(base["last"]).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(base) > 0, 0.9).otherwise(0.0)).alias("score"),
    )
