"""License scan: ordered signature rules, in DataFrame functions only.

A text's words stand in one string, one space apart. Each signature is a regular expression over that string, gated by
a keyword: only texts that hold a keyword at all are scanned, and only signatures whose own keyword is there run. All
matches are intervals; an interval inside another that is longer, or equal and of higher priority, is suppressed; the
labels of what is left are reported. Base phrases keep their labels in any case.

Nulls and edge cases: a null text is an empty one, with no words, empty labels and score 0; repeated rows give repeated
results; of equal intervals that of the signature listed first stays; a very long text is scanned whole, as one row's
work; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All of ASCII but letters and digits, character by character: Java looks single characters up in one table, but tries
#: ranges in turn, which took six times as long. A-Z belong to words here, as they are lower-cased where it matters.
NOT_WORD = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{NOT_WORD}]+"

#: Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: License families as (label, names, versions).
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1", "3"]),
    ("fdl", ["gnu free documentation license", "gnu fdl"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache license", "apache software license"], ["1 0", "1 1", "2 0"]),
    ("mpl", ["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license", "epl"], ["1 0", "2 0"]),
    ("eupl", ["european union public licence", "eupl"], ["1 0", "1 1", "1 2"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["1 0"]),
    ("artistic", ["artistic license", "perl artistic license"], ["1 0", "2 0"]),
    ("afl", ["academic free license"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("osl", ["open software license"], ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("lppl", ["latex project public license", "lppl"], ["1 0", "1 2", "1 3", "1 3a", "1 3c"]),
    ("odbl", ["open database license", "odbl"], ["1 0"]),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("bsl", ["boost software license", "business source license"], ["1 0", "1 1"]),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["1", "2"]),
    ("python", ["python software foundation license", "psf license"], ["2"]),
    ("unlicense", ["the unlicense", "this is free and unencumbered software released into the public domain"], []),
    ("mit", ["mit license", "expat license", "x11 license"], []),
    ("isc", ["isc license"], []),
    ("bsd", ["bsd license", "new bsd license", "simplified bsd license", "modified bsd license"], []),
    ("bsd-2", ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause"], []),
    ("bsd-3", ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"], []),
    ("bsd-4", ["bsd 4 clause license", "4 clause bsd license", "bsd 4 clause"], []),
    ("proprietary", ["all rights reserved", "proprietary and confidential", "unauthorized copying of this file"], []),
]

#: Creative Commons terms, short and long, and versions.
CC_TERMS = [("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Grants, notices, conditions and exceptions as (label, regex over words, keyword).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice shall"),
    ("mit", "to deal in the software without restriction", "without restriction"),
    ("mit", "(?:is )?(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?mit(?: license)?", "mit"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose", "permission to use"),
    ("isc", "with or without fee is hereby granted", "without fee"),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification)?", "redistribution and use"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-3", "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors", "neither the name"),
    ("bsd-3", "may be used to endorse or promote products derived from this software", "endorse or promote"),
    ("bsd-4", "all advertising materials mentioning features or use of this software", "advertising materials"),
    ("bsd", "governed by a bsd style license", "bsd style"),
    ("gpl", "this program is free software you can redistribute it", "this program is free"),
    ("gpl", "gnu general public license as published by the free software foundation", "free software foundation"),
    ("gpl", "either version (?:[23]|1 0) of the license or (?:at your option )?any later version", "later version"),
    ("gpl", "you should have received a copy of the gnu general public license", "should have received"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty of merchantability"),
    ("gpl-exception", "linking this (?:library|program) statically or dynamically with other modules", "statically or dynamically"),
    ("gpl-exception", "as a special exception (?:[^ ]+ ){0,12}(?:link|compile|distribute)", "special exception"),
    ("gpl-exception", "classpath exception", "classpath exception"),
    ("gpl-exception", "gcc runtime library exception", "runtime library exception"),
    ("lgpl", "this library is free software you can redistribute it", "this library is free"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "should have received"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "should have received"),
    ("agpl", "remote network interaction", "remote network"),
    ("fdl", "permission is granted to copy distribute and or modify this document", "modify this document"),
    ("fdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("apache", "licensed under the apache license", "apache"),
    ("apache", "licensed to the apache software foundation", "apache"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance"),
    ("apache", "unless required by applicable law or agreed to in writing software", "agreed to in writing"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind", "as is basis"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file", "copy of the mpl"),
    ("mpl", "the contents of this file are subject to the mozilla public license", "contents of this file"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("artistic", "you may distribute under the terms of either the gnu general public license or the artistic license", "artistic"),
    ("perl", "under the same terms as perl itself", "perl itself"),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is"),
    ("zlib", "altered source versions must be plainly marked as such", "plainly marked"),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy", "person or organization"),
    ("bsl", "the change date (?:[^ ]+ ){0,6}the change license", "change license"),
    ("ofl", "this font software is licensed under the sil open font license", "font software"),
    ("ofl", "reserved font name", "reserved font name"),
    ("odbl", "this database is made available under the open database license", "open database"),
    ("python", "this license agreement is between the python software foundation", "python software foundation"),
    ("openssl", "this product includes software developed by the openssl project", "openssl project"),
    ("x11", "except as contained in this notice the name of (?:[^ ]+ ){1,8}shall not be used in advertising", "contained in this notice"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", "its documentation"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa"),
    ("json", "the software shall be used for good not evil", "not evil"),
    ("beerware", "beer ware license", "beer ware"),
    ("beerware", "you can buy me a beer in return", "buy me a beer"),
    ("vim", "vim license", "vim license"),
    ("postgresql", "postgresql licen[cs]e", "postgresql licen"),
    ("ms-pl", "microsoft public license", "microsoft public"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal"),
    ("sspl", "server side public license", "server side public"),
    ("elastic", "elastic license(?: v?2(?: 0)?)?", "elastic license"),
    ("commons-clause", "commons clause(?: license condition)?", "commons clause"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform"),
    ("cecill", "cecill(?: [abc])? (?:free software )?license", "cecill"),
    ("mulan", "mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?", "mulan"),
    ("nolicense", "no license (?:is )?(?:granted|given|specified)", "no license"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", "this work is (?:in|free of known copyright restrictions and in) the public domain", "public domain"),
    ("public-domain", "the author disclaims copyright to this source code", "disclaims copyright"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc0", "creative commons zero", "creative commons zero"),
    ("cc0", "waived all copyright and related or neighboring rights", "neighboring rights"),
    ("cc", "some rights reserved", "some rights reserved"),
    ("cc", "this work is licensed under a creative commons", "creative commons"),
    ("spdx", "spdx license identifier [^ ]+", "spdx"),
    ("noncommercial", "for non commercial (?:use|purposes) only", "non commercial"),
    ("noncommercial", "not for commercial use", "commercial use"),
    ("evaluation", "for evaluation (?:use|purposes) only", "for evaluation"),
    ("proprietary", "copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})? [^ ]+(?: [^ ]+)? all rights reserved", "all rights reserved"),
    ("proprietary", "this software is the confidential and proprietary information of", "confidential and proprietary"),
    ("proprietary", "no part of this (?:publication|work|document|book) may be reproduced", "may be reproduced"),
    ("proprietary", "end user license agreement", "end user license"),
    ("proprietary", "reverse engineer(?:ing)? decompil(?:e|ation) or disassembl(?:e|y)", "reverse engineer"),
    ("proprietary", "licensed not sold", "licensed not sold"),
]


def signatures() -> list[tuple[int, str, str, str]]:
    """(priority, label, regex over words, keyword), most specific first: notices, versioned names, Creative Commons, names."""
    out = [*NOTICES]
    for label, names, versions in FAMILIES:
        for v in versions:
            short = v.removesuffix(" 0")
            number = f"v?{short}(?: 0)?" if short != v or " " not in v else f"v?{v}"
            out += [(f"{label}-{v.replace(' ', '.')}", f"{n}(?: version)? {number}(?: only| or later| or any later version)?", n) for n in names]
    for short, long in CC_TERMS:
        label = "cc-" + short.replace(" ", "-")
        for v in CC_VERSIONS:
            out += [(f"{label}-{v.replace(' ', '.')}", f"{who} {t} (?:license )?{v}", f"{who} {t}") for who in ("cc", "creative commons") for t in (short, long)]
        out += [(label, f"cc {short}(?: license)?", f"cc {short}"), (label, f"creative commons {long}(?: license)?", long)]
    out += [(label, n, n) for label, names, _ in FAMILIES for n in names]
    return [(i, label, regex, key) for i, (label, regex, key) in enumerate(out)]


#: Words of signatures that other texts use as well, so that they are no sign of a license.
COMMON = "above accompanying all an and can any are as author basis be beer between binary book business buy by charge code collection common commercial condition conditions contained contents copies copy date deal developed development distribute distributed document documentation either end engineer european except express features fee file findings following font for form forms found foundation founded free from front general granted have in included institute is it its library limited made mark marked materials may me mentioning modify must name names network new no not of on only open or organization origin other part person perl plainly product program project promote provided public publication published purpose received released reproduce reproduced research return reverse rights sections server shall should side small software sold source special statically strict style subject text the this to tool under university use used user version versions will with without work you your".split()


def required_words(regex: str) -> set[str]:
    """Words that stand in every match of a signature: those outside its groups."""
    while (flat := re.sub(r"\(\?:[^()]*\)\??", " ", regex)) != regex:
        regex = flat
    words = re.findall(r"(?<![\w?])[a-z0-9]+(?![\w?])", re.sub(r"\[[^\]]*\][+{0-9}]*", " ", regex))
    return {w for w in words if len(w) > 1 and not w.isdigit()}


@cache
def gate_words() -> list[str]:
    """Words of which any text that some signature or base phrase matches holds one, for the first look at a text.

    Each time the word is taken that the most signatures still without one require, of those that are no common words.
    """
    left = [required_words(regex) for *_, regex, _ in signatures()] + [set(p.split()) for p, _ in BASE]
    out: list[str] = []
    while left:
        count = Counter(w for words in left for w in (words - set(COMMON) or words))
        best = min(count, key=lambda w: (-count[w], -len(w), w))
        out.append(best)
        left = [words for words in left if not any(best in w for w in words)]
    return out


def by_keyword() -> dict[str, list[tuple[int, str, str, str]]]:
    """The signatures by that word of their keyword which the fewest keywords hold, so that a text meets few of them."""
    count = Counter(w for *_, key in signatures() for w in set(key.split()))
    out: dict[str, list] = {}
    for x in signatures():
        out.setdefault(min(x[3].split(), key=lambda w: (count[w], -len(w), w)), []).append(x)
    return out


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score); score is the share of the text's characters inside detections."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    # lower() is a superset of the ASCII lower case, for the gate alone; a step of its own has it made once a text
    gate = F.lit(False)
    for w in gate_words():  # one word each, as words may be far apart in the text, by any non-word characters
        gate = gate | F.col("_low").contains(w)
    pieces = F.regexp_extract_all(F.col("_t"), F.lit(WORD), F.lit(0))
    asc = F.translate(F.array_join(pieces, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = docs.select(F.col(key), t.alias("_t"), F.lower(t).alias("_low")).select(key, "_t", gate.alias("_gate"))
    d = d.select(key, F.regexp_count(F.col("_t"), F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("_gate"), F.concat(F.lit(" "), asc, F.lit(" "))).alias("_n"))

    base = []
    for phrase, label in BASE:
        cut = F.split(F.col("_n"), f" {phrase}(?= )", -1)
        size = len(phrase.split())
        base.append(F.when(F.col("_n").contains(f" {phrase} "), F.struct((F.size(cut) - 1).cast("long").alias("n"), _spaces(cut[0]).cast("long").alias("a"), (F.col("n_words") - (_spaces(F.element_at(cut, -1)) - 1) - size).cast("long").alias("z"), F.lit(label).alias("l"))))
    d = d.withColumn("_b", F.when(F.col("_n").isNotNull(), F.array_compact(F.array(*base))))

    rule = lambda i, label, regex, k: F.struct(F.lit(i).alias("p"), F.lit(label).alias("l"), F.lit(f" {regex}(?= )").alias("r"), F.lit(k).alias("k"))
    groups = F.array(*[F.struct(F.lit(word).alias("w"), F.array(*[rule(*x) for x in rules]).alias("rules")) for word, rules in by_keyword().items()])

    def spans(rule: Column) -> Column:
        """Intervals of one rule, as (start, -end, priority, label): pieces between matches and the matches, in turn."""
        n = F.col("_n")
        hits = F.regexp_extract_all(n, rule["r"], F.lit(0))
        gaps = F.split(n, rule["r"], -1)
        both = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,p:int,l:string>>").alias("out"))
        def step(acc, x):
            begin = acc["at"] + F.length(x["g"])
            end = begin + F.length(x["h"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), (-end).alias("e"), rule["p"].alias("p"), rule["l"].alias("l")))).alias("out"))
        return F.aggregate(both, zero, step, lambda acc: acc["out"])

    near = F.flatten(F.transform(F.filter(groups, lambda g: F.col("_n").contains(g["w"])), lambda g: g["rules"]))
    found = F.array_sort(F.flatten(F.transform(F.filter(near, lambda r: F.col("_n").contains(r["k"])), spans)))
    # in this order an interval lies inside an earlier one exactly if it ends no later than the farthest end so far
    start = F.struct(F.lit(0).alias("far"), F.lit(0).alias("cover"), F.array().cast("array<string>").alias("labels"))
    def sweep(acc, x):
        end = -x["e"]
        kept = F.struct(end.alias("far"), (acc["cover"] + end - F.greatest(acc["far"], x["s"])).alias("cover"), F.array_union(acc["labels"], F.array(x["l"])).alias("labels"))
        return F.when(end > acc["far"], kept).otherwise(acc)
    d = d.withColumn("_k", F.when(F.col("_n").isNotNull(), F.aggregate(found, start, sweep)))
    own = F.array_sort(F.array_distinct(F.transform(F.col("_b"), lambda x: x["l"])))
    return d.select(
        key, "n_words",
        F.coalesce(F.aggregate("_b", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_b", lambda x: x["a"])).alias("first_word"),
        F.array_max(F.transform("_b", lambda x: x["z"])).alias("last_word"),
        F.coalesce(F.array_join(own, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(own, F.col("_k")["labels"])), ","), F.lit("")).alias("labels"),
        F.coalesce(F.col("_k")["cover"] / F.greatest(F.length("_n"), F.lit(1)), F.lit(0.0)).cast("double").alias("score"),
    )
