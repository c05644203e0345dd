"""Operators 2, 4 and 10 against plain Python versions of their definitions, and operator 4's held-out accuracy."""

import collections
import math
import random
import re
import unicodedata

import pytest

from corridora.llm import decontaminate, langid, licenses, queries

SF = "/root/testdata/sf0.01"


def plain_tokens(text):
    """(word, whether a sentence ends before it)."""
    ascii_gaps = "".join(re.escape(chr(c)) for c in range(128) if not chr(c).isalpha())
    word = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[^{ascii_gaps} «» -⁯　-〿]+")
    return [(m[0], text[: m.start()].rstrip("\"')] \t\n\r")[-1:] in list(".!?")) for m in word.finditer(text)]


def plain_template(toks):
    out = []
    for i, (w, ends) in enumerate(toks):
        if w[0] in "0123456789":
            out.append("#n")
        elif i and not ends and w[0] != w[0].lower() and w[1:2] and w[1] == w[1].lower():
            out.append("#w")
        elif i and w.lower() in decontaminate.UNITS and toks[i - 1][0][0] in "0123456789":
            out.append("#u")
        else:
            out.append(w.lower())
    return out


def plain_leaks(docs, bench):
    """(doc, text, item, matched windows, windows of the item)."""
    items = collections.defaultdict(set)
    for i, t in bench:
        if t is not None:
            items[t].add(i)
    out = set()
    for item_text, ids in items.items():
        it = plain_tokens(item_text)
        if not it:
            continue
        im, size = plain_template(it), min(8, len(it))
        starts = range(len(im) - size + 1)
        literals = [sum(x[0] != "#" for x in im[p : p + size]) for p in starts]
        plain = max(literals) < 2
        telling = {p for p in starts if literals[p] >= min(5, size)}
        own = [x[0].lower() for x in it] if plain else im
        first = it[0][0]
        named = ["#w", *im[1:]] if not plain and first[0] != first[0].lower() and first[1:2] and first[1] == first[1].lower() else None
        for d, t in docs:
            dt = plain_tokens(t or "")
            dm = [x[0].lower() for x in dt] if plain else plain_template(dt)
            at = collections.defaultdict(set)
            for p in range(len(dm) - size + 1):
                for q in starts:
                    if dm[p : p + size] == own[q : q + size] or (q == 0 and named and dm[p : p + size] == named[:size]):
                        at[p - q].add(q)
            good = set()
            for shift, found in at.items():
                for some in (found, found & telling):
                    slots = collections.defaultdict(set)
                    for k in {q + j for q in some for j in range(size)}:
                        if im[k][0] == "#":
                            slots[im[k], it[k][0].lower()].add(dt[k + shift][0].lower())
                    if all(len(s) == 1 for s in slots.values()):
                        good |= some
                        break
            if len(good) == len(starts) or (not plain and telling and len(good & telling) >= min(3, len(telling))):
                out |= {(d, t, i, len(good), len(starts)) for i in ids}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    common = "the old bridge carried copper over a river while many people sold bread and paid for their boats again".split()

    def item():
        out = []
        for i in range(rng.choice([2, 3, 5, 6, 7, 9, 12, 40])):
            kind = rng.random()
            out.append(rng.choice("{A} {B}".split()) if kind < 0.12 else rng.choice(["{1} {u}", "{2}", "{1}"]) if kind < 0.25 else rng.choice(common) + rng.choice(["", "", "", ",", ". The", "? \"", "!"]))
        return " ".join(out)

    def fill(t, steady=True):
        pick = lambda k: rng.choice({"A": ["Alice", "Bertha"], "B": ["Claude", "Émile", "NATO"], "1": ["40", "3.5", "1,000"], "2": ["7", "1998"], "u": ["kg", "KM", "dollars"]}[k])
        fixed = {k: pick(k) for k in "AB12u"}
        return re.sub(r"\{(.)\}", lambda m: fixed[m[1]] if steady else pick(m[1]), t)

    shapes = [item() for _ in range(12)]
    bench = [(i, fill(s)) for i, s in enumerate(shapes)] + [(50, None), (51, ""), (52, "too short")]
    bench += [(60, bench[3][1]), (61, " ".join(["again and"] * 10)), (62, "7 40 3.5 1998 7 7 40 1998 1,000 7"), (63, "What is 12 + 35?"), (64, "In 1998 Alice sold 40 kg and Bertha sold 30 kg"), (65, "7 40")]
    docs = [(i, " ".join(rng.choice([" ".join(rng.choices(common, k=9)), fill(rng.choice(shapes), rng.random() < 0.6), fill(rng.choice(shapes))[rng.randint(0, 40) :]]) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    docs += [(70, "so 7 40 3.5 1998 7 7 40 1998 1,000 7 it was"), (71, "so 7 40 3.5 1998 7 7 41 1998 1,000 7 it was"), (72, "they ask What is 7 + 9? and"), (73, "in 2003 Claude sold 5 kg and Émile sold 6 kg"), (74, "In 2003 Claude sold 5 kg and Alice sold 6 lb")]
    docs += [docs[5], (5, "another text under this id"), (90, None), (91, ""), (92, "again and " * 30)]
    want = plain_leaks(docs, bench)
    got = decontaminate.find_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()
    # equal rows give one row per item; a doc_id with two texts is judged by each
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.item_windows) for r in got) == sorted((d, i, n, m) for d, _, i, n, m in want)
    assert {(70, 62), (72, 63), (73, 64)} <= {(d, i) for d, _, i, _, _ in want} and not {(71, 62), (74, 64)} & {(d, i) for d, _, i, _, _ in want}
    assert len(want) > 20 and all(math.isclose(r.coverage, r.n_windows / r.item_windows) for r in got)


def plain_grams(text):
    m = (1 << 64) - 1
    code = []
    for ch in text:
        low = ch.lower()
        code.append(0 if unicodedata.category(ch)[0] != "L" else ord(low) if len(low) == 1 else ord(ch))
    for i in range(len(code)):
        h = 0
        for j in range(3):
            if i + j < len(code):
                h = (h * 0x9E3779B97F4A7C15 + code[i + j] + j + 1) & m
                if any(code[i : i + j + 1]):
                    x = (h * 0xD6E8FEB86659FD93) & m
                    yield ((((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m) >> 40) % langid.BUCKETS


def test_naive_bayes_equals_brute_force(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdeé ", "bb": "cdefgÄ 1", "cc": "ефгъ й.", "dd": "漢字 abİ"}
    write = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    taught = [(i, write(lang, rng.randint(0, 60)), lang) for i, lang in enumerate(rng.choices(list(letters), [5, 3, 1, 1], k=60))] + [(70, None, "aa"), (71, "xyz", None), (72, "", "bb")]
    probe = [(i, write(rng.choice(list(letters)), rng.randint(1, 12))) for i in range(60)] + [(80, "12 . %"), (81, None), (82, ""), (83, "zzz")]
    count, rows = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in taught:
        if lang:
            rows[lang] += 1
            count[lang].update(plain_grams(t or ""))
    want = {}
    for d, t in probe:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            want[d] = ("und", 0.0)
            continue
        g = list(plain_grams(t))
        like = {k: math.log(rows[k] / sum(rows.values())) + sum(math.log((count[k][b] + langid.ALPHA) / (sum(count[k].values()) + langid.ALPHA * langid.BUCKETS)) for b in g) for k in sorted(rows)}
        best = max(like, key=like.get)
        want[d] = (best, 1 / sum(math.exp(v - like[best]) for v in like.values()))
    model = langid.train(spark, spark.createDataFrame(taught, "doc_id long, text string, lang string").repartition(4), "text", "lang")
    got = {r.doc_id: r for r in langid.predict(spark, spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert {d: r.lang_pred for d, r in got.items()} == {d: p for d, (p, _) in want.items()}
    assert all(math.isclose(got[d].score, s, abs_tol=1e-9) for d, (_, s) in want.items())


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_naive_bayes_langid(spark, SF).collect()
    assert len(got) == len(truth)
    held = [(r.lang_pred, truth[r.doc_id].lang) for r in got if r.held_out and truth[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_base_phrases_equal_brute_force(spark):
    rng = random.Random(9)
    phrases = {tuple(p.split()): label for p, label in licenses.BASE}
    vocabulary = ["gnu", "general", "public", "license", "Apache", "CC", "by", "MIT", "License", "x", "é", "licensé", "İ", "GNU General Public License", "mit license", "cc by", "apache LICENSE", "cc0"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "-", "\n", "_", ".", "\x00", "", "\t"]) for _ in range(rng.choice([0, 1, 3, 12, 60])))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " ."), (403, "cc by " * 3000), (403, "cc by " * 3000), (None, "mit license")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))

    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((d, *plain(t)) for d, t in rows), key=key)
    for r in got:
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_labels_equal_brute_force(spark):
    """Own labels and score: all matches of all signatures, without those inside another that is longer, or first in the list."""
    rng = random.Random(13)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    signs = [(i, label, re.compile(f" {regex}(?= )"), key) for i, label, regex, key in licenses.signatures()]
    phrases = ["MIT License", "GNU General Public License", "version 3", "v2 or later", "Apache License, Version 2.0", "CC BY-SA 4.0", "CC by", "Creative Commons Attribution 3.0", "all rights reserved", "Copyright 2019 Acme Corp. All rights reserved", "the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification", "Permission is hereby granted, free of charge, to any person obtaining a copy", "WTFPL", "SPDX-License-Identifier: MIT", "public domain", "released into the public domain", "mit", "licensed under the Apache License", "LGPL 2.1", "Mozilla Public License 2.0", "some rights reserved", "classpath exception", "the terms", "é", "license"]
    rows = [(i, "".join(rng.choice(phrases) + rng.choice([" ", ", ", "\n", ". ", "; "]) for _ in range(rng.choice([0, 1, 2, 5, 25])))) for i in range(250)] + [(900, None), (901, "plain words alone")]

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n = " " + " ".join(words) + " "
        base = {label for p, label in licenses.BASE if f" {p} " in n}
        spans = sorted((m.start(), -m.end(), i, label) for i, label, rx, key in signs if key in n for m in rx.finditer(n))
        kept = [x for x in spans if not any(y is not x and y[0] <= x[0] and -y[1] >= -x[1] and ((y[0], y[1]) != (x[0], x[1]) or y[2] < x[2]) for y in spans)]
        covered = {k for a, b, *_ in kept for k in range(a, -b)}
        return ",".join(sorted(base | {x[3] for x in kept})), round(len(covered) / len(n), 9) if words else 0.0

    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {d: plain(t) for d, t in rows}
    assert {r.doc_id: (r.labels, round(r.score, 9)) for r in got} == want
    assert len({x for v, _ in want.values() for x in v.split(",")}) > 15
