import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from corridora.llm import ann, decontaminate, gru_lm, langid, licenses, minhash_dedup, packing, sharding, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in rows], DOCS).repartition(parts)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "é" * 300), (None, "one two three four five six"), (None, None)]


def plain_suffix_dedup(rows):
    seen, want = set(), {}
    for d, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("limits", [{}, {"MANY": 3}, {"MANY": 1, "ARRAY_BYTES": 600}, {"MANY": 1, "ARRAY_BYTES": 600, "PIECE_BYTES": 3000, "STEP": 2}])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, limits):
    """Also with limits that make every contested minimiser hot; the tasks are run here, as workers keep their own limits."""
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rng = random.Random(1)
    shared = [prose(rng, 40) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([prose(rng, 12), rng.choice(shared)[rng.choice([0, 7]) :]]) for _ in range(rng.randint(0, 4)))) for i in range(50)]
    rows += [(i, prose(rng, rng.randint(0, 6)) + shared[0][: rng.choice([99, 100, 103, 160])] + prose(rng, rng.randint(0, 6))) for i in range(100, 160)]
    rows += [(60, "ab" * 2000), (61, "a" * 3000), (62, rows[3][1]), (62, rows[3][1]), *[r for r in ODD if r[0] is not None]]
    if limits:
        import pyarrow as pa

        n, both, spans = 5, list(rows), collections.defaultdict(list)
        rng.shuffle(both)
        doc = lambda part: pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in part], pa.int64()), "text": pa.array([t and t.encode() for _, t in part], pa.binary())})

        def dealt(tasks):
            for p in range(n):
                yield [b.slice(i, 1) for t in tasks for b in t for i, q in enumerate(b.column(0).to_pylist()) if q == p]

        out = [list(suffix_dedup._settled(iter(part), 100)) for part in dealt([list(suffix_dedup._scan(100, n)(iter([doc(both[k::3])]))) for k in range(3)])]
        flat = [r for part in out for b in part for r in b.to_pylist()]
        todo = collections.defaultdict(list)
        for r in flat:
            (todo if r["todo"] else spans)[r["doc_id"]].append({k: r[k] for k in ("s", "e", "m", "hot")})
        assert any(x["hot"] for v in todo.values() for x in v)
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("m", pa.int64()), ("hot", pa.bool_())]))
        work = [[(d, t) for d, t in both[k::2] if d in todo] for k in range(2)]
        cut = [list(suffix_dedup._cut_out(100, n)(iter([doc(w).append_column("todo", pa.array([todo[d] for d, _ in w], kind))]))) for w in work]
        for part in dealt(cut):
            for b in suffix_dedup._groups(100)(iter(part)):
                for r in b.to_pylist():
                    spans[r["doc_id"]].append(r)
        got = {}
        for d, t in rows:
            b, gone = (t or "").encode(), set()
            for r in spans[d]:
                gone |= set(range(r["s"], min(r["e"], len(b))))
            kept = bytes(x for i, x in enumerate(b) if i not in gone)
            got[d] = (len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest())
        assert got == plain_suffix_dedup(rows)
        return
    got = suffix_dedup.dedup_substrings(spark, frame(spark, [*rows, (None, "kept " * 60)])).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == plain_suffix_dedup(rows)
    assert len(got) == len(rows) + 1


def test_suffix_dedup_of_a_passage_in_many_documents(spark):
    """A passage that a third of 1500 documents share, and many near copies of one document."""
    rng = random.Random(21)
    passage, base = prose(rng, 30), prose(rng, 60).split()
    rows = [(i, prose(rng, rng.randint(1, 12)) + " " + passage + " " + prose(rng, rng.randint(1, 12)) if i % 3 == 0 else prose(rng, 20)) for i in range(1500)]
    for i in range(1500, 2100):
        w = list(base)
        w[rng.randrange(60)] = "edit%d" % i
        rows.append((i, " ".join(w)))
    got = suffix_dedup.dedup_substrings(spark, frame(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain_suffix_dedup(rows)


def test_suffix_dedup_of_repeated_doc_ids(spark):
    """Rows that repeat a doc_id are one document for the order, however they are dealt to tasks; a place is not earlier than itself."""
    rng = random.Random(1)
    x = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50))
    rows = [(1, x), (1, x), (2, x[:150] + "#" + x[151:]), (2, x[:150] + "#" + x[151:]), (3, other), (3, x[:200]), (1, x)]
    want = [(1, 359, 0, 0)] * 3 + [(2, 359, 358, 2)] * 2 + [(3, 200, 200, 1), (3, 299, 200, 1)]
    for df in (frame(spark, rows).coalesce(1), frame(spark, rows).repartition(4), frame(spark, rows[::-1]).repartition(3)):
        assert sorted(tuple(r)[:4] for r in suffix_dedup.dedup_substrings(spark, df).collect()) == want


def test_suffix_dedup_of_runs_and_periods(spark):
    """Texts of 101 to 300 bytes that repeat inside themselves and nowhere else."""
    rng = random.Random(31)
    rows = [(i, c * n) for i, (c, n) in enumerate((("a", 101), ("b", 150), ("cd", 60), ("efg", 45), ("h", 184), ("i", 185)))]
    rows += [(10 + p, (prose(rng, 60)[:p] * 300)[: p + 100 + rng.randint(0, 80)]) for p in (1, 5, 17, 40, 84, 85, 86, 120)]
    rows += [(200 + i, prose(rng, 15) + c * 130 + prose(rng, 15)) for i, c in enumerate("-=_")]
    got = suffix_dedup.dedup_substrings(spark, frame(spark, rows)).collect()
    want = plain_suffix_dedup(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and want[0][1] == 100


def test_pieces_of_a_text_without_the_minimiser():
    """A hot segment of one row is also looked for in the other rows of its doc_id."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(97, 123, (2, 180)).astype(np.uint8)
    d, s, n, m, _ = suffix_dedup.segments(a, np.array([0, len(a)]), 100)
    alone = suffix_dedup.pieces(a, s, s + n, m, 100, suffix_dedup.range_hash(a))
    both = np.concatenate([a, b])
    twice = [np.concatenate([v, w]) for v, w in ((s, s + 180), (s + n, s + n + 180), (m, m))]
    got = suffix_dedup.pieces(both, *twice, 100, suffix_dedup.range_hash(both))
    assert all((g == w).all() for g, w in zip(got, alone)) and [len(g) for g in got] == [len(w) for w in alone]
    assert len(suffix_dedup.pieces(b, s, s + n, m, 100, suffix_dedup.range_hash(b))[0]) == 0


def test_suffix_dedup_of_no_and_of_very_long_texts(spark):
    assert suffix_dedup.dedup_substrings(spark, frame(spark, []).limit(0), keep=["lang"]).collect() == []
    rng = random.Random(22)
    long = prose(rng, 600_000)
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(spark, frame(spark, [(1, long), (2, "x " + long[1_000_000:1_500_000])])).collect()}
    assert got[1].n_bytes > 3_000_000 and got[1].n_removed < 2000 and got[2].n_bytes - got[2].n_removed < 3


def test_suffix_intervals_of_few_bytes_and_of_runs():
    """What the intervals remove against all pairs of windows, for strings of few bytes, copies and runs of one letter."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        lens = rng.integers(1, int(rng.choice([3, 30, 80])), int(rng.integers(1, 6)))
        raw = rng.integers(97, 97 + int(rng.choice([1, 2, 20])), lens.sum()).astype(np.uint8)
        size = int(rng.integers(1, len(raw) + 1))
        a, b = rng.integers(0, len(raw) - size + 1, 2)
        raw[a : a + size] = raw[b : b + size].copy()
        length, doc = int(rng.choice([1, 4, 9, 20])), rng.permutation(len(lens))
        begin = np.cumsum(lens) - lens
        windows = sorted((int(doc[i]), p, raw[begin[i] + p : begin[i] + p + length].tobytes()) for i in range(len(lens)) for p in range(lens[i] - length + 1))
        seen, want = set(), set()
        for d, p, w in windows:
            want |= {(d, p + k) for k in range(length)} if w in seen else set()
            seen.add(w)
        sa, _, later = suffix_dedup.suffix_intervals(raw, lens, length, doc, np.zeros(len(lens), np.int64))
        got = set()
        for entry, prefix in later:
            i = int(np.searchsorted(begin, sa[entry], side="right")) - 1
            got |= {(int(doc[i]), int(sa[entry] - begin[i]) + k) for k in range(prefix)}
        assert got == want


def test_hash_of_ranges_holds_no_power_for_each_byte(monkeypatch):
    made, plain = [], suffix_dedup._powers
    monkeypatch.setattr(suffix_dedup, "_powers", lambda base, n: made.append(n) or plain(base, n))
    raw = np.random.default_rng(9).integers(0, 256, 50_001).astype(np.uint8)
    raw[40_000:] = raw[:10_001]
    start, end = np.array([0, 2047, 4096, 9999, 10_000, 50_001]), np.array([100, 2049, 4096, 10_001, 10_001, 50_001])
    got, again = suffix_dedup.range_hash(raw)(start, end), suffix_dedup.range_hash(raw[40_000:])(start[:5], end[:5])
    base, tab = suffix_dedup._BASE, suffix_dedup._TAB
    for i, j, h in zip(start.tolist(), end.tolist(), got):
        whole = sum(int(tab[raw[k]]) * pow(base, k - i, 1 << 64) for k in range(i, j)) % (1 << 64)
        assert h == suffix_dedup._mix(np.array([whole], np.uint64))[0] ^ np.uint64(j - i)
    assert (again == got[:5]).all() and sum(made) < 10_000


def test_maximal_repeats_hold_all_occurrences():
    text = b"xABCDEFyABCDEFzABCDEFyABC"
    raw, lens = np.frombuffer(text, np.uint8), np.array([len(text)])
    sa, groups, _ = suffix_dedup.suffix_intervals(raw, lens, 4, np.zeros(1, np.int64), np.zeros(1, np.int64))
    found = {(text[sa[a] : sa[a] + n], tuple(sorted(sa[a : b + 1].tolist()))) for n, a, b in groups}
    assert found == {(b"ABCDEF", (1, 8, 15)), (b"ABCDEFyABC", (1, 15))}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 150).split() for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
        rows.append((i, " ".join(w)))
    rows += [(70, "Two Words"), (71, "two\nwords"), (72, "two"), *[r for r in ODD if r[0] is not None]]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    got = minhash_dedup.near_duplicates(spark, frame(spark, [*rows, (None, "x y z")]), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_leaks_need_consistent_slots(spark):
    item = "In 1998 the engineer Alice carried 40 kg of copper over the old bridge and Alice sold 40 more"
    same = "in 2003 the engineer Bertha carried 75 kg of copper over the old bridge and Bertha sold 75 more"
    mixed = "in 2003 the engineer Bertha carried 75 kg of copper over the old bridge and Claude sold 61 more"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short")], "item_id long, text string")
    rows = [(1, "Before all that. " + item + " Then more."), (2, same), (3, mixed), (4, "nothing of the kind is said in this one at all"), (4, same), *ODD]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2)}
    assert decontaminate.drop_leaks(spark, frame(spark, rows), bench).count() == len(rows) - 3


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20), "aa") if i % 2 else (i, " ".join("q" + rng.choice("xyz") * 2 + "ü" for _ in range(20)), "bb") for i in range(60)]
    labelled = spark.createDataFrame([*rows, (99, "ignored", None)], "doc_id long, text string, lang string")
    model = langid.train(spark, labelled, "text", "lang")
    probe = spark.createDataFrame([(1, "qxxü qyyü"), (2, "thereon anti"), (3, None), (4, "12 %"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark, probe, model).collect()}
    assert got[1][0] == "bb" and got[2][0] == "aa" and all(got[i] == ("und", 0.0) for i in (3, 4, 5))
    empty = langid.train(spark, labelled.limit(0), "text", "lang")
    assert {r.lang_pred for r in langid.predict(spark, probe, empty).collect()} == {"und"}


def test_gru_gradient_is_right():
    net = gru_lm.Network([b"", *[b"%d" % i for i in range(30)]], list(range(62, 31, -1)), 10)
    rng = np.random.default_rng(0)
    w = (net.weights + rng.normal(0, 0.2, len(net.weights))).astype(np.float64)
    x, y = rng.integers(0, 32, (5, 3)), rng.integers(0, 32, (5, 3))
    live, h = np.ones((5, 3), bool), np.zeros((3, gru_lm.HIDDEN))

    def loss(v):
        p, s, total = net.parts(v), h, 0.0
        for a, b in zip(x, y):
            s = gru_lm._step(p, a, s)[4]
            total -= gru_lm._outputs(net, p, s, b)[0].sum()
        return total

    g = np.zeros_like(w)
    gru_lm.train_window(net, net.parts(w), x, y, live, h, net.parts(g))
    for i in rng.choice(len(w), 60, replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-5
        assert abs((loss(w + d) - loss(w - d)) / 2e-5 - g[i]) < 1e-3


def test_gru_probabilities_sum_to_one():
    net = gru_lm.Network([b"", b"a", b"b", b"c"], [9, 7, 5, 2], 6)
    p = net.parts(net.weights)
    h = np.ones((5, gru_lm.HIDDEN), np.float32)
    assert math.isclose(np.exp(gru_lm._outputs(net, p, h, np.arange(5))[0]).sum(), 1, rel_tol=1e-4)


@pytest.mark.parametrize("scale", [1, 300])
def test_gru_softmaxes_are_small_and_right(monkeypatch, scale):
    """Scores up to gru_lm.SAFE are not shifted, larger ones are; no softmax holds more than a megabyte."""
    net = gru_lm.Network([b"", *[b"%d" % i for i in range(299)]], [9000 // (i + 1) for i in range(300)], 500)
    rng = np.random.default_rng(2)
    p = net.parts(((net.weights + rng.normal(0, 0.2, len(net.weights))) * scale).astype(np.float32))
    h, y = rng.uniform(-1, 1, (20_000, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, 301, 20_000)
    sizes, plain = [], gru_lm._log_softmax
    monkeypatch.setattr(gru_lm, "_log_softmax", lambda a, *rest: sizes.append(a.nbytes) or plain(a, *rest))
    got = gru_lm._outputs(net, p, h, y)[0]
    assert max(sizes) <= 1 << 20
    p, h = {k: v.astype(np.float64) for k, v in p.items()}, h.astype(np.float64)
    for i in range(0, 20_000, 37):
        words = slice(net.first[net.cls[y[i]]], net.first[net.cls[y[i]] + 1])
        want = 0
        for a, at in ((h[i] @ p["C"] + p["c"], net.cls[y[i]]), (p["W"][words] @ h[i] + p["w"][words], y[i] - words.start)):
            want += a[at] - a.max() - np.log(np.exp(a - a.max()).sum())
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-3)


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "unseen words"), (52, "unseen words"), (None, "x")]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    got = gru_lm.score_documents(spark, df, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 == 2)
    count = collections.Counter()
    for d, t in rows:
        if (d or 0) % 7 != 2:
            count.update([*(t or "").lower().split(), ""])
    n, v = sum(count.values()), len(count)
    want = sorted((d if d is not None else -1, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, t in rows for ws in [[*(t or "").lower().split(), ""]])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()) == want
    assert all(r.score < 0 for r in got.collect())


def test_all_training_rows_teach(spark):
    """The whole score against a plain Python network, one word at a time, whose weights learned from all training rows."""
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(30)] + [(31, "unseen words and more of them"), (32, None), (37, "")]
    from pyspark.sql import functions as F

    got = gru_lm.score_documents(spark, frame(spark, rows).coalesce(1).orderBy("doc_id").coalesce(1), F.col("doc_id") % 7 == 2).collect()
    taught = [(t or "").encode() for d, t in rows if d % 7 != 2]
    count = collections.Counter(w for t in taught for w in [*gru_lm.words(t), b""])
    top = sorted(count, key=lambda w: (-count[w], w))
    assert len(top) < gru_lm.HEAD
    net, ids = gru_lm.Network(top, [count[w] for w in top], 1), {w: i for i, w in enumerate(top)}
    w = gru_lm.train_rows(net, net.weights, [np.minimum(gru_lm.encode(ids, gru_lm.words(t)), net.rare) for t in taught], gru_lm.RATE)[0]
    p = {k: v.astype(float).tolist() for k, v in net.parts(w).items()}
    size, sigmoid = gru_lm.HIDDEN, lambda x: 1 / (1 + math.exp(-x))

    def plain(text):
        h, total, before = [0.0] * size, 0.0, net.end
        for word in [*gru_lm.words(text), b""]:
            e, u = p["E"][before], [sum(h[i] * p["U"][i][j] for i in range(size)) for j in range(3 * size)]
            z, r = ([sigmoid(e[a + i] + u[a + i]) for i in range(size)] for a in (0, size))
            n = [math.tanh(e[2 * size + i] + r[i] * u[2 * size + i]) for i in range(size)]
            h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(size)]
            at = ids.get(word, net.rare)
            share = lambda scores, k: scores[k] - math.log(sum(map(math.exp, scores)))
            first, last = net.first[net.cls[at]], net.first[net.cls[at] + 1]
            total += share([p["c"][c] + sum(h[i] * p["C"][i][c] for i in range(size)) for c in range(net.n_cls)], int(net.cls[at]))
            total += share([p["w"][k] + sum(h[i] * p["W"][k][i] for i in range(size)) for k in range(first, last)], at - first)
            before = at  # rare is of one word here, as all known words are in the head
        return total / math.log(10)

    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        assert math.isclose(r.score, plain((t or "").encode()), rel_tol=1e-4)
    untaught = gru_lm.score_texts(net, net.weights, [gru_lm.encode(ids, gru_lm.words(t)) for t in taught]) / math.log(10)
    assert not np.allclose(untaught, [r.score for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id % 7 != 2], rtol=1e-3)


def test_most_frequent_words_are_whole_bins(spark):
    rng = random.Random(11)
    count = {b"%d" % i: int(rng.paretovariate(0.4)) for i in range(3000)} | {b"x" * 65: 10**9}
    df = spark.createDataFrame([*count.items()], "word binary, n long")
    order = sorted((-n, w) for w, n in count.items() if len(w) <= gru_lm.KNOWN_BYTES)
    for limit in (0, 1, 40, 900, 5000):
        words, n = gru_lm._most_frequent(df, limit)
        assert len(words) <= limit and [*zip((-n).tolist(), words)] == order[: len(words)]
        assert limit < 900 or len(words) > 0.2 * min(limit, 3000)
    assert gru_lm._most_frequent(spark.createDataFrame([(b"%d" % i, 1) for i in range(9)], "word binary, n long"), 5)[0] == []


def test_scoring_of_an_empty_table_and_a_long_text(spark):
    from pyspark.sql import functions as F

    assert gru_lm.score_documents(spark, frame(spark, [(1, "a")]).limit(0), F.lit(False)).collect() == []
    rows = [(1, "one two " * 300_000), (2, "one two three")]
    long, short = sorted(gru_lm.score_documents(spark, frame(spark, rows), F.col("doc_id") == 2).collect(), key=lambda r: r.doc_id)
    assert (long.n_tokens, short.n_tokens, short.n_known, short.train_tokens) == (600_001, 4, 3, 600_001)
    assert long.score > long.base_score  # it has learned that the words take turns


def test_url_rules(spark):
    urls = {
        "https://a.Example.COM/en/77?x": ("example.com/en/7", "allow"), "http://x.com/en/1": ("com/en/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"),
        "http://b.net/de/1": ("net/", "block"), "http://notcom/en/": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "http://q.org/x?page=2&ref=y": (None, "block"), "http://net/DE/1": (None, "allow"),
    }
    urls["http://b.net/de/1"] = ("net/de/", "block")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule")
    got = {u: (r.rule, r.verdict) for u, r in zip(urls, sorted(url_filter.filter_urls(spark, df).collect(), key=lambda r: r.page_id))}
    assert got == urls


def test_url_rules_have_the_words_of_the_contract(spark):
    want = {"http://x.com/en/1": "block", "http://a.example.com/en/7": "allow", "http://example.com/en/6": "block", "http://b.net/de/1": "allow", "http://example.net/de/8": "block", "http://c.org/es/": "block"}
    got = url_filter.filter_urls(spark, spark.createDataFrame(list(enumerate(want)), "page_id long, url string")).collect()
    assert {list(want)[r.page_id]: r.verdict for r in got} == want


def test_each_alternative_of_a_url_pattern_blocks(spark):
    rng = random.Random(7)
    pieces = ["cart", "checkout", "add", "address", "added", "add2", "wp-admin", "wp-login", "print", "12", "casino.", "www.casino.x", "?replytocom=1", "&phpsessid=2", "?jsessionid=3", ";jsessionid=4", "?page=1&ref=2", "&utm_source=feed", "#", "?sort=asc", "&sort=desc", ".exe", ".msi", ".apk", ".MSI", ".exes", "x", "?sid=1", "?sessionid=2", "&session_id=a", "?gclid=", "?fbclid=1", "&msclkid=", "?utm_medium=x", "&utm_content=", "?share=email", "&share=reddit", "?share=emails", "?do=diff", "?do=login&", "?action=raw", "&action=edit", "?oldid=77", "?feed=atom", "feed/rss2", "feed/rdf/", "login", "signup", "logins", "wishlist/x", "basket/y", "cgi-bin/z", "xmlrpc.php", "trackback", "calendar/2020/11", "tag/a/page/2", ".zip", ".7z", ".gz?x", ".mp4", ".flac", ".png", ".webp#", "%20" * 12, "%20" * 11]
    urls = [f"http://h.info/{a}{gap}{b}" for a in pieces for b in pieces for gap in ("", "/")] + ["http://www.casino.x/", "https://CASINO.x/", "http://ad.x/", "http://ads.y/", "http://doubleclick.z/", "http://poker.a", "http://www.betting.b/c", "http://x.y.onion/", "http://a.i2p", "mailto:a@b", "data:text", "http://10.0.0.1/x", "http://1.2.3.4", "http://1.2.3.4.5/"]
    urls += ["http://h.info/" + "/".join(rng.choices(pieces, k=rng.randint(3, 6))) for _ in range(300)]
    got = url_filter.filter_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    met = {p: {u for u in urls if re.search(p, u.lower())} for p, _ in url_filter.PATTERNS}
    assert all(met.values()) and {urls[r.page_id] for r in got if r.verdict == "block"} == set().union(*met.values())
    # as the only rule too: none is met by way of another
    for p, tokens in url_filter.PATTERNS:
        judge = url_filter.filter_urls(spark, spark.createDataFrame([(i, u) for i, u in enumerate(urls) if u in met[p]][:80], "page_id long, url string"), rules=[], patterns=[(p, tokens)])
        assert judge.where("verdict <> 'block'").count() == 0, p


def test_lookup_table_is_balanced_and_stable():
    names = sharding.shard_names(50)
    table = sharding.lookup_table(names, 5003)
    load = collections.Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    less = sharding.lookup_table(names[:-1], 5003)
    assert sum(a != b for a, b in zip(table, less)) < 3 * 5003 / 50
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5000)


def test_sharding_keeps_all_rows(spark):
    got = sharding.assign_shards(spark, frame(spark, [(1, "a"), (1, "b"), (None, "c")]), "doc_id").collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0, 2.0]), (780, [None] * 16), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(spark, df, 20, enough=120).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    f = x.astype(np.float32).astype(np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 600, 20))
    for q, found in got.items():
        s = f @ f[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        found = sorted(found)
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(s[v] - y) < 1e-9 for _, v, y in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(spark, df.limit(0), 20).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    base = codes[7]
    for i in range(400):  # codes around one, at all distances up to 20
        bits = np.zeros(64, np.uint8)
        bits[rng.choice(64, i % 21, replace=False)] = 1
        codes[i + 100] = base ^ np.packbits(bits).view(np.uint16)
    index = ann.Index(codes)
    far = ann._POP[codes ^ base].astype(int)
    for flips in range(4):
        found = set(index.retrieved(base, flips, 0).tolist())
        assert found == set(np.flatnonzero((far <= flips).any(1)).tolist()) >= set(np.flatnonzero(far.sum(1) <= 4 * (flips + 1) - 1).tolist())
    assert len(index.retrieved(base, 0, 2000)) >= 2000 and len(index.retrieved(base, 0, 9999)) == 3000


def test_recall_and_probed_share_with_the_shipped_limits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    asked, best = ann.searched(spark, df, 300)
    rows = {r.id: r for r in asked.join(best, asked["h"] == best["qh"]).collect()}
    d, hits = x.astype(np.float64), 0
    for q, r in rows.items():
        s = d @ d[q]
        hits += len(set(np.argsort(-s)[:21].tolist()) & {b.id for b in r.best})
    assert len(rows) == 100 and hits / (21 * len(rows)) >= 0.9
    assert sum(r.seen for r in rows.values()) / sum(r.n for r in rows.values()) < 0.25


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "GNU General-Public\nLICENSE, version 3. mit license MIT license"), (3, "Licensed under CC BY-NC 4.0"), (4, "plain"), (5, None), (6, "é MIT licensed"), (6, "é MIT licensed"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels))
    assert got[1] == [(5, 1, 3, 3, "mit", "mit")]
    assert got[2] == [(10, 3, 0, 8, "gpl,mit", "gpl,gpl-3,mit")]
    assert got[3] == [(7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0")]
    assert got[4] == [(1, 0, None, None, "", "")] and got[5] == [(0, 0, None, None, "", "")]
    assert got[6] == [(3, 0, None, None, "", "")] * 2 and got[7][0][5] == "mit"
    assert len(licenses.signatures()) > 150 and all(re.compile(r) for _, _, r, _ in licenses.signatures())


def test_a_least_match_of_each_license_signature_is_found(spark):
    def least(tree):
        """A shortest text that the parsed expression matches, with the first of its alternatives."""
        out = ""
        for op, arg in tree:
            op = str(op)
            out += (
                chr(arg) if op == "LITERAL" else "x" if op == "NOT_LITERAL" else least(arg[3]) if op == "SUBPATTERN" else least(arg[1][0]) if op == "BRANCH"
                else least(arg[2]) * arg[0] if op == "MAX_REPEAT" else "x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            )
        return out

    texts = {i: least(re._parser.parse(regex)) for i, _, regex, _ in licenses.signatures()}
    assert all(re.fullmatch(regex, texts[i]) for i, _, regex, _ in licenses.signatures())
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [*texts.items()])).collect()}
    assert [texts[i] for i in texts if not got[i].labels or got[i].score <= 0] == []


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(6)
    for _ in range(200):
        top = sorted(rng.sample(range(0, rng.choice([12, 60, 90_000])), rng.randint(1, 9)))
        count, k = [rng.randint(1, 9) for _ in top], rng.randint(1, 5)
        bounds, padding = packing.best_boundaries(top, count, k)
        cost = lambda cut: sum(c * (min(b for b in (*cut, top[-1]) if b >= t) - t) for t, c in zip(top, count))  # noqa: B023, E731
        least = min(cost(cut) for n in range(k) for cut in itertools.combinations(top[:-1], n))
        assert padding == least == cost(bounds) and len(bounds) <= k and bounds[-1] == top[-1]
    # many lengths: no boundary can be moved to the next length with less padding
    top = sorted(rng.sample(range(1, 60_000), 5000))
    count = [rng.randint(1, 40) for _ in top]
    t, c = np.array(top), np.array(count)
    cost = lambda b: int((c * (np.array(b)[np.searchsorted(b, t)] - t)).sum())
    bounds, padding = packing.best_boundaries(top, count, 12)
    assert len(bounds) == 12 and cost(bounds) == padding
    for i in range(11):
        for step in (-1, 1):
            moved = [*bounds]
            moved[i] = top[top.index(bounds[i]) + step]
            assert cost(sorted(moved)) >= padding
    assert packing.best_boundaries([], [], 3) == ([], 0)


def plain_pack(rows, buckets, budget):
    """Bucket length of each length, by trying all boundaries, and the rows of a batch."""
    import itertools

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    lens = sorted(set(size))
    cost = lambda cut: sum(min(b for b in (*cut, lens[-1]) if b >= n) - n for n in size)
    return size, min(cost(cut) for n in range(min(buckets, len(lens))) for cut in itertools.combinations(lens[:-1], n))


def test_packing_equals_brute_force_and_is_stable(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 3, 7, 90, 280, 300, 700, 900, 1500])) for i in range(150)] + ODD + [(300, "w " * 5000)] + [(7, "w " * n) for n in (3, 3, 7, 280)] * 5 + [(None, "w " * n) for n in range(3)] * 4
    size, least = plain_pack(rows, 4, 3000)
    runs = []
    for parts in (1, 3, 7):
        got = packing.pack(spark, frame(spark, rows, parts), buckets=4, budget=3000).collect()
        runs.append(sorted(map(tuple, got), key=str))
    assert runs[0] == runs[1] == runs[2]
    assert sorted(r.n_tokens for r in got) == sorted(size) and sum(r.padding for r in got) == least
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens + r.padding == r.bucket_len and r.padding >= 0
        batches[r.bucket, r.bucket_len, r.batch].append(r.slot)
    room = {b: max(1, 3000 // max(n, 1)) for b, n, _ in batches}
    for (b, _, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room[b]
        assert len(slots) == room[b] or (b, _, k + 1) not in batches  # only a bucket's last batch has room left


def test_batches_keep_the_budget(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(200)] + ODD + [(300, "w " * 5000)]
    got = packing.pack(spark, frame(spark, rows), buckets=4, budget=400).collect()
    assert len(got) == len(rows)
    batches = collections.Counter((r.bucket, r.batch) for r in got)
    size = {r.bucket: r.bucket_len for r in got}
    assert all(n * max(size[b], 1) <= 400 or n == 1 for (b, _), n in batches.items())
    assert packing.pack(spark, frame(spark, rows).limit(0)).count() == 0
