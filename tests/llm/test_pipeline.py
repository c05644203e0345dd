"""The pipeline's stages, and its result against plain Python versions of the stages in turn."""

import collections
import math
import random
import unicodedata
import zlib

import corpus_pipeline
from corridora.llm import langid, packing
from test_brute_force import plain_grams, plain_leaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def plain_language(rows):
    """Documents with a letter whose best language has a posterior of MIN_LANGUAGE_SCORE at least."""
    count, size = collections.defaultdict(collections.Counter), collections.Counter()
    for d, t, lang in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2:
            size[lang] += 1
            count[lang].update(plain_grams(t or ""))
    out = []
    for d, t, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            continue
        g = list(plain_grams(t))
        like = [math.log(size[k] / sum(size.values())) + sum(math.log((count[k][b] + langid.ALPHA) / (sum(count[k].values()) + langid.ALPHA * langid.BUCKETS)) for b in g) for k in sorted(size)]
        if 1 / sum(math.exp(v - max(like)) for v in like) >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            out.append((d, t))
    return out


def plain_near(rows):
    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return [(d, t) for d, t in rows if comp[d] == d]


def plain_suffix(rows):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        out.append((d, bytes(x for x, g in zip(b, gone) if not g).decode()))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(10)
    letters = {"aa": "abcdefgh", "bb": "qrstuvwz"}
    prose = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    shared = {k: [prose(k, 50) for _ in range(2)] for k in letters}
    items = {k: [prose(k, 25) for _ in range(2)] for k in letters}
    rows = []
    for i in range(50):
        k = rng.choice(list(letters))
        parts = [prose(k, rng.randint(5, 60))] + rng.choices(shared[k], k=rng.choice([0, 0, 1, 2])) + rng.choices(items[k], k=rng.choice([0, 0, 0, 1])) + [prose(k, 3)]
        rows.append((i, " ".join(parts), k if i % 9 else None))
    for i in range(50, 60):  # exact and near copies
        w = rows[rng.randrange(50)][1].split()
        rows.append((i, " ".join(w if i % 2 else [*w[:-1], "other"]).upper() if i == 53 else " ".join([*w[i % 2 :]]), "aa"))
    rows += [(70, None, "aa"), (71, "", None), (72, "12 . 7 %", "bb"), (73, "abc", "aa"), (74, prose("bb", 2000), "bb"), (75, " ".join([shared["aa"][0]] * 3), "aa"), (76, items["bb"][0], "bb")]
    bench = [(i, t) for i, t in enumerate(sum(items.values(), []))] + [(9, None), (10, "")]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    near = plain_near(plain_language(rows))
    cut = plain_suffix(near)
    leaks = {x[0] for x in plain_leaks(cut, bench)}
    want = {d: len(t.split()) for d, t in cut if d not in leaks}
    assert len(rows) - 4 >= len(near) > len(want) and leaks and any(t != u for (_, t), (_, u) in zip(sorted(near), cut))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(want.items())
    batches = collections.Counter((r.bucket, r.batch) for r in got)
    length = {r.bucket: r.bucket_len for r in got}
    assert all(r.padding == r.bucket_len - r.n_tokens >= 0 for r in got) and all(n == 1 or n * length[b] <= packing.BUDGET for (b, _), n in batches.items())
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_links_from_80_percent(spark):
    rng = random.Random(12)
    rows, gone = [], set()
    for n in [49, 54, 48] * 5:  # one word changed in the middle: 40 of 50 shingles are shared, 45 of 55, and 39 of 49
        w = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]]))]
        gone |= {len(rows) - 1} if n > 48 else set()
    docs = spark.createDataFrame([(d, t, "aa", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {d for d, _ in rows} - gone
