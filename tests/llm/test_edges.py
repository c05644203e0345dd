"""Extra columns with clashing names, empty tables, nulls everywhere, repeated rows and a very long text, for each operator and stage."""

import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corridora.llm import ann, decontaminate, gru_lm, langid, licenses, minhash_dedup, packing, sharding, suffix_dedup, url_filter

#: Names that the operators use for columns of their own.
CLASHES = ["score", "lang_pred", "row", "held_out", "kept_text", "n_bytes", "spans", "todo", "s", "e", "m", "hot", "_h", "_d", "_text", "th", "w", "pos", "kind", "at", "item", "item_id", "text_hash", "shift", "dp", "gone", "kept", "component", "component_id", "node", "rep", "bands", "n_tokens", "bucket", "batch", "slot", "shard", "n", "labels", "base_labels", "_t", "_n", "_b", "_k", "_row", "word", "tail", "host", "path", "rule", "verdict", "id", "v", "h", "qh", "best", "ids", "r", "b", "_x_row", "_gate", "x", "_slot", "_rank", "p"]
BENCH = [(1, "the old bridge carried copper over a wide river while many people sold bread"), (2, "What is 12 + 35?"), (3, None), (None, "a null item id beside quite a few other plain words")]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    shared = prose(rng, 40)
    out = [(i, prose(rng, rng.randint(1, 60)) + (" " + shared if i % 3 == 0 else ""), rng.choice(["aa", "bb", None]), "src" if i % 2 else None, i) for i in range(30)]
    out += [(40, None, None, None, None), (41, "", "aa", "s", 0), (None, "a text without an id and then some", "aa", None, 3), (None, None, None, None, None), out[3], out[3], (7, "another text under an id that is there", "bb", "s", 2)]
    return out + [(50, BENCH[0][1].upper() + ". What is 7 + 9? mit license", "aa", "s", 1)]


def documents(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(f"clash {i}").alias(c) for i, c in enumerate(CLASHES)]) if clash else df


def pages(spark, rows, clash=False):
    df = spark.createDataFrame([(d, t and f"http://x.com/en/{t[:9]}") for d, t, *_ in rows], "page_id long, url string")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]) if clash else df


def vectors(spark, rows, clash=False):
    of = lambda d, t: random.Random(f"{d}{t}").random()
    df = spark.createDataFrame([(d, None if t is None else [of(d, t), None if d == 5 else of(t, d)]) for d, t, *_ in rows], "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]) if clash else df


def bench(spark, clash=False):
    df = spark.createDataFrame(BENCH, "item_id long, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES if c != "item_id"]) if clash else df


OPERATORS = {
    "packing": (documents, lambda spark, d, c: packing.pack(spark, d)),
    "decontamination": (documents, lambda spark, d, c: decontaminate.find_leaks(spark, d, bench(spark, c))),
    "suffix": (documents, lambda spark, d, c: suffix_dedup.dedup_substrings(spark, d, keep=["lang", *(CLASHES if c else [])]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "lang")),
    "language": (documents, lambda spark, d, c: langid.predict(spark, d, langid.train(spark, d, "text", "lang"), keep=["doc_id", "source", *(CLASHES if c else [])]).select("doc_id", "source", "lang_pred", "score")),
    "gru": (documents, lambda spark, d, c: gru_lm.score_documents(spark, d.coalesce(1).orderBy("doc_id", "text").coalesce(1), langid.fold("doc_id", 7) == 2)),
    "url": (pages, lambda spark, d, c: url_filter.filter_urls(spark, d)),
    "sharding": (documents, lambda spark, d, c: sharding.assign_shards(spark, d, "doc_id")),
    "ann": (vectors, lambda spark, d, c: ann.nearest(spark, d, 5)),
    "minhash": (documents, lambda spark, d, c: minhash_dedup.near_duplicates(spark, d)),
    "license": (documents, lambda spark, d, c: licenses.scan_licenses(d)),
}


def plain(df):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_and_order_of_rows_change_nothing(spark, rows, name):
    make, run = OPERATORS[name]
    want = plain(run(spark, make(spark, rows), False))
    assert want == plain(run(spark, make(spark, rows[::-1], True), True))
    per_row = {"decontamination", "ann"}
    assert name in per_row or len(want) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, rows, name):
    make, run = OPERATORS[name]
    assert run(spark, make(spark, rows).limit(0), False).collect() == []


@pytest.mark.parametrize("name", [n for n, (make, _) in OPERATORS.items() if make is documents])
def test_a_very_long_text(spark, name):
    long = " ".join(prose(random.Random(5), 2000) + f" number {i}" for i in range(200)) + " mit license. " + BENCH[0][1]
    assert len(long) > 1_500_000
    got = OPERATORS[name][1](spark, documents(spark, [(1, long, "aa", "s", 1), (2, "short text", "bb", "s", 1), (3, long, "aa", "s", 1)]), False).collect()
    by = {r.doc_id: r for r in got}
    words = len(long.split())
    if name == "packing":
        assert by[1].n_tokens == by[3].n_tokens == words
    elif name == "decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 1)}
    elif name == "suffix":
        assert by[3].n_removed == by[3].n_bytes == len(long) and by[1].n_removed == len(long) - len(by[1].kept_text)
    elif name == "language":
        assert (by[1].lang_pred, by[1].score) == ("aa", 1.0)
    elif name == "gru":
        assert by[1].n_tokens == words + 1 and by[1].score < 0 and math.isclose(by[1].score, by[3].score, rel_tol=1e-4)
    elif name == "minhash":
        assert [by[i].component_id for i in (1, 2, 3)] == [1, 2, 1]
    elif name == "license":
        assert (by[1].n_base, by[1].base_labels) == (1, "mit")
    assert name == "decontamination" or len(got) == 3


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_all_columns(spark, rows, tmp_path, name, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    with_clash, without = (documents(spark, rows, c) for c in (True, False))
    want = plain(stage(spark, without, str(tmp_path)))
    got = stage(spark, with_clash, str(tmp_path))
    if name == "packing":
        assert plain(got) == want and len(want) == len(rows)
    else:
        assert got.columns == with_clash.columns and plain(got.select(*without.columns)) == want
        for r in got.collect():
            assert [r[c] for c in CLASHES] == [f"clash {i}" for i in range(len(CLASHES))]
    assert stage(spark, without.limit(0), str(tmp_path)).collect() == []


def test_what_stages_do_with_nulls_and_repeated_rows(spark, rows, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows)
    of = lambda f: [(r.doc_id, r.text) for r in f(spark, docs, str(tmp_path)).collect()]
    texts = [(d, t) for d, t, *_ in rows]
    assert all(t and any(c.isalpha() for c in t) for _, t in of(corpus_pipeline.language_id))
    near = of(corpus_pipeline.near_dedup)  # repeated rows are one document, so all stay
    assert sorted(near, key=str) == sorted(texts, key=str)
    cut = of(corpus_pipeline.suffix_dedup_stage)
    assert len(cut) == len(rows) and all(t is not None for _, t in cut) and sorted((d is None, d) for d, _ in cut if d is not None) == sorted((d is None, d) for d, _ in texts if d is not None)
    clean = of(corpus_pipeline.benchmark_decontamination)
    assert len(clean) == len(rows) - 1 and 50 not in {d for d, _ in clean}
