"""The corpus pipeline: five stages over `documents`, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridora.llm import decontaminate, langid, minhash_dedup, packing, suffix_dedup
from corridora.llm.common import bundled, discard, table, written

#: Documents whose predicted language has a lower posterior probability are rejected, as are those without a letter.
MIN_LANGUAGE_SCORE = 0.5
#: Similarity of word shingles, in per cent, from which documents are near copies; op9 alone has 85.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; the model learns as in op4, from three folds of four.

    Null texts and texts without a letter have no language and go; rows without a label do not teach; repeated rows are
    judged each, all alike; with no labelled row nothing has a language; an empty table stays empty; other columns stay.
    """
    model = langid.train(spark, docs.where(langid.fold("doc_id", 4) != 2), "text", "lang")
    kept = langid.judged(spark, docs, model).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Rows that repeat a doc_id are one document: they stay, or go, together, and any of their texts links them. Rows with
    a null doc_id, and null or blank texts, are linked with nothing and stay; an empty table stays empty; other columns
    stay.
    """
    found = minhash_dedup.near_duplicates(spark, docs.select("doc_id", "text"), NEAR_PERCENT)
    gone = written(spark, found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    rows = bundled(docs, "row")
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start earlier; the documents stay, if with an empty text.

    A null text becomes an empty one; rows with a null doc_id stay as they are; of rows that repeat a doc_id each loses
    the spans found in any of them; texts under 100 bytes stay whole; an empty table stays empty; n_chars is counted
    anew where there is such a column; other columns stay, whatever their names.
    """
    kept = suffix_dedup.dedup_substrings(spark, bundled(docs, "row", ("doc_id", "text")), keep=["row"])
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[(own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; each row is judged by its own text, also where a doc_id repeats; null items are
    ignored; an empty table stays empty; other columns stay, whatever their names.
    """
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in its bucket and batch.

    Null and blank texts have no tokens and are packed too; repeated rows are packed each, and have their places in the
    order of (doc_id, length, text hash); a text longer than the budget is a batch of its own; an empty table gives no
    rows; other columns are not returned.
    """
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", length_packing),
]

#: The stages learn, hash and build suffix arrays, which SQL does not express; the tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(spark, stage(spark, docs, sf_dir), name)
        discard(spark, before)  # the tables that the job itself wrote; not the input
    return STAGES[-1][1](spark, docs, sf_dir)
