"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, everything but letters becomes a gap, and grams of one to three characters (gaps included, but not
gaps alone) fall into a fixed number of hash buckets. Counts per language and bucket come from all labelled rows; the
log-probability matrix (languages x buckets, a parameter) is broadcast, and each block of texts is scored as a sparse
matrix product in numpy: a gather of the grams' rows, summed by document.

Nulls and edge cases: a null text, or one without a letter, is `und` with score 0; rows with a null label do not teach;
ties go to the language that sorts first; repeated rows are judged each; a very long text is one block of work; with no
labelled row everything is `und`; an empty table gives no rows. Other columns are carried along in one struct, so their
names cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, session, text_blocks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
ALPHA = 0.5
UND = "und"
_BLOCK = 1 << 20
_TOP = 0x40000  # no letters above


@cache
def _letters() -> np.ndarray:
    """For each character its lower-case code, or 0 if it is no letter."""
    out = np.zeros(_TOP + 1, np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(raw: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(character offsets, for each order the bucket of the gram that starts at each character, or `buckets` for none)."""
    chars = raw.tobytes().decode("utf-8", "replace")
    at = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[off]
    if len(chars) != at[-1]:  # text that is not valid UTF-8
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:])]
        at, chars = np.append(0, np.cumsum([len(x) for x in parts])), "".join(parts)
    code = _letters()[np.minimum(np.frombuffer(chars.encode("utf-32-le", "replace"), np.uint32), _TOP)].astype(np.uint64)
    n = len(code)
    to_end = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    out, h, some = [], np.zeros(n, np.uint64), np.zeros(n, bool)
    for order in range(1, max(ORDERS) + 1):
        k = order - 1
        h[: n - k] = h[: n - k] * np.uint64(0x9E3779B97F4A7C15) + code[k:] + np.uint64(order)
        some[: n - k] |= code[k:] > 0
        if order in ORDERS:
            x = h * np.uint64(0xD6E8FEB86659FD93)
            x = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
            out.append(np.where(some & (to_end >= order), x % np.uint64(buckets), buckets).astype(np.int64))
    return at, out


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part, raw, off in text_blocks(batches, "text", _BLOCK):
            names, which = np.unique(np.asarray(part.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            at, by_order = grams(raw, off, buckets)
            lang = np.repeat(which, np.diff(at))
            count = sum(np.bincount(lang * (buckets + 1) + g, minlength=len(names) * (buckets + 1)) for g in by_order).reshape(len(names), -1)
            for k, name in enumerate(names.tolist()):
                total[name] = total.get(name, 0) + count[k, :buckets]
                rows[name] = rows.get(name, 0) + int((which == k).sum())
        for name, c in total.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * (len(b) + 1), pa.string()), "bucket": pa.array(np.append(b, -1), pa.int32()), "n": pa.array(np.append(c[b], rows[name]), pa.int64())})

    return run


def train(spark: SparkSession, labelled: DataFrame, text: str, lang: str, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities with a last column of zeros, log-priors) from all rows with a label."""
    session(spark)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # languages x buckets rows at most
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), buckets + 1))
    table[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int) if len(got) else [], got["bucket"].to_numpy(int)] = got["n"]
    rows_of, table = table[:, -1].copy(), table[:, :-1]
    logp = np.log(table + ALPHA) - np.log(table.sum(1, keepdims=True) + ALPHA * buckets)
    return langs, np.hstack([logp, np.zeros((len(langs), 1))]), np.log(np.maximum(rows_of, 1) / max(rows_of.sum(), 1))


def _score(model, place: int | None):
    """Rows of (row struct, text) or, with a place, of (row struct) whose field at that place is the text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1) if place is None else b.column(0).field(place)
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp, prior = model.value
        for part, raw, off in text_blocks(texts(batches), "text", _BLOCK):
            n = len(off) - 1
            pred, score = np.full(n, len(langs)), np.zeros(n)
            if langs and len(raw):
                at, by_order = grams(raw, off, logp.shape[1] - 1)
                some = np.flatnonzero(np.diff(at))
                like = np.zeros((n, len(langs)))
                for k in range(len(langs)):
                    for g in by_order:
                        like[some, k] += np.add.reduceat(logp[k][g], at[some])
                has = np.zeros(n, bool)
                has[some] = np.add.reduceat((by_order[0] < logp.shape[1] - 1).astype(np.int64), at[some]) > 0
                like += prior
                best = like.argmax(1)
                pred[has] = best[has]
                score[has] = (1 / np.exp(like - like.max(1, keepdims=True)).sum(1))[has]
            names = np.array([*langs, UND], dtype=object)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[pred], pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def judged(spark: SparkSession, docs: DataFrame, model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row whole as a struct, with its language. Its text goes to Python once."""
    session(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = bundled(docs, "row")
    return rows.mapInArrow(_score(shared, docs.columns.index(text)), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def predict(spark: SparkSession, docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with lang_pred and score, for each row; a kept column with one of these two names is left out."""
    session(spark)
    keep = [c for c in keep or ["doc_id"] if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row"), F.col(text).cast("binary").alias("text"))
    got = rows.mapInArrow(_score(shared, None), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "lang_pred", "score")


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
