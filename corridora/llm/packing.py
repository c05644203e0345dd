"""Packing: optimal length buckets and token-budget batches.

A global histogram of lengths (a row for each length that occurs, so at most as many as the longest text has tokens)
goes to the driver, where dynamic programming chooses the bucket boundaries that minimise padding, exactly: the padding
of a bucket fulfils the quadrangle inequality, so the best last boundary grows with the length, and each layer takes
time in proportion to n log n. Inside a bucket, batches take as many documents as the budget holds at the bucket's
length.

A document's place in its bucket is its rank by a hashed slot, then by id, length and text hash: slots are counted
first, so that a bucket which holds a third of all rows is numbered by many tasks, and a place does not depend on how
the rows are dealt over tasks.

Nulls and edge cases: a null or blank text has no tokens and goes to the first bucket; a text longer than the budget
makes a batch of its own; rows that repeat a key are packed each, in the order above, equal rows in any; a very long
text is one row like others; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 12
BUDGET = 16384
#: Rows that one task numbers.
SLOT_ROWS = 16384


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09\\x0A\\x0B\\x0C\\x0D]+")).cast("long")


def _best_splits(best: np.ndarray, top: np.ndarray, cnt: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padding, last place before the last bucket) with one more bucket, for each last length but the first.

    Level by level, the lengths in the middle of the open stretches are settled, each by a look at the places that the
    stretches' ends leave for it; of equally good places the first counts.
    """
    n = len(top)
    new, place = np.full(n, np.inf), np.full(n, -1, np.int64)
    lo, hi, first, last = (np.array([v]) for v in (1, n - 1, 0, n - 2))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(last, mid - 1) - first + 1
        begin = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(begin - first, size)
        j = np.repeat(mid, size)
        cost = best[i] + top[j] * (cnt[j + 1] - cnt[i + 1]) - (tok[j + 1] - tok[i + 1])
        least = np.minimum.reduceat(cost, begin)
        at = np.minimum.reduceat(np.where(cost == np.repeat(least, size), i, n), begin)
        new[mid], place[mid] = least, at
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (np.concatenate(v) for v in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (first[left], at[right]), (at[left], last[right])))
    return new, place


def best_boundaries(top: list[int], count: list[int], buckets: int) -> tuple[list[int], int]:
    """Boundaries (bucket lengths, rising) over rising lengths with their rows, and the padding they leave."""
    n = len(top)
    if not n:
        return [], 0
    t = np.asarray(top, np.float64)
    cnt = np.append(0, np.cumsum(count)).astype(np.float64)
    tok = np.append(0, np.cumsum(t * np.asarray(count, np.float64)))
    best, back = t * cnt[1:] - tok[1:], []
    for _ in range(1, min(buckets, n)):
        new, place = _best_splits(best, t, cnt, tok)
        better = new < best
        best, place = np.where(better, new, best), np.where(better, place, -1)
        back.append(place)
    out, j = [], n - 1
    for place in back[::-1]:
        if place[j] >= 0:
            out.append(int(top[j]))
            j = int(place[j])
    return [*out, int(top[j])][::-1], int(round(best[-1]))


def pack(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, bucket_len, batch, slot, padding) for each row: batch counts inside the bucket, slot inside the batch."""
    n_tokens, digest = token_count(F.col(text)), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    lens = written(spark, docs.select(F.col(key), n_tokens.alias("n_tokens"), digest.alias("_d")), "lengths")
    hist = sorted((r["n_tokens"], r["n"]) for r in lens.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds, _ = best_boundaries(*map(list, zip(*hist)), buckets) if hist else ([0], 0)
    slots = max(1, sum(n for _, n in hist) // SLOT_ROWS)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    rows = lens.select(key, "n_tokens", "_d", bucket.alias("bucket"), F.pmod(F.xxhash64(key, "n_tokens", "_d"), F.lit(slots)).alias("_slot"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("bucket", "_slot").agg(F.count("*").alias("_n")).select("bucket", "_slot", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "_slot").orderBy(key, "n_tokens", "_d")) - 1 + F.col("_before")
    length = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    numbered = rows.join(offsets, ["bucket", "_slot"]).withColumn("_rank", rank).withColumn("bucket_len", length)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return numbered.select(key, "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / room).cast("long").alias("batch"), (F.col("_rank") % room).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
