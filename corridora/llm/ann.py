"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred and projected on rotations learned by iterative quantisation on a bounded sample (SAMPLE
vectors, the least hashes of all); TURNS rotations give TURNS * dimensions bits. Each code is cut into 16-bit
substrings, and every substring is an index of its own: a table of all 2^16 values with the codes that hold them. A
query probes each table at the values within FLIPS bits of its own, one by one: by the pigeonhole principle this
retrieves every code within substrings * (FLIPS + 1) - 1 bits (and others, of which it wants to know no more). All that
is retrieved is ranked again on the float vectors, in double precision. A query that retrieves fewer than ENOUGH codes
of a shard probes farther, bit by bit, until it has as many or all; so a small table is searched whole.

Equal vectors are one entry with its smallest ids (one more than are asked for, which is all that ties can use), so a
vector that a third of all rows share costs what one vector costs. Entries lie in shards and distinct query vectors in
blocks; each block meets each shard as one piece of work, and the best of all shards are merged.

Nulls and edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors
of another length than the most frequent one, nor null ids; of rows that repeat an id with one vector one counts;
ties go to smaller ids; with fewer candidates than asked for all are returned; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, written

K = 20
TURNS = 6
FLIPS = 3
ENOUGH = 2_500
SAMPLE = 20_000
ITERATIONS = 15
SHARD_ROWS = 65_536
BLOCK_ROWS = 512
SUB = 16
_POP = np.array([i.bit_count() for i in range(1 << SUB)], np.uint8)
#: All differences of a substring, those of fewer bits first, and where those of each number of bits begin.
_FLIPPED = np.argsort(_POP, kind="stable").astype(np.int64)
_FROM = np.searchsorted(_POP[_FLIPPED], np.arange(SUB + 2))


def learn_rotations(x: np.ndarray, turns: int = TURNS, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dimensions x bits matrix): iterative quantisation from `turns` seeded starts."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    v = x - mean
    out = []
    for seed in range(turns):
        r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(iterations if len(x) > x.shape[1] else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(r)
    return mean, np.hstack(out)


def encode(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """rows x substrings of 16 bits."""
    bits = (x - mean) @ matrix >= 0
    pad = -bits.shape[1] % SUB
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint16)


class Index:
    """Substring tables over codes: for each table and value the codes that hold it, as a stretch of one list."""

    def __init__(self, codes: np.ndarray):
        self.n, self.m = codes.shape
        self.codes = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32).ravel()
        self.starts = np.zeros((self.m, (1 << SUB) + 1), np.int32)
        for j in range(self.m):
            np.cumsum(np.bincount(codes[:, j], minlength=1 << SUB), out=self.starts[j, 1:])

    def probed(self, query: np.ndarray, low: int, high: int) -> np.ndarray:
        """The codes, with repeats, whose substring differs from the query's in low to high bits, in some table."""
        j = np.arange(self.m)[:, None]
        value = query.astype(np.int64)[:, None] ^ _FLIPPED[None, _FROM[low] : _FROM[high + 1]]
        begin = self.starts[j, value]
        size = (self.starts[j, value + 1] - begin).ravel()
        begin = (begin + j * self.n).ravel()
        some = np.flatnonzero(size)
        begin, size = begin[some], size[some]
        return self.codes[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def retrieved(self, query: np.ndarray, flips: int, enough: int) -> np.ndarray:
        """The codes that differ from the query in `flips` bits at most in some substring; more bits where these are too few."""
        seen = np.zeros(self.n, bool)
        low, high = 0, min(flips, SUB)
        while True:
            seen[self.probed(query, low, high)] = True
            found = np.flatnonzero(seen)
            if len(found) >= min(enough, self.n):
                return found
            low = high = high + 1


def _search(k: int, model, flips: int, enough: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"qh": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object), "seen": pd.Series(dtype="int64")})
        mean, matrix = model.value
        x, q = (np.stack(v.to_numpy()).astype(np.float64) for v in (shard["v"], queries["v"]))
        ids = shard["ids"].to_numpy()
        index, code = Index(encode(x, mean, matrix)), encode(q, mean, matrix)
        want, out = min(k + 1, len(x)), []
        for i in range(len(q)):
            c = found = index.retrieved(code[i], flips, enough)
            score = x[c] @ q[i]
            if len(c) > want:  # all that tie with the last one wanted stay
                cut = np.partition(score, len(c) - want)[len(c) - want]
                c, score = c[score >= cut], score[score >= cut]
            n = [len(ids[j]) for j in c]
            s, v = np.repeat(score, n), np.concatenate([ids[j] for j in c])
            o = np.lexsort((v, -s))[: k + 1]
            out.append((queries["qh"].iat[i], v[o], s[o], len(found)))
        return pd.DataFrame(out, columns=["qh", "ids", "scores", "seen"])

    return run


def searched(spark: SparkSession, df: DataFrame, every: int, key: str = "vec_id", vector: str = "embedding", k: int = K, flips: int = FLIPS, enough: int = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """(asked, best): (id, h) of the queries, and for each vector hash h (qh, best array<struct<m, id>>, seen, n): the
    nearest of all rows, itself included, the entries that were retrieved, and all entries."""
    session(spark)
    whole = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    number = F.transform("v", lambda e: e.cast("double"))
    ok = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall(number, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(number, lambda e: e != 0)
    good = whole.where(ok)
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = sizes[0]["n"] if sizes else 0
    good = written(spark, good.where(F.size("v") == dims).withColumn("h", F.xxhash64("v")), "vectors")

    sample = good.orderBy("h").limit(SAMPLE).select("v").toPandas()["v"]
    x = np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, max(dims, 1)))
    model = spark.sparkContext.broadcast(learn_rotations(x))

    first = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    entries = good.dropDuplicates(["id", "h"]).withColumn("r", first).where(F.col("r") <= k + 1).groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    entries = written(spark, entries, "entries")
    asked = written(spark, good.where(F.col("id") % every == 0).select("id", "h").distinct(), "asked")
    query = written(spark, entries.join(asked.select("h").distinct(), "h", "left_semi").select(F.col("h").alias("qh"), "v"), "queries")
    n = entries.count()
    n_shards, n_blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-query.count() // BLOCK_ROWS))
    shards = entries.withColumn("s", F.pmod(F.hash("h"), F.lit(n_shards))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = query.withColumn("b", F.pmod(F.hash("qh"), F.lit(n_blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    found = shards.groupBy("s", "b").cogroup(blocks.groupBy("s", "b")).applyInPandas(_search(k, model, flips, enough), "qh long, ids array<long>, scores array<double>, seen long")
    pair = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("m"), x["ids"].alias("id")))
    best = found.groupBy("qh").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pair))), 1, k + 1).alias("best"), F.sum("seen").alias("seen"))
    return asked, written(spark, best.withColumn("n", F.lit(n)), "best")


def nearest(spark: SparkSession, df: DataFrame, every: int, key: str = "vec_id", vector: str = "embedding", k: int = K, flips: int = FLIPS, enough: int = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows by inner product."""
    asked, best = searched(spark, df, every, key, vector, k, flips, enough)
    rows = asked.join(best, asked["h"] == best["qh"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return rows.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.m")).alias("score"))
