"""MinHash near-duplicate detection with tensored banding.

Two collections of SIDE small bands each (BAND minhashes a band) stand for SIDE * SIDE tables: the key of table (i, j)
is the pair of band i of the first and band j of the second collection, so 2 * SIDE * BAND minhashes do the work of
SIDE * SIDE * 2 * BAND. With 14 bands of 4 a pair at similarity 0.80 meets in some table with probability 0.9987,
one at 0.85 with 0.9999.

1. One pass makes each document's set of distinct shingles, its digest and its bands. Equal sets are one class.
2. Classes that share a table key are linked to the least of them (a star, not all pairs); a task first combines its
   own rows, so that of a hot group it sends only the least class of each key. Stars give rough groups.
3. In each rough group all pairs are compared on full sets: a large group is cut into blocks of bounded size, and each
   pair of blocks is one piece of work that hands on a spanning forest of its links.
4. Components of the links, handed back to all copies of a class.

Nulls and edge cases: null and blank texts have no shingle and are linked with nothing; with fewer than five words the
whole sequence is the one shingle; rows with a null doc_id take no part (null component, kept); rows that repeat a
doc_id are one document: one vertex, linked by any of its texts; a component is named by its smallest doc_id; a very
long text is one block of work; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import partitions, session, text_arrays, text_blocks, written

WORDS = 5
PERCENT = 80
SIDE = 14
BAND = 4
#: Shingles of a block of a rough group.
BLOCK_SHINGLES = 2_000_000
#: Documents that a task holds before it combines their keys.
FLUSH = 30_000
#: Cells of a table of shared shingles, and postings, that are looked at together.
CELLS = 1_000_000
_DOC_BITS = 10

_rng = np.random.default_rng(97531)
_TAB = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 62, 2 * SIDE * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a block, offsets of each document's words)."""
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[:-1] < off[1:]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TAB[_LOWER[raw]] * _powers(_BASE, len(raw)), dtype=np.uint64, out=total[1:])
    h = _mix((total[end] - total[start]) * _powers(_INV, len(raw) + 1)[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes document by document, offsets); hashes have 54 bits."""
    h, at = word_hashes(raw, off)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    n = len(h) - WORDS + 1
    sets = []
    if n > 0:
        x = h[:n].copy()
        for k in range(1, WORDS):
            x = x * np.uint64(_BASE) + h[k : k + n]
        same = doc[:n] == doc[WORDS - 1 :]
        sets.append((doc[:n][same], x[same]))
    for d in np.flatnonzero((count > 0) & (count < WORDS)):
        x = np.uint64(0)
        for w in h[at[d] : at[d + 1]]:
            x = np.uint64((int(x) * _BASE + int(w)) & (2**64 - 1))
        sets.append((np.array([d]), np.array([x], np.uint64) + np.uint64(count[d])))
    if not sets:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    d, x = (np.concatenate(v) for v in zip(*sets))
    keep = np.uint64(64 - _DOC_BITS)
    key = np.sort((d.astype(np.uint64) << keep) | (_mix(x) >> np.uint64(_DOC_BITS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & np.uint64((1 << (64 - _DOC_BITS)) - 1), np.searchsorted(key >> keep, np.arange(len(off)).astype(np.uint64))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of as many documents as _DOC_BITS can number."""
    for b in batches:
        for i in range(0, b.num_rows, 1 << _DOC_BITS):
            yield b.slice(i, 1 << _DOC_BITS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, off in text_blocks(_small(batches), "text"):
        sets, at = shingle_sets(raw, off)
        size = np.diff(at)
        some = np.flatnonzero(size)
        n = len(size)
        d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        bands = np.zeros((n, 2 * SIDE), np.uint64)
        if len(some):
            begin = at[some]
            d1[some] = np.add.reduceat(_mix(sets), begin).view(np.int64)
            d2[some] = np.add.reduceat(_mix(sets ^ np.uint64(_INV)), begin).view(np.int64)
            for b in range(2 * SIDE):
                key = np.zeros(len(some), np.uint64)
                for r in range(BAND):
                    key = _mix(key * np.uint64(_BASE) + np.minimum.reduceat(sets * _MUL[b * BAND + r], begin))
                bands[some, b] = key
        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_shingles": pa.array(size, pa.int64()), "d1": pa.array(d1), "d2": pa.array(d2), "bands": pa.array([x.tobytes() if s else None for x, s in zip(bands, size)], pa.binary())})


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (first most significant), and where a new combination of all keys but the last begins."""
    o = np.lexsort(keys[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys[:-1]:
        new[1:] |= k[o[1:]] != k[o[:-1]]
    return o, new


def _combine(n_parts: int):
    """Star links of a task's own classes, and, for each first band, the classes that are least in some table."""

    def flush(ids: np.ndarray, bands: np.ndarray) -> pa.RecordBatch:
        links, sends = [], []
        for i in range(SIDE):
            first = bands[:, i]
            send = np.zeros(len(ids), bool)
            for j in range(SIDE, 2 * SIDE):
                o, new = _runs(first, bands[:, j], ids)
                head = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
                send[o[new]] = True
                links.append(np.stack([ids[o[~new]], ids[head[~new]]], 1))
            at = np.flatnonzero(send)
            sends.append((np.full(len(at), i), at))
        table, at = (np.concatenate(x) for x in zip(*sends))
        key = _mix(bands[at, table] + table.astype(np.uint64))
        links = np.unique(np.concatenate(links), axis=0)
        part = (key % np.uint64(n_parts)).astype(np.int64)
        lpart = links[:, 0] % n_parts
        out = {"part": [], "k": [], "d": [], "b": [], "links": []}
        for p in range(n_parts):
            m, lm = part == p, lpart == p
            if m.any() or lm.any():
                out["part"].append(p)
                out["k"].append(key[m].tobytes())
                out["d"].append(ids[at[m]].tobytes())
                out["b"].append(np.ascontiguousarray(bands[at[m], SIDE:]).tobytes())
                out["links"].append(np.ascontiguousarray(links[lm]).tobytes())
        return pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in out.items() if k != "part"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            raw, _ = text_arrays(b.column(1))
            held.append((b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(raw.tobytes(), np.uint64).reshape(-1, 2 * SIDE)))
            count += b.num_rows
            if count >= FLUSH:
                yield flush(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
        if count:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part: star links between the tasks' classes that share a table key; the tasks' own links are passed on."""
    keys, ids, seconds, links = [], [], [], [np.empty((0, 2), np.int64)]
    for b in batches:
        get = lambda c: text_arrays(b.column(b.schema.get_field_index(c)))[0].tobytes()  # noqa: B023, E731
        keys.append(np.frombuffer(get("k"), np.uint64))
        ids.append(np.frombuffer(get("d"), np.int64))
        seconds.append(np.frombuffer(get("b"), np.uint64).reshape(-1, SIDE))
        links.append(np.frombuffer(get("links"), np.int64).reshape(-1, 2))
    if keys:
        key, d, second = np.concatenate(keys), np.concatenate(ids), np.concatenate(seconds)
        u, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        m = cnt[inv] > 1
        key, d, second = key[m], d[m], second[m]
        for j in range(SIDE if len(d) else 0):
            o, new = _runs(key, second[:, j], d)
            head = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
            links.append(np.stack([d[o[~new]], d[head[~new]]], 1))
    out = np.unique(np.concatenate(links), axis=0)
    out = out[out[:, 0] != out[:, 1]]
    for i in range(0, len(out), 200_000):
        yield pa.RecordBatch.from_pydict({"a": pa.array(out[i : i + 200_000, 0]), "b": pa.array(out[i : i + 200_000, 1])})


def linked(sets: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Labels (the least index of the component) of sets, linked where 100 * intersection >= percent * union.

    Rows meet all others, until the rows that have not done so are all in one component: links between them would join
    nothing. So a group of copies that are alike costs a few rows, not the square of the group.
    """
    m = len(at) - 1
    size = np.diff(at)
    label = np.arange(m)
    if m < 2:
        return label
    owner = np.repeat(np.arange(m), size)
    u, inv, freq = np.unique(sets, return_inverse=True, return_counts=True)
    shared = freq[inv] > 1
    inv, owner = inv[shared], owner[shared]
    o = np.argsort(inv, kind="stable")  # postings: owners of each shingle, rising
    post, begin = owner[o], np.searchsorted(inv[o], np.arange(len(u) + 1))
    dense = np.flatnonzero(freq > max(32, m // 20))
    column = np.full(len(u), -1)
    column[dense] = np.arange(len(dense))
    row_at = np.searchsorted(owner, np.arange(m + 1))
    step, block = max(1, min(512, CELLS // m)), 16
    waiting = np.ones(m, bool)
    while True:
        todo = np.flatnonzero(waiting & (label != np.bincount(label[waiting], minlength=m).argmax()))
        if not len(todo):
            return label
        pick, block = todo[: min(step, block)], 2 * block
        waiting[pick] = False
        k = row_at[pick + 1] - row_at[pick]
        mine = np.repeat(row_at[pick] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
        rows, terms = np.repeat(np.arange(len(pick)), k), inv[mine]
        count = np.zeros(len(pick) * m, np.float32)
        rare = column[terms] < 0
        reps = freq[terms[rare]]
        for lo, hi in _chunks(reps, CELLS):
            t, r = terms[rare][lo:hi], rows[rare][lo:hi]
            k = reps[lo:hi]
            place = np.repeat(begin[t] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
            count += np.bincount(np.repeat(r, k) * m + post[place], minlength=len(count)).astype(np.float32)
        count = count.reshape(len(pick), m)
        for c in range(0, len(dense), 512):
            full = np.zeros((m, min(512, len(dense) - c)), np.float32)
            hit = (column[inv] >= c) & (column[inv] < c + 512)
            full[owner[hit], column[inv[hit]] - c] = 1
            count += full[pick] @ full.T
        both = np.rint(count).astype(np.int64)
        r, c = np.nonzero(100 * both >= percent * (size[pick, None] + size[None, :] - both))
        r = pick[r]
        while len(r):
            x, y = label[r], label[c]
            r, c = r[x != y], c[x != y]
            if not len(r):
                break
            pairs = np.unique(np.stack([np.minimum(label[r], label[c]), np.maximum(label[r], label[c])], 1), axis=0)
            # each label takes the least one it meets; then chains are followed to their ends
            to = np.arange(m)
            np.minimum.at(to, pairs[:, 1], pairs[:, 0])
            while (to[to] != to).any():
                to = to[to]
            label = to[label]


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    total, lo = np.append(0, np.cumsum(sizes)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, sizes = [], [], [], []
        for part, raw, off in text_blocks(_small(batches), "text"):
            s, at = shingle_sets(raw, off)
            group.append(np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1))
            ids.append(part.column(3).to_numpy(zero_copy_only=False))
            sets.append(s)
            sizes.append(np.diff(at))
        if not ids:
            return
        group, ids, sets, sizes = (np.concatenate(x) for x in (group, ids, sets, sizes))
        begin = np.append(0, np.cumsum(sizes))
        o = np.lexsort((ids, group[:, 2], group[:, 1], group[:, 0]))
        new = np.append(True, (group[o[1:]] != group[o[:-1]]).any(1))
        cut = np.append(np.flatnonzero(new), len(o))
        a, b = [], []
        for lo, hi in zip(cut, cut[1:]):
            mine = o[lo:hi]
            if len(mine) < 2:
                continue
            n = sizes[mine]
            at = np.append(0, np.cumsum(n))
            own = sets[np.repeat(begin[mine] - at[:-1], n) + np.arange(at[-1])]
            label = linked(own, at, percent)
            moved = label != np.arange(len(mine))
            a.append(ids[mine[moved]])
            b.append(ids[mine[label[moved]]])
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; component_id is the smallest doc_id reachable over links."""
    session(spark)
    n = partitions(spark, docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = written(spark, d.mapInArrow(_signatures, "doc_id long, n_shingles long, d1 long, d2 long, bands binary"), "signatures")
    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(spark, classes, "classes")
    sends = classes.select("rep", "bands").mapInArrow(_combine(n), "part int, k binary, d binary, b binary, links binary")
    stars = sends.repartition(n, "part").mapInArrow(_meet, "a long, b long")
    rough = written(spark, connected_components(spark, stars, "a", "b"), "rough")

    member = rough.join(classes, rough["node"] == classes["rep"]).select("node", "component", "n_shingles")
    blocks = member.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = member.join(blocks, "component").withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "component", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    # a doc_id that repeats brings all its texts
    work = d.join(placed, d["doc_id"] == placed["node"]).select("component", "i", "j", "doc_id", "text")
    links = work.repartition(n, "component", "i", "j").mapInArrow(_verify(percent), "a long, b long")
    final = written(spark, connected_components(spark, links, "a", "b"), "components")

    named = classes.join(final, classes["rep"] == final["node"], "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    named = written(spark, named, "named")
    own = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
