"""Exact-substring deduplication with a common-prefix interval tree over an enhanced suffix array.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document. Strings are judged on the input and never cross documents.

How equal strings meet without one global array:

1. Every window of `length` bytes belongs to the segment of its minimiser (the least hash of the window's grams),
   so equal windows lie in segments of the same minimiser. A segment is a run of windows with one minimiser.
2. Each task sends, for each distinct segment content, only its first occurrence (map-side combine: a passage that a
   third of all documents share is sent once per task); its later occurrences are whole repeats already.
3. By minimiser, the first occurrence over all tasks stays; the others are whole repeats. A minimiser of which a task
   holds more than MANY contents is hot there: its segments go out by minimiser and content, to many tasks, and the
   minimiser's own task is told, so that it takes the segments which other tasks sent it for hot too.
4. Minimisers with several distinct segment contents (the rims of passages, edited copies), and segments that hold
   their minimiser twice (runs and periods, which may repeat inside themselves), go, with their bytes, into an enhanced suffix array: ranks by prefix doubling, longest common prefixes by the ladder of ranks, a stack scan
   that yields the common-prefix intervals, of which the left-diverse ones are the maximal repeats, with all
   occurrences. All occurrences of a group but the first are removed.
5. Segments of hot minimisers, and of those with more bytes than half an array, are cut finer before that: a window
   stands at some distance from the next occurrence of its minimiser, STEP distances make a piece, and all windows of
   a piece cover some bytes in common. Equal windows agree on minimiser, piece and those bytes, so their hash is the
   key by which pieces meet, in arrays of their own, spread over all tasks. Of pieces with one content each task again
   sends the first. What is still too much for an array differs in fewer than STEP bytes at either end; there, each
   window is compared by its hash.

Nulls and edge cases: a null text is empty; documents under `length` bytes keep everything; rows with a null doc_id
take no part and are kept whole; rows that repeat a doc_id are one document for the order, so that a span removed in
one is removed in each (clipped to its length); of equal strings the one in the smaller doc_id, then at the earlier
place, stays; a very long text is worked through as one block; an empty table gives no rows; other columns are ignored,
or carried along where `keep` names them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, session, text_arrays, text_blocks, written

LENGTH = 100
GRAM = 16
#: Segments that a task holds before it combines and sends them.
FLUSH = 400_000
#: Bytes of one suffix array; it takes about 130 times as many to build.
ARRAY_BYTES = 1 << 19
#: Contents of one minimiser in a task's segments above which it is hot.
MANY = 256
#: Distances from the minimiser that make a piece of a hot segment.
STEP = 4
#: Bytes of pieces that a task holds before it combines and sends them.
PIECE_BYTES = 4 << 20
TABLE = 2048  # powers of the hash's base in a table
SYMBOLS = 7  # of 9 bits in a word of the first rank

_TAB = np.random.default_rng(20240229).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h, n, p = _TAB[raw], 1, _BASE
    while n < GRAM:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % (1 << 64), n * 2
    return _mix(h)


def _slide_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: n - width], h[width - n :]) if n < width else h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the power of i is low[i % TABLE] * high[i // TABLE], for i up to n; no array of n powers is held."""
    return _powers(base, TABLE), _powers(pow(base, TABLE, 1 << 64), n // TABLE + 1)


def range_hash(raw: np.ndarray):
    """A function (starts, ends) -> hashes of those byte ranges, equal for equal bytes wherever they stand."""
    n = len(raw)
    low, high = _power_tables(_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    sums, whole = total[1:], n - n % TABLE
    np.take(_TAB, raw, out=sums, mode="clip")
    rows = sums[:whole].reshape(-1, TABLE)
    rows *= low
    rows *= high[: len(rows), None]
    sums[whole:] *= low[: n - whole] * high[len(rows)]
    np.cumsum(sums, out=sums)
    low, high = _power_tables(_INV, n)
    return lambda start, end: _mix((total[end] - total[start]) * (low[start % TABLE] * high[start // TABLE])) ^ (end - start).astype(np.uint64)


def segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document index, start in the document, bytes, minimiser, content hash) of each segment of a block."""
    return _segments(raw, off, length)[:5]


def _segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """segments(), and whether each has several windows and its minimiser twice: only then can two of its windows be equal."""
    n = len(raw) - length + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if n <= 0:
        return none
    grams = _gram_hashes(raw)
    least = _slide_min(grams, length - GRAM + 1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    valid = doc[:n] == doc[length - 1 :]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return none
    last = np.flatnonzero(valid & np.append(~valid[1:], True))
    end = np.minimum(np.append(start[1:] - 1, n - 1), last[np.searchsorted(last, start)]) + length
    d = doc[start]
    # a gram is the least of some window around it where the largest of their least ones, ~ the least of their ~, is itself
    edge = np.full(length - GRAM, ~np.uint64(0))
    hits = np.flatnonzero(~_slide_min(np.concatenate([edge, ~least, edge]), length - GRAM + 1) == grams)
    at = np.searchsorted(hits, start)
    held = np.searchsorted(hits, end - GRAM, side="right") - at
    which = np.repeat(np.arange(len(start)), held)
    hit = hits[np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held) + at[which]]
    twice = np.bincount(which[grams[hit] == least[start][which]], minlength=len(start)) > 1
    return d, start - off[d], end - start, least[start], range_hash(raw)(start, end), twice & (end - start > length)


def pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray, minimiser: np.ndarray, length: int, hashed) -> tuple[np.ndarray, ...]:
    """(segment index, start, bytes, key, content hash) of the pieces of segments of a block, each of STEP windows at most.

    Windows without the minimiser, which only another text of the same doc_id has there, are in no piece.
    """
    grams = _gram_hashes(raw)

    def laid(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(n)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[which]

    which, at = laid(end - start - GRAM + 1)
    hit = np.flatnonzero(grams[at] == minimiser[which])
    first = np.cumsum(end - start - GRAM + 1) - (end - start - GRAM + 1)
    which, w = laid(end - start - length + 1)
    place = first[which] + w - start[which]
    gram = np.append(hit, len(at) + length)[np.searchsorted(hit, place)]  # the next occurrence, which the window holds
    held = gram <= place + length - GRAM
    which, w = which[held], w[held]
    if not len(w):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = at[gram[held]]
    piece = (anchor - w) // STEP
    new = np.append(True, (which[1:] != which[:-1]) | (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(w)) - 1
    which, w, stop, anchor, piece = which[begin], w[begin], w[last] + length, anchor[begin], piece[begin]
    common = anchor - piece * STEP
    key = _mix(minimiser[which] * np.uint64(_BASE) + hashed(common, common - STEP + 1 + length) + piece.astype(np.uint64))
    return which, w, stop - w, key, hashed(w, stop)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of touching intervals per document, in order."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    first = np.append(True, doc[1:] != doc[:-1])
    # running maximum of ends inside each document: shift each document's ends above those before
    rank = np.cumsum(first) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    new = first | np.append(True, start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(reach, at)


def _blob_batch(parts: dict[int, dict[str, np.ndarray]]) -> pa.RecordBatch:
    keys = list(parts)
    cols = {"part": pa.array(keys, pa.int32())}
    for c in parts[keys[0]]:
        cols[c] = pa.array([parts[k][c].tobytes() for k in keys], pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether a group of equal keys begins, the group's first entry) of entries by keys, then by place."""
    o = np.lexsort((start, doc, *keys[::-1]))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[o[1:]] != k[o[:-1]]
    return o, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _dealt(n_parts: int, *lists: tuple[np.ndarray, dict[str, np.ndarray]]) -> pa.RecordBatch | None:
    """One row for each part that has something: the columns of each list, cut by its array of parts."""
    cuts = []
    for part, cols in lists:
        o = np.argsort(part, kind="stable")
        cuts.append((np.searchsorted(part[o], np.arange(n_parts + 1)), {k: v[o] for k, v in cols.items()}))
    out = {}
    for p in np.unique(np.concatenate([part for part, _ in lists])).tolist():
        out[p] = {k: v[cut[p] : cut[p + 1]] for cut, cols in cuts for k, v in cols.items()}
    return _blob_batch(out) if out else None


def _part(key: np.ndarray, n_parts: int) -> np.ndarray:
    return (key % np.uint64(n_parts)).astype(np.int64)


def _scan(length: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush():
            d, s, n, m, c, rep = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o, first, head = _firsts((m, c), d, s)
            d, s, n, m, c, rep = d[o], s[o], n[o], m[o], c[o], rep[o]
            again = (d != d[head]) | (s != s[head])
            rd, rs, re = merged(d[again], s[again], (s + n)[again])
            d, s, n, m, c, rep = d[first], s[first], n[first], m[first], c[first], rep[first]
            at = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            kinds = np.diff(np.append(at, len(m)))
            hot = np.repeat(kinds > MANY, kinds)
            told = m[at[kinds > MANY]]
            part = _part(np.where(hot, _mix(m ^ (c * np.uint64(_BASE))), m), n_parts)
            return _dealt(n_parts, (part, {"m": m, "c": c, "d": d, "s": s, "n": n.astype(np.int32), "hot": hot, "rep": rep}), (_part(told, n_parts), {"told": told}), (rd % n_parts, {"rd": rd, "rs": rs, "re": re}))

        for rows, raw, off in text_blocks(batches, "text"):
            d, s, n, m, c, rep = _segments(raw, off, length)
            if len(d):
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                held.append((ids[d], s, n, m, c, rep))
                count += len(d)
            if count >= FLUSH:
                count = 0
                yield flush()
        if held:
            yield flush()

    return run


def _column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(text_arrays(batch.column(batch.schema.get_field_index(name)))[0].tobytes(), kind)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict) -> dict[str, np.ndarray]:
    got = {k: [] for k in kinds}
    for batch in batches:
        for k, t in kinds.items():
            got[k].append(_column(batch, k, t))
    return {k: np.concatenate(v) if v else np.empty(0, kinds[k]) for k, v in got.items()}


def _rows(doc, start, end, minimiser=None, hot=None) -> Iterator[pa.RecordBatch]:
    """Spans; those with a minimiser are still to be compared."""
    todo = minimiser is not None
    minimiser, hot = (minimiser, hot) if todo else (np.zeros(len(doc), np.uint64), np.zeros(len(doc), bool))
    for i in range(0, len(doc), 200_000):
        j = slice(i, i + 200_000)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[j], pa.int64()), "s": pa.array(start[j], pa.int64()), "e": pa.array(end[j], pa.int64()), "m": pa.array(minimiser[j].view(np.int64), pa.int64()), "todo": pa.array(np.full(len(doc[j]), todo), pa.bool_()), "hot": pa.array(hot[j], pa.bool_())})


def _settle(length: int):
    return lambda batches: _settled(batches, length)


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of one part: whole repeats of a segment go; first occurrences of contested minimisers stay to be compared."""
    x = _gathered(batches, {"m": np.uint64, "c": np.uint64, "d": np.int64, "s": np.int64, "n": np.int32, "hot": bool, "rep": bool, "told": np.uint64, "rd": np.int64, "rs": np.int64, "re": np.int64})
    m, c, d, s, n, hot, rep = (x[k] for k in ("m", "c", "d", "s", "n", "hot", "rep"))
    rd, rs, re = [x["rd"]], [x["rs"]], [x["re"]]
    if len(m):
        o, first, head = _firsts((m, c), d, s)
        m, c, d, s, n, hot, rep = m[o], c[o], d[o], s[o], n[o], hot[o], rep[o]
        again = (d != d[head]) | (s != s[head])
        rd.append(d[again]), rs.append(s[again]), re.append((s + n)[again])
        # a content that some task sent as hot is hot; so is all of a minimiser of which this task was told
        hot = np.logical_or.reduceat(hot, np.flatnonzero(first))
        m, d, s, n, rep = m[first], d[first], s[first], n[first].astype(np.int64), rep[first]
        at = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        kinds = np.diff(np.append(at, len(m)))
        hot |= np.isin(m, x["told"]) | np.repeat((np.add.reduceat(n, at) > ARRAY_BYTES // 2) & (kinds > 1), kinds)
        # a segment that holds its minimiser twice may repeat inside itself
        todo = hot | np.repeat(kinds > 1, kinds) | rep
        yield from _rows(d[todo], s[todo], (s + n)[todo], m[todo], hot[todo])
    yield from _rows(*merged(np.concatenate(rd), np.concatenate(rs), np.concatenate(re)))


def _cut_out(length: int, n_parts: int):
    """The bytes of contested segments, and of the pieces of hot ones, by part of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, c, d, s, n = (np.concatenate(x) for x in list(zip(*held))[:5])
            raw = np.concatenate([x[5] for x in held])
            held.clear()
            base = np.cumsum(n) - n
            o, first, head = _firsts((key, c), d, s)
            again = (d[o] != d[o][head]) | (s[o] != s[o][head])
            gone = merged(d[o][again], s[o][again], (s + n)[o][again])
            o = o[first]
            key, d, s, n, base = key[o], d[o], s[o], n[o], base[o]
            # bytes have a list of their own: one part for each byte, in the order of the segments
            part = _part(key, n_parts)
            order = np.argsort(part, kind="stable")
            key, d, s, n, base, part = key[order], d[order], s[order], n[order], base[order], part[order]
            flat = raw[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            return _dealt(n_parts, (part, {"m": key, "d": d, "s": s, "n": n}), (np.repeat(part, n), {"b": flat}), (gone[0] % n_parts, dict(zip(("rd", "rs", "re"), gone))))

        for rows, raw, off in text_blocks(batches, "text"):
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            lists = rows.column(rows.schema.get_field_index("todo"))
            cnt = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            s, e, m, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            r = np.repeat(np.arange(len(ids)), cnt)
            ok = (off[r] + e) <= off[r + 1]  # rows that repeat a doc_id may be shorter
            s, e, m, hot, r = s[ok], e[ok], m[ok].view(np.uint64), hot[ok], r[ok]
            hashed = range_hash(raw)
            for some in (~hot, hot):
                if not some.any():
                    continue
                sr, ss, se, sm = r[some], (off[r] + s)[some], (off[r] + e)[some], m[some]
                if some is hot:
                    which, ss, n, key, c = pieces(raw, ss, se, sm, length, hashed)
                    sr = sr[which]
                else:
                    # cold segments are first occurrences, so only rows that repeat a doc_id have one content twice
                    n, key, c = se - ss, sm, hashed(ss, se)
                for i, j in _spans(n, PIECE_BYTES):
                    p = slice(i, j)
                    got = raw[np.repeat(ss[p] - (np.cumsum(n[p]) - n[p]), n[p]) + np.arange(n[p].sum())]
                    held.append((key[p], c[p], ids[sr[p]], ss[p] - off[sr[p]], n[p], got))
                    size += len(got)
                    if size >= PIECE_BYTES:
                        size = 0
                        yield flush()
        if held:
            yield flush()

    return run


def _spans(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to the limit at most, or of one entry."""
    total, i = np.append(0, np.cumsum(sizes)), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def suffix_intervals(raw: np.ndarray, lens: np.ndarray, length: int, doc: np.ndarray, start: np.ndarray):
    """Enhanced suffix array over strings laid end to end, and its maximal repeats of at least `length` bytes.

    doc and start say where each string stands. Returns the positions (suffixes with at least `length` bytes left in
    their string, in suffix order); the maximal repeats as (common prefix, first entry, last entry), whose occurrences
    are all entries between; and (entry, common prefix) for each occurrence that is not the first of the deepest
    repeat which holds an earlier one. An interval hands only its earliest occurrence to the interval around it, so
    the last list has at most as many items as there are entries, however deep the tree.
    """
    n = len(raw)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(n)  # bytes to the string's end
    word = raw.astype(np.uint64) + np.uint64(1)
    for k, symbols in ((1, 1), (2, 2), (4, SYMBOLS - 4)):  # words of k symbols, and as many or fewer of those that follow
        after = np.where(left[: n - k] > k, word[k:] >> np.uint64(9 * (k - symbols)), 0) if n > k else word[:0]
        word <<= np.uint64(9 * symbols)
        word[: len(after)] |= after
    open_ = np.argsort(word)
    new = np.append(True, word[open_[1:]] != word[open_[:-1]])
    rank = np.empty(n, np.int32)  # of a class: the place of its first suffix
    rank[open_] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth, ladder = SYMBOLS, [(SYMBOLS, rank)]
    while True:
        # only classes of several suffixes, some of which go on beyond this depth, can still split; open_ has them in order
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(open_)))
        open_ = open_[np.repeat((size > 1) & np.logical_or.reduceat(left[open_] > depth, at), size)]
        if not len(open_):
            break
        after = np.where(left[open_] > depth, rank[np.minimum(open_ + depth, n - 1)].astype(np.int64) + 1, 0)
        old = rank[open_].astype(np.int64)
        key = old * (n + 1) + after
        o = np.argsort(key)
        key, old, open_ = key[o], old[o], open_[o]
        at = np.arange(len(o))
        new = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(new, at, 0))
        home = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank = rank.copy()
        rank[open_] = old + group - home
        depth *= 2
        ladder.append((depth, rank))
    sa = np.flatnonzero(left >= length)
    sa = np.sort(rank[sa].astype(np.int64) * n + sa) % n
    if len(sa) < 2:
        return sa, [], []
    # neighbours of one class at the greatest depth up to `length`; no others have that many bytes in common
    alike = next((r for d, r in reversed(ladder) if d <= length), None)
    pairs = np.flatnonzero(alike[sa[1:]] == alike[sa[:-1]]) if alike is not None else np.arange(len(sa) - 1)
    a, b = sa[pairs], sa[pairs + 1]
    room = np.minimum(left[a], left[b])
    lcp = np.zeros(len(a), np.int64)
    for d, r in reversed(ladder):
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        same = (lcp < room) & (r[x] == r[y])
        lcp = np.minimum(lcp + d * same, room)
    for _ in range(SYMBOLS - 1):
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += (lcp < room) & (raw[x] == raw[y])
    before = np.where(left[np.maximum(sa - 1, 0)] == 1, -1 - np.arange(len(sa)), raw[np.maximum(sa - 1, 0)].astype(np.int64))
    before[sa == 0] = -1 - len(sa)
    differs = np.append(0, np.cumsum(before[1:] != before[:-1]))
    groups: list[tuple[int, int, int]] = []
    later: list[tuple[int, int]] = []
    stack: list[list] = []  # open intervals, prefixes rising: prefix, first entry, earliest occurrence, those after it

    def join(top: list, best: int) -> None:
        if place[best] < place[top[2]]:
            top[2], best = best, top[2]
        top[3].append(best)

    def close(top: list, end: int) -> None:
        if diff[end] > diff[top[1]]:
            groups.append((top[0], top[1], end))
            later.extend([(x, top[0]) for x in top[3] if place[x] > place[top[2]]])

    long_ = np.flatnonzero(lcp >= length)
    near, lcp = pairs[long_], lcp[long_]
    if len(near):
        # of a run of them whose suffixes all follow one byte, no interval is left-diverse
        at = np.flatnonzero(np.append(True, near[1:] != near[:-1] + 1))
        size = np.diff(np.append(at, len(near)))
        diverse = np.repeat(differs[near[at] + size] > differs[near[at]], size)
        near, lcp = near[diverse], lcp[diverse]
    base = np.append(0, ends[:-1])
    met = np.union1d(near, near + 1)
    which = np.searchsorted(base, sa[met], side="right") - 1
    doc, start = doc[which], start[which] + sa[met] - base[which]
    o = np.lexsort((start, doc))
    doc, start = doc[o], start[o]
    order = np.empty(len(met), np.int64)
    order[o] = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))[: len(o)])  # one place is as early as itself
    diff, place = dict(zip(met.tolist(), differs[met].tolist())), dict(zip(met.tolist(), order.tolist()))
    last, first, best = -2, 0, 0  # first and best: of the subtree left of the present prefix
    for i, v in zip(near.tolist(), lcp.tolist()):
        if i != last + 1:
            while stack:
                top = stack.pop()
                join(top, best)
                close(top, last + 1)
                best = top[2]
            first = best = i
        while stack and stack[-1][0] > v:
            top = stack.pop()
            join(top, best)
            close(top, i)
            first, best = top[1], top[2]
        if stack and stack[-1][0] == v:
            join(stack[-1], best)
        else:
            stack.append([v, first, best, []])
        first = best = i + 1
        last = i
    while stack:
        top = stack.pop()
        join(top, best)
        close(top, last + 1)
        best = top[2]
    return sa, groups, later


def _same_windows(raw: np.ndarray, size: np.ndarray, length: int, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, end) of all windows of strings laid end to end but the first of each content; for a few windows a string."""
    n = size - length + 1
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[which] + inside
    d, s = doc[which], start[which] + inside
    o, _, head = _firsts((range_hash(raw)(at, at + length),), d, s)
    d, s = d[o], s[o]
    again = (d != d[head]) | (s != s[head])
    return d[again], s[again], s[again] + length


def _groups(length: int):
    """Of one part: every occurrence but the first, of each maximal repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _gathered(batches, {"m": np.uint64, "d": np.int64, "s": np.int64, "n": np.int64, "b": np.uint8, "rd": np.int64, "rs": np.int64, "re": np.int64})
        yield from _rows(*merged(x["rd"], x["rs"], x["re"]))
        if not len(x["m"]):
            return
        # equal windows have one key, so whole keys at a time, up to a size, make an array of their own
        o = np.argsort(x["m"], kind="stable")
        m, d, s, n = (x[k][o] for k in "mdsn")
        base = (np.cumsum(x["n"]) - x["n"])[o]
        ends = np.append(np.flatnonzero(m[1:] != m[:-1]) + 1, len(m))
        total = np.append(0, np.cumsum(n))
        lo, k = 0, 0
        while lo < len(m):
            k = max(k, int(np.searchsorted(total[ends], total[lo] + ARRAY_BYTES, side="right")) - 1)
            while ends[k] <= lo:
                k += 1
            hi = int(ends[k])
            part = slice(lo, hi)
            size = n[part]
            lo = hi
            if len(size) == 1 and size[0] <= length:
                continue
            at = np.append(0, np.cumsum(size))
            raw = x["b"][np.repeat(base[part] - at[:-1], size) + np.arange(at[-1])]
            if at[-1] > ARRAY_BYTES and size.max() < length + STEP:
                yield from _rows(*merged(*_same_windows(raw, size, length, d[part], s[part])))
                continue
            sa, _, later = suffix_intervals(raw, size, length, d[part], s[part])
            if later:
                entry, prefix = np.array(later, np.int64).T
                which = np.searchsorted(at, sa[entry], side="right") - 1
                doc, pos = d[part][which], s[part][which] + sa[entry] - at[which]
                yield from _rows(*merged(doc, pos, pos + prefix))

    return run


_SPANS = "doc_id long, s long, e long, m long, todo boolean, hot boolean"


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans array<struct<s, e>>) of bytes that a `length`-byte string covers which starts earlier; spans may touch or overlap."""
    session(spark)
    n = partitions(spark, docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    scan = d.mapInArrow(_scan(length, n), "part int, m binary, c binary, d binary, s binary, n binary, hot binary, rep binary, told binary, rd binary, rs binary, re binary")
    settled = written(spark, scan.repartition(n, "part").mapInArrow(_settle(length), _SPANS), "segments")
    todo = settled.where("todo").groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "m", "hot")).alias("todo"))
    bytes_ = d.join(todo, "doc_id").select("doc_id", "text", "todo").mapInArrow(_cut_out(length, n), "part int, m binary, d binary, s binary, n binary, b binary, rd binary, rs binary, re binary")
    compared = written(spark, bytes_.repartition(n, "part").mapInArrow(_groups(length), _SPANS), "repeats")
    return settled.where("not todo").unionByName(compared).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _judge(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in text_blocks(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("spans"))
            flat = lists.flatten()
            cnt = np.asarray([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            r = np.repeat(np.arange(len(cnt)), cnt)
            size = np.diff(off)
            s = np.minimum(flat.field(0).to_numpy(zero_copy_only=False), size[r]) + off[r]
            e = np.minimum(flat.field(1).to_numpy(zero_copy_only=False), size[r]) + off[r]
            step = np.zeros(len(raw) + 1, np.int64)
            np.add.at(step, s, 1)
            np.add.at(step, e, -1)
            gone = np.cumsum(step[:-1]) > 0
            begins = gone.copy()
            inner = np.ones(len(raw), bool)
            inner[off[:-1][size > 0]] = False
            begins[1:] &= ~gone[:-1] | ~inner[1:]
            lost = np.append(0, np.cumsum(gone))
            spans = np.append(0, np.cumsum(begins))
            kept = raw[~gone]
            at = off - lost[off]
            texts = [kept[at[i] : at[i + 1]].tobytes() for i in range(len(size))]
            cols = [rows.column(0), pa.array(size, pa.int64()), pa.array(np.diff(lost[off]), pa.int64()), pa.array(np.diff(spans[off]), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()))
                names.append("kept_text")
                extra = [c for c in rows.schema.names if c.startswith("_x_")]
                cols += [rows.column(rows.schema.get_field_index(c)) for c in extra]
                names += extra
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `keep` also kept_text and those columns.

    kept_text decodes the remaining bytes as UTF-8 and leaves out halves of characters at a cut. A kept column with the
    name of one of these is left out.
    """
    keep = None if keep is None else [c for c in keep if c not in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    spans = repeated_spans(spark, docs, length)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *[F.col(c).alias(f"_x_{c}") for c in keep or []]]
    both = docs.select(*cols).join(spans, "doc_id", "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep is not None:
        out += ", kept_text string" + "".join(f", `_x_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    got = both.mapInArrow(_judge(keep is not None), out)
    return got.select(*[c for c in got.columns if not c.startswith("_x_")], *[F.col(f"_x_{c}").alias(c) for c in keep or []]) if keep is not None else got
