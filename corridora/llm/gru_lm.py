"""Language-model scoring with a gated recurrent network in numpy.

Words that are frequent in the training rows (HEAD of them at most) have an input vector each and stand in classes of
about equal frequency; the output is class-factored: a softmax over classes, then one over the words of the class. All
other words share a class, `rare`, inside which a word has its smoothed frequency, so every text has a proper
probability. The output biases start at the words' frequencies. Training is truncated back-propagation over windows,
in one pass over all training rows: each task goes on from the common weights over its own rows, and the weights are
averaged, weighted by tokens (one array a task, added up by COMBINE tasks). A task's texts are one stream, cut into
lanes of one length; the state is carried from window to window and cleared where a text begins. Scoring runs whole
documents side by side and carries the hidden state from window to window to the document's end.

Token counts cover all training rows and stay distributed: a histogram of the counts, of a bounded number of bins,
gives the count from which at most KNOWN words occur as often; those come to the driver and are broadcast (at most
KNOWN words of KNOWN_BYTES bytes), and the other words of a text are joined with the counts by a shuffle, once per
distinct word and row. Words that tie at the border of the histogram's bins are all in or all out.

Nulls and edge cases: a null or blank text is its end token alone; a null key counts as empty text for the folds;
repeated rows are scored each; a very long text is one lane and is scored to its end; with no training rows every token
is unknown; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, text_arrays, written

HEAD = 1024
#: Words whose counts are broadcast, at most; the first HEAD of them are the network's.
KNOWN = 65536
#: Counts up to here have a bin of their own; above, there are BINS bins a doubling.
EXACT = 1024
BINS = 64
#: Bytes up to which a word can be among them, which bounds what is broadcast.
KNOWN_BYTES = 64
CLASSES = 32
HIDDEN = 16
WINDOW = 16  # steps of truncated back-propagation
LANES = 512  # pieces of the stream of texts side by side in training, at most
STEPS = 64  # windows in a lane, at least, before there are more lanes
TOKENS = 500_000  # of a stream
SCORED_BYTES = 8 << 20  # of texts scored side by side
SCORED_LANES = 4096
RATE = 0.03
ROWS = 1024  # of a softmax at a time, which stay in the processor's cache
SAFE = 80.0  # exp of a number of this size, summed over HEAD words, is finite and above zero in single precision
COMBINE = 8  # tasks that add up the weights of all others
_END = b""  # no word is empty


def words(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split are ASCII-only: exactly A-Z, and space and \\x09-\\x0D."""
    return text.lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

    c: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            c.update(words(t or b""))
            c[_END] += 1
            if len(c) > 200_000:
                yield out(c)
                c = Counter()
    if c:
        yield out(c)


class Network:
    """Weights in one vector: input vectors, gates, class and word outputs."""

    def __init__(self, head: list[bytes], counts: list[int], rare: int):
        """head by falling count; rare: tokens outside the head, and one for each unseen word."""
        v, self.rare = len(head), len(head)
        self.end = head.index(_END) if _END in head else v
        total = sum(counts) + rare
        # classes of about equal mass, in order of frequency; the last one is for rare words
        mass = np.cumsum(counts) / max(sum(counts), 1) if v else np.zeros(0)
        raw = np.minimum((mass * (CLASSES - 1) - 1e-9).astype(int), CLASSES - 2) if v else np.zeros(0, int)
        self.cls = np.append(np.unique(raw, return_inverse=True)[1] if v else np.zeros(0, int), 0).astype(int)
        self.n_cls = int(self.cls[:v].max()) + 2 if v else 1
        self.cls[v] = self.n_cls - 1
        self.cls = self.cls.astype(np.uint8)
        self.first = np.searchsorted(self.cls, np.arange(self.n_cls + 1))
        h = HIDDEN
        self.shapes = {"E": (v + 1, 3 * h), "U": (h, 3 * h), "C": (h, self.n_cls), "c": (self.n_cls,), "W": (v + 1, h), "w": (v + 1,)}
        rng = np.random.default_rng(11)
        n = np.array([*counts, rare], np.float64)
        per_class = np.add.reduceat(n, self.first[:-1])
        start = {"E": rng.normal(0, 0.1, self.shapes["E"]), "U": rng.normal(0, 0.2, self.shapes["U"]), "C": np.zeros(self.shapes["C"]), "c": np.log(np.maximum(per_class, 1e-3) / max(total, 1)), "W": np.zeros(self.shapes["W"]), "w": np.log(np.maximum(n, 1e-3) / np.maximum(per_class[self.cls], 1e-3))}
        self.weights = np.concatenate([start[k].ravel() for k in self.shapes]).astype(np.float32)

    def parts(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = weights[at : at + n].reshape(s)
            at += n
        return out



def encode(ids: dict[bytes, int], tokens: list[bytes]) -> np.ndarray:
    """Places of the words and of the end among the known words, or len(ids)."""
    return np.fromiter(map(ids.get, chain(tokens, (_END,)), repeat(len(ids))), np.int32, len(tokens) + 1)


def _by_gate(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors and recurrent weights as (gate, row, HIDDEN), so that the numbers of a gate lie side by side."""
    return tuple(np.ascontiguousarray(p[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "EU")


def _step(p: dict, x: np.ndarray, h: np.ndarray, by_gate: tuple[np.ndarray, np.ndarray] | None = None):
    """One gated step for each lane: input word x, state h. Sigmoids are 0.5 * tanh(0.5 * x) + 0.5, in place."""
    e, u = by_gate or _by_gate(p)
    gates, u = e.take(x, axis=1), h @ u
    zr, n = gates[:2], gates[2]
    zr += u[:2]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr
    n += r * u[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return z, r, n, u[2], new


def _log_softmax(a: np.ndarray, y: np.ndarray, bound: float, slope: bool) -> np.ndarray:
    """Log-probability of the target y in each column of a, whose size is at most bound; with slope, a becomes its gradient."""
    cols = np.arange(len(y))
    if bound > SAFE:
        a -= a.max(0)
    target = a[y, cols]
    np.exp(a, out=a)
    total = a.sum(0)
    if slope:
        a *= 1 / total
        a[y, cols] -= 1
    return target - np.log(total)


def _outputs(net: Network, p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Log-probability of each target, by class and word; with grad also the gradient of h, and sums into grad."""
    cls, slope, k = net.cls[y], grad is not None, HIDDEN
    order = np.argsort(cls, kind="stable")
    y, cls = y[order], cls[order]
    # a row of ones takes the biases along
    h1 = np.ones((k + 1, len(y)), h.dtype)
    h1[:k] = h[order].T
    outer, inner = np.vstack([p["C"], p["c"]]).T, np.column_stack([p["W"], p["w"]])
    reach = max(1.0, float(np.abs(h).max(initial=0)))
    bounds = [reach * float(np.abs(w).sum(1).max()) for w in (outer, inner)]
    lp = np.empty(len(y), np.result_type(h, inner))
    dh = np.empty((len(y), k), lp.dtype) if slope else None
    for i in range(0, len(y), ROWS):
        rows = slice(i, i + ROWS)
        a = outer @ h1[:, rows]
        lp[rows] = _log_softmax(a, cls[rows], bounds[0], slope)
        if slope:
            d = a @ h1[:, rows].T
            grad["C"] += d[:, :k].T
            grad["c"] += d[:, k]
            dh[rows] = a.T @ outer[:, :k]
    cut = np.searchsorted(cls, np.arange(net.n_cls + 1))
    for c in np.flatnonzero(np.diff(cut)):
        words_ = slice(net.first[c], net.first[c + 1])
        if words_.stop - words_.start < 2:
            continue
        for i in range(cut[c], cut[c + 1], ROWS):
            rows = slice(i, min(i + ROWS, cut[c + 1]))
            a = inner[words_] @ h1[:, rows]
            lp[rows] += _log_softmax(a, y[rows] - words_.start, bounds[1], slope)
            if slope:
                d = a @ h1[:, rows].T
                grad["W"][words_] += d[:, :k]
                grad["w"][words_] += d[:, k]
                dh[rows] += a.T @ inner[words_, :k]
    out, back = np.empty_like(lp), np.empty_like(dh) if slope else None
    out[order] = lp
    if slope:
        back[order] = dh
    return out, back


def train_window(net: Network, p: dict, xs: np.ndarray, ys: np.ndarray, live: np.ndarray, h: np.ndarray, grad: dict, fresh: np.ndarray | None = None) -> np.ndarray:
    """Adds the gradients of one window (steps x lanes) and returns the state after it, cleared before the fresh steps."""
    k, trace, by_gate = HIDDEN, [], _by_gate(p)
    steps, lanes = xs.shape
    cleared = [np.flatnonzero(f) for f in fresh] if fresh is not None else [[]] * steps
    before = np.empty((steps, lanes, k), np.result_type(h, p["U"]))
    states = np.empty_like(before)
    for s, x in enumerate(xs):
        before[s] = h
        before[s, cleared[s]] = 0
        *gates, h = _step(p, x, before[s], by_gate)
        trace.append(gates)
        states[s] = h
    dhs = np.zeros_like(before)
    flat = dhs.reshape(-1, k)
    if live.all():
        flat[:] = _outputs(net, p, states.reshape(-1, k), ys.ravel(), grad)[1]
    else:
        rows = np.flatnonzero(live.ravel())
        flat[rows] = _outputs(net, p, states.reshape(-1, k)[rows], ys.ravel()[rows], grad)[1]
    back = by_gate[1].transpose(0, 2, 1)
    des, dus = np.empty((3, *before.shape), before.dtype), np.empty_like(before)  # dus: of the last gate's recurrent part
    dh = np.zeros((lanes, k), before.dtype)
    for s in range(steps - 1, -1, -1):
        (z, r, n, u), (dz, dr, dn), du, d = trace[s], des[:, s], dus[s], dhs[s]
        d += dh
        keep = 1 - z
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= keep
        dn *= d
        np.subtract(before[s], n, out=dz)
        dz *= z
        dz *= keep
        dz *= d
        np.multiply(dn, r, out=du)
        np.subtract(1, r, out=dr)
        dr *= u
        dr *= du
        dh = d * z
        dh += dz @ back[0]
        dh += dr @ back[1]
        dh += du @ back[2]
        dh[cleared[s]] = 0
    came = before.reshape(-1, k).T
    grad["U"] += np.hstack([came @ d.reshape(-1, k) for d in (des[0], des[1], dus)])
    met = xs.ravel().astype(np.min_scalar_type(net.rare))
    order = np.argsort(met, kind="stable")
    words_met, begin = np.unique(met[order], return_index=True)
    grad["E"][words_met] += np.add.reduceat(np.hstack([d.reshape(-1, k)[order] for d in des]), begin)
    return h


def train_rows(net: Network, weights: np.ndarray, texts: list[np.ndarray], rate: float) -> tuple[np.ndarray, int]:
    """Weights after one pass over the texts (as word ids with the end), and the tokens seen; RMS-scaled steps."""
    w, turn = weights.copy(), 0
    square = np.zeros_like(w)
    p = net.parts(w)
    flat = np.concatenate(texts)
    first = np.zeros(len(flat), bool)
    first[np.append(0, np.cumsum([len(t) for t in texts])[:-1])] = True
    lanes = max(1, min(LANES, len(flat) // (WINDOW * STEPS)))
    steps = -(-len(flat) // lanes)
    lay = lambda v, gap: np.append(v, np.full(steps * lanes - len(v), gap, v.dtype)).reshape(lanes, steps).T
    x, y = lay(np.where(first, net.end, np.append(net.end, flat[:-1])).astype(np.int32), net.end), lay(flat, net.end)
    fresh, live = lay(first, False), lay(np.ones(len(flat), bool), False)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for s in range(0, steps, WINDOW):
        part = slice(s, s + WINDOW)
        g = np.zeros_like(w)
        h = train_window(net, p, x[part], y[part], live[part], h, net.parts(g), fresh[part])
        g /= max(int(live[part].sum()), 1)
        square *= 0.95
        square += 0.05 * g * g
        turn += 1
        scale = square / (1 - 0.95**turn)
        np.sqrt(scale, out=scale)
        scale += 1e-4
        g *= rate
        g /= scale
        w -= g
    return w, len(flat)


def _weights_row(slot: int, w: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def _teach(model, rate: float):
    """Each task's weights after its rows, times its tokens, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, weights, ids = model.value
        w, total, held, size = weights, 0, [], 0

        def learn():
            nonlocal w, total, held, size
            w, n = train_rows(net, w, held, rate)
            total, held, size = total + n, [], 0

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(np.minimum(encode(ids, words(t or b"")), net.rare))
                size += len(held[-1])
                if size > TOKENS:
                    learn()
        if held:
            learn()
        if total:
            yield _weights_row(TaskContext.get().partitionId() % COMBINE, w.astype(np.float64) * total, total)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of weights, one at a time, as one row."""
    w, n = None, 0
    for b in batches:
        for x, k in zip(b.column(1), b.column(2).to_pylist()):
            x = np.frombuffer(x.as_buffer(), np.float64)
            w, n = x.copy() if w is None else w + x, n + k
    if n:
        yield _weights_row(0, w, n)


def _most_frequent(counts: DataFrame, limit: int) -> tuple[list[bytes], np.ndarray]:
    """The words that occur most often, with their counts: as many whole bins of counts as hold at most `limit` words."""
    short = counts.where(F.length("word") <= KNOWN_BYTES)
    size = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(EXACT + F.ceil(F.log2(F.col("n") / EXACT) * BINS)).cast("long")
    least, words_ = None, 0
    for r in sorted(short.groupBy(size.alias("b")).agg(F.min("n").alias("least"), F.count("*").alias("words")).collect(), key=lambda r: -r["b"]):
        words_ += r["words"]
        if words_ > limit:
            break
        least = r["least"]
    got = [(-r["n"], bytes(r["word"])) for r in short.where(F.col("n") >= least).collect()] if least is not None else []
    got.sort()
    return [w for _, w in got], np.array([-n for n, _ in got], np.int64)


def score_texts(net: Network, weights: np.ndarray, texts: list[np.ndarray], limit: int = 16384) -> np.ndarray:
    """Natural log-probability of each text (word ids with the end), without the share of words inside `rare`."""
    p = net.parts(weights)
    by_gate = _by_gate(p)
    out = np.zeros(len(texts))
    size = np.array([len(t) for t in texts])
    flat, begin = np.concatenate(texts), np.append(0, np.cumsum(size))[:-1]
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), SCORED_LANES):
        lanes = order[lo : lo + SCORED_LANES]
        lens, at = size[lanes], begin[lanes]
        # lanes fall by length, so the live ones come first
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        prev = np.full(len(lanes), net.end, np.int32)
        s = 0
        while s < lens[0]:
            # a window of steps: its states are kept, and its outputs are computed at once
            steps = min(max(1, limit // int(live[s])), int(lens[0]) - s)
            states, targets = [], []
            for t in range(s, s + steps):
                m = int(live[t])
                h = _step(p, prev[:m], h[:m], by_gate)[4]
                prev = flat[at[:m] + t]
                states.append(h)
                targets.append(prev)
            lp, _ = _outputs(net, p, np.concatenate(states), np.concatenate(targets))
            out[lanes] += np.bincount(np.concatenate([np.arange(len(x)) for x in targets]), lp, minlength=len(lanes))
            s += steps
    return out


def _gathered(batches: Iterator[pa.RecordBatch], limit: int = SCORED_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches put together up to a size; a larger batch stays alone."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def _scan(model, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, weights, ids, logs = model.value  # logs: log10(c + 1) by place, and 0 for unknown words
        none = len(ids)
        for part in _gathered(batches):
            coded, rare, sizes = [], [], [0]
            for t in part.column(len(extra)).to_pylist():
                ws = words(t or b"")
                x = encode(ids, ws)
                coded.append(x)
                ws.append(_END)
                rare += Counter(map(ws.__getitem__, np.flatnonzero(x == none).tolist())).items()
                sizes.append(len(rare))
            if not coded:
                continue
            n = np.array([len(x) for x in coded])
            begin = np.append(0, np.cumsum(n))[:-1]
            flat = np.concatenate(coded)
            total = lambda v: np.add.reduceat(v, begin)  # noqa: B023, E731
            outside = (flat >= net.rare) & (flat < none)
            score = score_texts(net, weights, [np.minimum(x, net.rare) for x in coded]) / np.log(10) + total(np.where(outside, logs[flat], 0.0))
            tail = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array([w for w, _ in rare], pa.binary()), pa.array([k for _, k in rare], pa.int64())], ["word", "n"]))
            cols = [pa.array(n, pa.int64()), pa.array(total((flat < none).astype(np.int64)), pa.int64()), pa.array(total(logs[flat]), pa.float64()), pa.array(score, pa.float64()), pa.array(total((flat >= net.rare).astype(np.int64)), pa.int64()), tail]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(extra))], *cols], names=[*extra, "n_tokens", "known_here", "logs_here", "score_here", "rare", "tail"])

    return run


def score_documents(spark: SparkSession, docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; rows with held_out teach nothing."""
    session(spark)
    d = docs.select(F.col(key).alias("_key"), held_out.alias("held_out"), F.col(text).cast("binary").alias("text"))
    teach = d.where("not held_out")
    counts = written(spark, teach.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = total["n"] or 0, total["v"]
    known, known_n = _most_frequent(counts, KNOWN)
    ids = {w: i for i, w in enumerate(known)}
    head_n = known_n[:HEAD].tolist()
    rare = n_train - sum(head_n) + v_train - len(head_n) + 1  # inside rare a word has (c + 1) / rare
    net = Network(known[:HEAD], head_n, rare)

    shared = spark.sparkContext.broadcast((net, net.weights, ids))
    taught = teach.select("text").mapInArrow(_teach(shared, RATE), "slot int, w binary, n long")
    taught = taught.repartition(COMBINE, "slot").coalesce(COMBINE).mapInArrow(_added, "slot int, w binary, n long").collect()
    weights = net.weights
    if taught:
        weights = (sum(np.frombuffer(r["w"], np.float64) for r in taught) / sum(r["n"] for r in taught)).astype(np.float32)

    scale = np.log10(float(n_train + v_train + 1))
    logs = np.append(np.log10(known_n + 1.0), 0.0)
    model = spark.sparkContext.broadcast((net, weights, ids, logs))
    kind = docs.schema[key].dataType.simpleString()
    scored = d.select("_key", "held_out", "text").mapInArrow(_scan(model, ["_key", "held_out"]), f"_key {kind}, held_out boolean, n_tokens long, known_here long, logs_here double, score_here double, rare long, tail array<struct<word: binary, n: long>>")
    scored = written(spark, scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", F.col("t.n").alias("m"))
    # unseen words add log10(0 + 1) = 0 and are not known, so an inner join is enough
    sums = tail.join(counts, "word").groupBy("_row").agg(F.sum("m").alias("known"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("logs"))
    both = scored.drop("tail").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("known_here") + zero("known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs_here") + zero("logs") - F.col("n_tokens") * F.lit(float(scale))).cast("double").alias("base_score"),
        (F.col("score_here") + zero("logs") - F.col("rare") * F.lit(float(np.log10(rare)))).cast("double").alias("score"),
    )
