"""A gated recurrent language model, trained and applied over whole documents.

Counts.  Words of all training documents are counted; so is the end that closes a document.  The most frequent
words, the end and TAIL buckets of all other words (by their last two bytes) are the model's symbols.
A word outside the symbols has the probability of its bucket times (c + 1) / (N_b + V_b + 1), with
its training count c and the bucket's tokens and distinct words: unseen words have a share too.

Model.  A gated recurrent unit reads the symbols before; a softmax over classes of CLASS symbols of like
frequency, times one over the class's symbols, gives the next one.  Biases start at the
counts, so that training starts from the unigram model.

Training.  Two rounds; each training document is in one of them.  In a round every partition runs truncated
backpropagation (windows of STEPS symbols, state carried on; the gradient is taken of every window) from the same
parameters, and the results are averaged, weighted by symbols, in a tree of groups of FAN partitions.

Scoring.  A partition's documents advance side by side, longest first; each keeps its state from its first word to
its end.  Counts of HEAD frequent words are broadcast (a bounded table); rarer words are joined by a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, store

HIDDEN, EMBED = 16, 12
CLASS = 64
SYMBOLS = 4096
TAIL = 64
#: Words whose counts are broadcast at most.
HEAD = 1 << 18
STEPS, STREAMS = 32, 512
#: Symbols whose probabilities are worked out at once: they stay in a core's cache.
ROWS = 2048
#: Symbols of a block that is scored: its numbers stay near the core.
SIDE = 1 << 16
RATE = 0.02
#: Symbols that a step of the optimizer rests on: the windows at the ends of long documents hold few, and are put together.
BATCH = 4_096
#: One training document in FIRST is in the first round.
FIRST = 8
#: Bytes of text whose words are found at once.
PART_BYTES = 1 << 23
#: Distinct words of parts that a task counts before it hands them on; symbols that are scored side by side.
FLUSH, CHUNK = 1_000_000, 4_000_000
BLOCKS, FAN = 16, 64
FOLDS, HELD_OUT = 7, 2


def tail_bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


@dataclass
class Words:
    """The words of a batch of texts: the distinct ones, which one each word is, and where each text's words begin."""

    distinct: pa.Array
    which: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Null texts have no words; A-Z count as a-z."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        which, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        empty = pc.index(coded.dictionary, "").as_py()  # what white space at an end leaves
        if empty >= 0:
            real = which != empty
            which, offsets = which[real], np.concatenate(([0], np.cumsum(real)))[offsets]
        return cls(coded.dictionary.cast(pa.binary()), which, offsets)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART_BYTES of text each (a longer text is by itself)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > PART_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


@dataclass
class Vocabulary:
    """symbol 0: the end; then words, most frequent first; then the tail buckets. counts: of the broadcast words."""

    counts: dict[bytes, int]
    symbols: dict[bytes, int]
    symbol_counts: np.ndarray
    tail_size: np.ndarray  # N_b + V_b + 1
    ends: int
    tokens: int
    distinct: int

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(list(self.symbols), pa.binary())

    @cached_property
    def heads(self) -> tuple[pa.Array, np.ndarray]:
        """The broadcast words and log10(c + 1) of each; a 0 follows, for all others."""
        return pa.array(list(self.counts), pa.binary()), np.log10(np.array([*self.counts.values(), 0], np.float64) + 1)

    @cached_property
    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """tail_bucket of words of one byte, and of those that end in two bytes."""
        ends = [np.array([tail_bucket(bytes(x)) for x in np.ndindex(*shape)], np.int16).reshape(shape) for shape in ((256,), (256, 256))]
        return ends[0], ends[1]

    def codes(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word."""
        if not len(words):
            return np.empty(0, np.int16)
        _, offsets, raw = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset :][: len(words) + 1]
        data, last = np.frombuffer(raw, np.uint8) if raw and raw.size else np.zeros(1, np.uint8), np.maximum(ends[1:] - 1, 0)
        one, two = self.buckets
        bucket = np.where(np.diff(ends) == 1, one[data[last]], two[data[np.maximum(last - 1, 0)], data[last]])
        found = pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        return np.where(found >= 0, found + 1, 1 + len(self.symbols) + bucket).astype(np.int16)

    def logs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a broadcast count, and log10(c + 1) of it, else 0."""
        names, logs = self.heads
        found = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)
        return found >= 0, logs[found]

    def encode(self, words: Words, codes: np.ndarray | None = None) -> list[np.ndarray]:
        """The symbols of every text, with the end."""
        found = (self.codes(words.distinct) if codes is None else codes)[words.which]
        return [np.append(x, np.int16(0)) for x in np.split(found, words.offsets[1:-1])]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) of all whole texts; the end, once per row, has the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"])
            return found.rename_columns(["word", "c"]).combine_chunks().to_batches()[0]

        def counted(words: pa.Array, c: np.ndarray) -> pa.Table:
            return pa.table({"word": words, "c": pa.array(c, pa.int64())})

        for batch in batches:
            if batch.num_rows:
                held.append(counted(pa.array([b""], pa.binary()), np.array([batch.num_rows])))
            for part in slices(batch, 0):
                words = Words.of(part.column(0))
                if len(words.which):
                    c = np.bincount(words.which, minlength=len(words.distinct))
                    table = counted(words.distinct, c)
                    held.append(table.filter(pa.array(c > 0)))
                    size += len(c)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return arrow(docs.select("text"), run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a stored count_tokens table."""
    word = counts.where("octet_length(word) > 0")
    ends = counts.where("octet_length(word) = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # How many words have a count in a bin: the least count whose words all fit the broadcast table.
    step = F.floor(F.log2("c") * 16)
    bins = sorted(word.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.bin)
    least, held = 1 << 62, 0
    for r in bins:
        held += r.n
        if held > HEAD:
            break
        least = r.least
    table = word.where(F.col("c") >= least).toArrow()
    order = sorted(zip(table["word"].to_pylist(), table["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    names = order[: SYMBOLS - TAIL - 1]
    bucket = F.crc32(F.substring("word", -2, 2)) % TAIL
    size, own, distinct = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64), 0
    for r in word.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        own[r.b], size[r.b] = r.n, r.n + r.v
        distinct += r.v
    tokens = int(own.sum()) + ends
    for w, c in names:
        own[tail_bucket(w)] -= c
        size[tail_bucket(w)] -= c + 1
    return Vocabulary(dict(order), {w: i + 1 for i, (w, _) in enumerate(names)}, np.array([ends, *(c for _, c in names), *own], np.float64), size + 1, ends, tokens, distinct + (ends > 0))


Params = dict[str, np.ndarray]


def start_params(symbol_counts: np.ndarray, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    classes = -(-len(symbol_counts) // CLASS)
    counts = np.full(classes * CLASS, 1e-6)
    counts[: len(symbol_counts)] = symbol_counts + 0.5
    counts = counts.reshape(classes, CLASS)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    bias = np.zeros(3 * HIDDEN, np.float32)
    bias[:HIDDEN] = 2.0  # long memory at first
    return {
        "emb": draw(0.5, classes * CLASS, EMBED), "w": draw(EMBED**-0.5, EMBED, 3 * HIDDEN), "u": draw(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), "b": bias,
        "wc": draw(0.05, HIDDEN, classes), "bc": np.log(counts.sum(1)).astype(np.float32),
        "wo": draw(0.05, classes, HIDDEN, CLASS), "bo": np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - top), its sum by row, and top: 0, the largest of all where that is large, or of each row where that would leave a row nothing."""
    ones = np.ones(x.shape[1], x.dtype)
    top = x.max(initial=0)
    top = 0.0 if top < 60 else top
    e = np.exp(x - top) if top else np.exp(x)
    sums = e @ ones
    if not sums.min(initial=1) > 1e-20:
        top = x.max(axis=1)
        e = np.exp(x - top[:, None])
        sums = e @ ones
    return e, sums, top


def _softmax(x: np.ndarray, scale: float) -> np.ndarray:
    e, sums, _ = _exps(x)
    e *= (scale / sums)[:, None]
    return e


def step(p: Params, xw: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The next states of streams (rows); fast where the rows are columns of what lies behind."""
    hu = (p["u"].T @ h.T).T
    gates = _sigmoid(xw[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
    new = np.tanh(xw[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
    return new + gates[:, :HIDDEN] * (h - new)


def _with_bias(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The output weights of the classes and of their symbols, with the biases as a last row: states have a 1 there."""
    return np.vstack([p["wc"], p["bc"]]), np.concatenate([p["wo"], p["bo"][:, None]], axis=1)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of symbols y by class, and (class, its part of that order, in slices of up to ROWS)."""
    c = (y // CLASS).astype(np.int16)
    order = np.argsort(c, kind="stable")
    ends = np.flatnonzero(np.diff(c[order], append=-1)) + 1
    found, at = [], 0
    for end in ends.tolist():
        own = int(c[order[at]])
        found += [(own, slice(i, min(i + ROWS, end))) for i in range(at, end, ROWS)]
        at = end
    return order, found


def log_probs(p: Params, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of symbols y after states h."""
    order, parts = _by_class(y)
    y, rows = y[order], np.ones((len(y), HIDDEN + 1), h.dtype)
    rows[:, :HIDDEN] = h[order]
    of_class, of_symbol = _with_bias(p)
    found = np.empty(len(y), h.dtype)

    def own(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        _, sums, top = _exps(x)
        return x[np.arange(len(k)), k] - top - np.log(sums)

    for at in range(0, len(y), ROWS):
        part = slice(at, at + ROWS)
        found[part] = own(rows[part] @ of_class, y[part] // CLASS)
    for c, part in parts:
        found[part] += own(rows[part] @ of_symbol[c], y[part] % CLASS)
    out = np.empty_like(found)
    out[order] = found
    return out


def _inputs(p: Params, e: np.ndarray) -> np.ndarray:
    """What embeddings (steps, streams, EMBED) add to the gates: (steps, 3 * HIDDEN, streams). Numbers of a step lie by feature, then stream: the gates are contiguous."""
    xw = p["w"].T @ e.transpose(0, 2, 1)
    xw += p["b"][:, None]
    return xw


def gradient(p: Params, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray]:
    """Mean gradient over the live symbols of one window (steps, streams), and the last state."""
    steps, n = x.shape
    e = p["emb"][x]
    xw = _inputs(p, e)
    ut = np.ascontiguousarray(p["u"].T)
    hs = np.empty((steps + 1, HIDDEN, n), xw.dtype)
    hs[0] = h.T
    gates, news, hns = np.empty((steps, 2 * HIDDEN, n), xw.dtype), np.empty((steps, HIDDEN, n), xw.dtype), np.empty((steps, HIDDEN, n), xw.dtype)
    for t in range(steps):
        hu = ut @ hs[t]
        hns[t] = hu[2 * HIDDEN :]
        gates[t] = _sigmoid(xw[t, : 2 * HIDDEN] + hu[: 2 * HIDDEN])
        new = np.tanh(xw[t, 2 * HIDDEN :] + gates[t, HIDDEN:] * hns[t], out=news[t])
        np.add(new, gates[t, :HIDDEN] * (hs[t] - new), out=hs[t + 1])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    # Live symbols by class: each class's states and targets lie together.
    at = np.flatnonzero(live.ravel())
    order, parts = _by_class(y.ravel()[at])
    at = at[order]
    s, target, scale = np.ones((len(at), HIDDEN + 1), xw.dtype), y.ravel()[at], xw.dtype.type(1 / max(1, len(at)))
    s[:, :HIDDEN] = hs[1:].transpose(0, 2, 1).reshape(-1, HIDDEN)[at]
    ds = np.empty((len(at), HIDDEN), xw.dtype)
    of_class, of_symbol = _with_bias(p)
    g_class, wct = np.zeros_like(of_class), np.ascontiguousarray(p["wc"].T)
    for i in range(0, len(at), ROWS):
        part, own = s[i : i + ROWS], target[i : i + ROWS] // CLASS
        d = _softmax(part @ of_class, scale)
        d[np.arange(len(own)), own] -= scale
        g_class += part.T @ d
        ds[i : i + ROWS] = d @ wct
    g["wc"], g["bc"] = g_class[:-1].copy(), g_class[-1].copy()
    for c, rows in parts:
        part, own = s[rows], target[rows] % CLASS
        d = _softmax(part @ of_symbol[c], scale)
        d[np.arange(len(own)), own] -= scale
        of_c = part.T @ d
        g["wo"][c] += of_c[:-1]
        g["bo"][c] += of_c[-1]
        ds[rows] += d @ p["wo"][c].T
    dstates = np.zeros((steps * n, HIDDEN), xw.dtype)
    dstates[at] = ds
    dstates = np.ascontiguousarray(dstates.reshape(steps, n, HIDDEN).transpose(0, 2, 1))
    z, r, before = gates[:, :HIDDEN], gates[:, HIDDEN:], hs[:-1]
    by_z, by_new = (before - news) * z * (1 - z), (1 - z) * (1 - news * news)
    by_r = hns * r * (1 - r)
    dxw, dhu, dh = np.empty_like(xw), np.empty_like(xw), np.zeros((HIDDEN, n), xw.dtype)
    for t in reversed(range(steps)):
        dh += dstates[t]
        dnew = np.multiply(dh, by_new[t], out=dxw[t, 2 * HIDDEN :])
        np.multiply(dh, by_z[t], out=dhu[t, :HIDDEN])
        np.multiply(dnew, by_r[t], out=dhu[t, HIDDEN : 2 * HIDDEN])
        np.multiply(dnew, r[t], out=dhu[t, 2 * HIDDEN :])
        dh = dh * z[t] + p["u"] @ dhu[t]
    dxw[:, : 2 * HIDDEN] = dhu[:, : 2 * HIDDEN]
    g["u"] = (before @ dhu.transpose(0, 2, 1)).sum(axis=0)
    g["w"], g["b"] = (e.transpose(0, 2, 1) @ dxw.transpose(0, 2, 1)).sum(axis=0), dxw.sum(axis=(0, 2))
    de = (p["w"] @ dxw).transpose(0, 2, 1).reshape(-1, EMBED)
    flat = x.ravel().astype(np.int16)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    g["emb"][flat[order[first]]] = np.add.reduceat(de[order], first, axis=0)
    return g, hs[-1].T


class Adam:
    def __init__(self, p: Params) -> None:
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def __call__(self, p: Params, g: Params, share: float = 1.0) -> None:
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-12))
        self.t += 1
        rate = share * RATE * math.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x *= clip
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.02 * (x * x - self.v[k])
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-5)


def _window(docs: list[np.ndarray], lengths: np.ndarray, at: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and what is live of the symbols at .. at + steps of every document; before the first symbol: the end."""
    y = np.zeros((steps + 1, len(docs)), np.int64)
    for i, d in enumerate(docs):
        part = d[max(0, at - 1) : at + steps]
        y[(at == 0) : (at == 0) + len(part), i] = part
    return y[:-1], y[1:], np.arange(at, at + steps)[:, None] < lengths[None, :]


def train(p: Params, docs: list[np.ndarray], adam: Adam) -> None:
    """Truncated backpropagation over all documents, in streams of documents of like length; the rate falls to a tenth."""
    docs = sorted(docs, key=len, reverse=True)
    groups = [docs[i : i + STREAMS] for i in range(0, len(docs), STREAMS)]
    whole, done, held, sums = max(1, sum(map(len, docs))), 0, 0, {}
    for k in np.random.default_rng(len(docs)).permutation(len(groups)):
        group = groups[k]
        lengths = np.array([len(d) for d in group])
        h = np.zeros((len(group), HIDDEN), np.float32)
        for at in range(0, int(lengths[0]), STEPS):
            n = int((lengths > at).sum())
            x, y, live = _window(group[:n], lengths[:n], at, min(STEPS, int(lengths[0]) - at))
            g, h = gradient(p, x, y, live, h[:n])
            symbols = int(live.sum())
            for c, v in g.items():
                v *= symbols
                sums[c] = np.add(v, sums[c], out=v) if c in sums else v
            done, held = done + symbols, held + symbols
            if held >= BATCH or done == whole:
                for v in sums.values():
                    v /= held
                adam(p, sums, min(1.0, held / BATCH) * (1 - 0.9 * done / whole))
                held, sums = 0, {}


def log_likelihoods(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every whole document; state from its first symbol to its end."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    total = np.zeros(len(docs))
    h, at, most = np.zeros((HIDDEN, len(docs)), np.float32), 0, int(lengths[0]) if len(docs) else 0
    while at < most:
        n = int((lengths > at).sum())
        steps = min(max(16, SIDE // n), 512, most - at)
        x, y, live = _window([docs[i] for i in order[:n]], lengths[:n], at, steps)
        xw, h = _inputs(p, p["emb"][x]), h[:, :n].copy()
        states = np.empty((steps, n, HIDDEN), np.float32)
        for t, k in enumerate(live.sum(axis=1).tolist()):
            h[:, :k] = step(p, xw[t, :, :k].T, h[:, :k].T).T
            states[t, :k] = h[:, :k].T
        got = np.zeros((steps, n))
        got[live] = log_probs(p, states[live], y[live])
        total[:n] += got.sum(axis=0)
        at += steps
    out = np.empty(len(docs))
    out[order] = total
    return out


def _pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train_round(docs: DataFrame, p: Params, vocab: Vocabulary) -> Params:
    """The weighted mean of what each partition of docs(text) makes of p."""
    shared = docs.sparkSession.sparkContext.broadcast((p, vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, v = shared.value
        own = {k: x.copy() for k, x in first.items()}
        adam, held, size, total = Adam(own), [], 0, 0
        for batch in batches:
            for part in slices(batch, 0):
                new = v.encode(Words.of(part.column(0)))
                held += new
                size += sum(map(len, new))
                if size > CHUNK:
                    train(own, held, adam)
                    held, size, total = [], 0, total + size
        if held:
            train(own, held, adam)
        if total + size:
            parts = np.array_split(_pack(own), BLOCKS)
            learner = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([learner] * BLOCKS, pa.int64()), pa.array([float(total + size)] * BLOCKS), pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary())], ["block", "learner", "weight", "part"])

    def mean(table: pa.Table) -> pa.Table:
        w = table["weight"].to_numpy()
        sums = sum(x * np.frombuffer(b, "<f4").astype(np.float64) for x, b in zip(w, table["part"].to_pylist(), strict=True))
        return pa.table({"block": table["block"][:1], "learner": pa.array([table["learner"][0].as_py() // FAN]), "weight": pa.array([w.sum()]), "part": pa.array([(sums / w.sum()).astype("<f4").tobytes()], pa.binary())})

    schema = "block int, learner bigint, weight double, part binary"
    parts = store(arrow(docs.select("text"), run, schema), "lm-parts")
    while (parts.agg(F.max("learner")).first()[0] or 0) > 0:
        parts = store(parts.groupBy("block", F.floor(F.col("learner") / FAN).alias("fan")).applyInArrow(mean, schema), "lm-parts")
    flat = [np.frombuffer(r.part, "<f4") for r in sorted(parts.collect(), key=lambda r: r.block)]
    shared.unpersist()
    return _unpack(np.concatenate(flat), p) if flat else p


def fit(docs: DataFrame, counts: DataFrame) -> tuple[Params, Vocabulary]:
    """Train on all rows of docs(doc_id, text); counts: their stored count_tokens."""
    vocab = vocabulary(counts)
    p = start_params(vocab.symbol_counts)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FIRST)) == 0
    for part in (docs.where(turn), docs.where(~turn)):
        p = train_round(part, p, vocab)
    return p, vocab


def score(docs: DataFrame, p: Params, vocab: Vocabulary, counts: DataFrame) -> DataFrame:
    """docs without text, and n_tokens, n_known, train_tokens, base_score and score of every row."""
    keep = [c for c in docs.columns if c not in ("text", "row_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((p, vocab))
    more_fields = "row_id bigint, n_tokens bigint, n_known bigint, base double, model double, tail array<binary>"
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(more_fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        params, v = shared.value
        every, size = math.log10(v.tokens + v.distinct + 1), np.log10(v.tail_size)
        first = 1 + len(v.symbols)
        end = math.log10(v.ends + 1)

        def out(own: list[pa.RecordBatch], docs: list[np.ndarray], sums: list[tuple]) -> pa.RecordBatch:
            columns = [c.cast(f.type) for c, f in zip(pa.Table.from_batches(own).columns[: len(keep) + 1], arrow, strict=False)]
            n_tokens, known, base, rest = (np.concatenate([x[i] for x in sums]) for i in range(4))
            values = (n_tokens, known, base, log_likelihoods(params, docs) / math.log(10) + rest)
            tail = pa.concat_arrays([x[4] for x in sums]).cast(arrow.field("tail").type)
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in columns), *map(pa.array, values), tail], schema=arrow)

        own, held, sums, size_held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, len(keep) + 1):
                words = Words.of(part.column(len(keep) + 1))
                n, doc = part.num_rows, words.documents()
                known, log = v.logs(words.distinct)
                codes = v.codes(words.distinct)
                # Of words outside the symbols: log10(c + 1) of those counted here, less the bucket's size.
                outside = codes >= first
                rest = np.where(outside, log - size[np.where(outside, codes - first, 0)], 0.0) if len(codes) else log
                per = lambda x, doc=doc, n=n, words=words: np.bincount(doc, x[words.which], n)
                count = np.diff(words.offsets)
                n_known = per(known.astype(np.float64)).astype(np.int64)
                tail = words.which[~known[words.which]]
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count - n_known))), pa.int32()), words.distinct.take(pa.array(tail)))
                sums.append((count + 1, n_known + (v.ends > 0), per(log) + end - (count + 1) * every, per(rest), tails))
                held += v.encode(words, codes)
                own.append(part)
                size_held += len(words.which) + n
                if size_held > CHUNK:
                    yield out(own, held, sums)
                    own, held, sums, size_held = [], [], [], 0
        if own:
            yield out(own, held, sums)

    part = store(arrow(docs.select(*keep, F.monotonically_increasing_id().alias("row_id"), "text"), run, schema), "lm-scores")
    tail = part.select("row_id", F.explode("tail").alias("word")).join(counts, "word")
    tail = tail.groupBy("row_id").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return part.drop("tail").join(tail, "row_id", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 7 isn't 2 (a null doc_id is one of them).  Null and empty texts have one
    token, the end.  Without training rows every token is unknown and the model's start is uniform.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    train_rows = rows.where("not held_out")
    counts = store(count_tokens(train_rows), "lm-counts")
    p, vocab = fit(train_rows, counts)
    return score(rows, p, vocab, counts)
