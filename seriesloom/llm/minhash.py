"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of
   BANDS * ROWS minima.  Equal texts form a class, represented by its smallest document.
2. Classes that agree in all minima of a band share a bucket.  A bucket first pairs its members with
   two hubs only, its smallest and its largest member.  Members that a verified link puts into one component
   need no further look.  A bucket that still holds several components is looked through in blocks of about BLOCK
   members, large components apart: a task compares the members of two blocks that are in different components and hands on links only.  So
   a large group of near copies gives rows in proportion to its size, and no link between components is lost.
3. A pair's signatures are compared BATCH minima at a time.  With m of n equal and a uniform prior, the
   pair is dropped once the posterior chance of a similarity at the threshold is under ``miss``.
4. Survivors are verified on their full shingle sets.

With 40 bands of 5 rows a pair at the threshold shares no bucket with chance (1 - 0.75^5)^40 = 2e-5, at 0.8
with 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, arrow, one_per_id, store, with_ids
from .graph import components

SHINGLE = 5
BANDS, ROWS = 40, 5
BATCH = 40
MISS = 1e-6
#: The threshold is PERCENT hundredths.
PERCENT = 75
#: Members of a bucket that are compared with as many others at once.
BLOCK = 64
#: Document ids that are broadcast to pick the texts to verify; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Distinct words whose hashes a worker keeps.
MEMO = 200_000

_rng = np.random.default_rng(20_240_101)
_MULTIPLY = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case: both bytes methods know ASCII only."""
    return text.lower().split()


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct SHINGLE-word shingles; with fewer words the sequence is the only one."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, min(len(w), SHINGLE), np.uint64)
    for i in range(min(len(w), SHINGLE)):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    """uint32 minima of a set, one per hash function."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = _MULTIPLY * x[None, at : at + 2048]
        part += _ADD
        np.minimum(low, part.min(axis=1), out=low)
    return low


@lru_cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n equal minima at which P(similarity >= threshold) is ``miss`` or more, for a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest (16 bytes: equal for equal word sequences), n_shingles, sig (low halves of the minima), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                digests, counts, sigs, bands = [], [], [], []
                for text in part.column(1).cast(pa.binary()):
                    words = words_of(text.as_py() or b"")
                    found = shingles(words, hashes)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    counts.append(len(found))
                    if not len(found):
                        sigs.append(None)
                        bands.append(None)
                        continue
                    low = signature(found)
                    sigs.append(low.astype(np.uint16).tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(x.tobytes(), seed=i) - (1 << 63) for i, x in enumerate(low.reshape(BANDS, ROWS))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "sig", "bands"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, digest binary, n_shingles bigint, sig binary, bands array<bigint>")


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float = PERCENT / 100, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance of ``miss`` or more for the threshold, batch by batch."""
    least = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for i in (2, 3))
            live, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, fewest in least:
                equal[live] += (one[live, n - BATCH : n] == two[live, n - BATCH : n]).sum(axis=1)
                live = live[equal[live] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    return arrow(both.select("a", "b", "sig_a", "sig_b"), run, "a bigint, b bigint")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, words): the lower-case words of the classes(rep, digest) in wanted(rep)."""
    wanted = store(wanted.distinct(), "minhash-wanted")
    ids = wanted.toDF("doc_id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(words_of(t or b"")) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()), pa.array(words, pa.binary())], ["rep", "digest", "words"])

    rows = arrow(found, run, "rep bigint, digest binary, words binary")
    return store(rows.join(classes.select("rep", "digest"), ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]).select("rep", "words"), "minhash-texts")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, memo = WordHashes(), {}

        def of(words: bytes) -> np.ndarray:
            key = xxhash.xxh3_128_digest(words)
            if key not in memo:
                if len(memo) > 64:
                    memo.clear()
                memo[key] = shingles(words.split(), hashes)
            return memo[key]

        for batch in batches:
            keep = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                one, two = of(x), of(y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both) > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    both = pairs.join(texts.toDF("a", "words_a"), "a").join(texts.toDF("b", "words_b"), "b")
    return arrow(both.select("a", "b", "words_a", "words_b"), run, "a bigint, b bigint")


def links_apart(apart: DataFrame, texts: DataFrame, classes: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Links (a, b) between members of apart(bucket, rep, component, block) that share a bucket but no component.

    A pair is looked at in the first bucket that it shares.  Signatures are compared batch by batch, as in ``likely``; survivors are verified on their sets.
    """
    least = [(n, least_matches(n, percent / 100, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, memo = WordHashes(), {}

        def found(row: dict) -> np.ndarray:
            key = xxhash.xxh3_128_digest(row["words"])
            if key not in memo:
                if len(memo) > 8 * BLOCK:
                    memo.clear()
                memo[key] = shingles(row["words"].split(), hashes)
            return memo[key]

        def load(rows: list[dict]) -> tuple[np.ndarray, ...]:
            sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), -1)
            return *(np.array([r[k] for r in rows]) for k in ("rep", "component", "bands", "n")), sigs

        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                bucket, x, y = (batch.column(k)[i].as_py() for k in range(3))
                (xr, xc, xb, xn, xg), (yr, yc, yb, yn, yg) = load(x), load(y)
                sizes = xn[:, None], yn[None, :]
                live = (xc[:, None] != yc[None, :]) & (xr[:, None] != yr[None, :]) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
                same = xb[:, None, :] == yb[None, :, :]
                band = (xb[0] == bucket).argmax()
                live &= same.argmax(axis=2) == band
                p, q = np.nonzero(live)
                equal = np.zeros(len(p), np.int64)
                for n, fewest in least:
                    equal += (xg[p, n - BATCH : n] == yg[q, n - BATCH : n]).sum(axis=1)
                    keep = equal >= fewest
                    p, q, equal = p[keep], q[keep], equal[keep]
                for j, k in zip(p.tolist(), q.tolist(), strict=True):
                    one, two = found(x[j]), found(y[k])
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        a.append(min(int(xr[j]), int(yr[k])))
                        b.append(max(int(xr[j]), int(yr[k])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one = F.struct("rep", "component", "n", "words", "sig", "bands")
    full = apart.join(texts, "rep").join(classes.select("rep", "n", "sig", "bands"), "rep").groupBy("bucket", "block").agg(F.collect_list(one).alias("rows"), F.min("component").alias("least"), F.max("component").alias("most"))
    full = store(full, "minhash-blocks")
    x, y = full.alias("x"), full.alias("y")
    alike = (F.col("x.least") == F.col("x.most")) & (F.col("y.least") == F.col("y.most")) & (F.col("x.least") == F.col("y.least"))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") <= F.col("y.block")) & ~alike)
    return arrow(pairs.select("x.bucket", F.col("x.rows").alias("x"), F.col("y.rows").alias("y")), run, "a bigint, b bigint").distinct()


def blocks_apart(named: DataFrame) -> DataFrame:
    """(bucket, rep, component, block): the members of named(bucket, rep, component) in buckets that hold several components, in blocks of about BLOCK.

    A component of more than BLOCK members in a bucket has blocks of its own, and two of these need no comparison; smaller ones share blocks, each whole in one.
    So a large component and a few strays make blocks, and pairs of them, in proportion to the members.
    """
    own = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m")).otherwise(0)).alias("small")).where("components > 1")
    sized = store(own.join(mixed, "bucket").select("bucket", "component", "m", "small"), "minhash-mixed")
    large = F.col("m") > BLOCK
    of_large = F.xxhash64("component", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK)))
    of_small = F.pmod(F.xxhash64("component"), F.ceil(F.greatest("small", F.lit(1)) / BLOCK))
    return named.join(sized, ["bucket", "component"]).select("bucket", "rep", "component", F.when(large, of_large).otherwise(of_small).alias("block"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    Null texts and texts without words: no shingles, linked with nothing, kept.  Rows with one doc_id are one
    document: their texts share a component.  Rows with a null doc_id take the component of their exact
    text, or null; they are kept if that is null.  Empty input: empty output.
    """
    all_rows = store(sketch(docs), "minhash-sketch")
    filled = all_rows.where("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = store(classes.where("rep IS NOT NULL"), "minhash-classes")
    sigs = classes.select("rep", "sig")

    members = classes.select(F.explode("bands").alias("bucket"), "rep")
    buckets = store(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("k > 1 AND low < high"), "minhash-buckets")
    members = store(members.join(buckets, "bucket").select("bucket", "rep", "low", "high"), "minhash-members")
    # Whole texts of all classes that share a bucket, read once.
    texts = texts_of(docs, classes, members.select("rep"))
    check = lambda pairs: store(verified(store(likely(pairs, sigs), "minhash-likely"), texts), "minhash-links")

    hubs = members.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(members.select(F.col("rep").alias("a"), F.col("high").alias("b")))
    links = check(store(hubs.where("a < b").distinct(), "minhash-pairs"))
    found = components(links)
    named = members.join(found.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    new = store(links_apart(blocks_apart(named), texts, classes), "minhash-links")
    if new.limit(1).count():
        found = components(links.union(new))

    named = classes.select("digest", "rep").join(found.toDF("rep", "component"), "rep", "left")
    # One class has one component; two texts under one doc_id share it.
    named = store(named.select("digest", F.coalesce("component", "rep").alias("component_id")), "minhash-named")
    out = all_rows.select("doc_id", "digest", "n_shingles").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, unchanged: rows that near_duplicates keeps; of rows with one doc_id, the smallest.

    Each row without a doc_id is a document of its own: it goes if it is near another one, and stays if it is the only one of its group, or
    if no other of its group has a doc_id and it is the first of them.
    """
    docs = with_ids(docs)
    judged = store(near_duplicates(docs.select(F.col(ROW_ID).alias("doc_id"), "text")).select("doc_id", "kept").distinct(), "minhash-judged")
    gone = judged.where("not kept").select(F.col("doc_id").alias("seriesloom_gone_id")).hint("shuffle_hash")
    kept = docs.join(gone, F.col(ROW_ID) == F.col("seriesloom_gone_id"), "left_anti")
    return one_per_id(kept, ROW_ID).drop(ROW_ID)
