"""Target-distribution importance resampling by bucket-partitioned inverted postings.

1. One pass over the documents turns blocks of about BLOCK_WORDS words into postings: for every bucket of hashed features the documents
   of the block that have it, and how often.  A block is also a row of its documents' sizes.
2. Postings are shuffled by bucket.  A bucket's totals come from both corpora, grouped together; they give its gain, and every posting of
   the bucket takes it on.  A bucket is cut in SALTS by block, so that a frequent one is not one task's.
3. Contributions are shuffled by block and summed by document.
4. Documents that are large enough are drawn by the largest weight plus Gumbel noise that is a hash of doc_id.  A count by
   score gives the score to reach; only documents that reach it are sorted, and get their rank from offsets of the sorted partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, store
from .decontam import words_of

BUCKETS = 10_000
#: Words and documents (their places are 16 bits) of a block of postings.
BLOCK_WORDS, BLOCK_DOCS = 1 << 19, 1 << 14
#: Pieces of a bucket.
SALTS = 16
#: Distinct words whose buckets a worker remembers.
MEMO = 500_000

_POSTINGS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("total", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
_POSTINGS_DDL = "block bigint, bucket int, total bigint, places binary, counts binary, doc_ids array<bigint>, n_features array<bigint>, n_words array<bigint>"


class Buckets(dict):
    """Bucket of a feature's bytes, remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.size
        return found


def features_of(words: list[bytes], runs: tuple[int, int], buckets: Buckets) -> np.ndarray:
    """Buckets of all runs of runs[0] to runs[1] consecutive words, joined by a space."""
    found = []
    for n in range(runs[0], runs[1] + 1):
        grams = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(buckets.__getitem__, grams), np.int64, len(grams)))
    return np.concatenate(found)


def _block(name: int, docs: list[tuple], found: list[np.ndarray]) -> pa.Table:
    """Rows of a block: its documents(doc_id, n_features, n_words), then the postings of each of its buckets."""
    sizes = np.array([len(x) for x in found])
    keys = np.concatenate(found) * BLOCK_DOCS + np.repeat(np.arange(len(docs)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    buckets, places = keys // BLOCK_DOCS, (keys % BLOCK_DOCS).astype(np.uint16)
    own, starts = np.unique(buckets, return_index=True)
    n = len(own)
    at = np.append(starts, len(keys)).astype(np.int32)
    binary = lambda data, width: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(data)])
    # One byte a count where the block has no larger one.
    width, kind = (1, np.uint8) if counts.max(initial=0) < 256 else (8, np.int64)
    totals = np.add.reduceat(counts, starts) if n else np.zeros(0, np.int64)
    head = pa.table([[name], pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), *[[list(c)] for c in zip(*docs, strict=True)]], schema=_POSTINGS)
    nulls = [pa.nulls(n, t) for t in (pa.list_(pa.int64()),) * 3]
    body = pa.table([np.full(n, name), own.astype(np.int32), totals.astype(np.int64), binary(places, 2), binary(counts.astype(kind), width), *nulls], schema=_POSTINGS)
    return pa.concat_tables([head, body])


def postings(docs: DataFrame, runs: tuple[int, int] = (1, 1), size: int = BUCKETS) -> DataFrame:
    """The postings of (doc_id, text): rows of bucket and documents' places in their block; the row of a block without bucket has its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size)
        name, rows, found, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py() or b"")
                found.append(features_of(words, runs, buckets))
                rows.append((doc, len(found[-1]), len(words)))
                held += len(found[-1])
                if held >= BLOCK_WORDS or len(rows) == BLOCK_DOCS:
                    yield from _block(name, rows, found).to_batches()
                    name, rows, found, held = name + 1, [], [], 0
        if rows:
            yield from _block(name, rows, found).to_batches()

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _POSTINGS_DDL)


def gains(own: DataFrame, target: DataFrame, size: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that either of the postings has, from both corpora grouped by bucket."""
    parts = own.where("bucket IS NOT NULL").select("bucket", F.col("total").alias("s"), F.lit(0).cast("long").alias("t"))
    parts = parts.unionAll(target.where("bucket IS NOT NULL").select("bucket", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    totals = store(parts.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "resampling-totals")
    whole = totals.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit((whole.s or 0.0) + size) / ((F.col("s") + 1) * F.lit((whole.t or 0.0) + size))
    return totals.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


_SUMS_DDL = "doc_id bigint, n_features bigint, n_words bigint, weight bigint"
_SUMS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "n_words", "weight")])


def _summed(rows: pa.Table) -> pa.Table:
    """Documents of a block with the floor of the mean of their features' gains."""
    head = rows.filter(pc.is_null(rows["bucket"])).slice(0, 1)
    docs = [head[c].combine_chunks().flatten() for c in ("doc_ids", "n_features", "n_words")]
    total = np.zeros(len(docs[0]), np.int64)
    body = rows.filter(pc.is_valid(rows["bucket"]))
    if body.num_rows:
        places = [np.frombuffer(p, np.uint16) for p in body["places"].to_pylist()]
        counts = [np.frombuffer(c, np.uint8 if len(c) == len(p) else np.int64) for c, p in zip(body["counts"].to_pylist(), places, strict=True)]
        gain = np.repeat(body["gain"].to_numpy(), [len(p) for p in places])
        np.add.at(total, np.concatenate(places).astype(np.int64), gain * np.concatenate(counts).astype(np.int64))
    n = docs[1].to_numpy()
    return pa.table([*docs, total // np.maximum(n, 1)], schema=_SUMS)


def weights(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), size: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row of docs(doc_id, text); target(text) is the corpus to resemble."""
    own = store(postings(docs, runs, size), "resampling-postings")
    found = gains(own, postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, size), size)
    salted = found.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))).hint("shuffle_hash")
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS).cast("long")).alias("salt")
    gained = own.where("bucket IS NOT NULL").select("block", "bucket", "places", "counts", salt).join(salted, ["bucket", "salt"])
    none = lambda kind: F.lit(None).cast(kind)
    gained = gained.select("block", "bucket", "gain", "places", "counts", *[none("array<bigint>").alias(c) for c in ("doc_ids", "n_features", "n_words")])
    heads = own.where("bucket IS NULL").select("block", "bucket", none("bigint").alias("gain"), "places", "counts", "doc_ids", "n_features", "n_words")
    return gained.unionAll(heads).groupBy("block").applyInArrow(_summed, _SUMS_DDL)


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows(doc_id, score, eligible) with rank: 1, 2, .. for the ``draw`` eligible rows of the largest score, ties to smaller doc_ids (null last); else null."""
    none = F.lit(None).cast("long").alias("rank")
    if draw <= 0:
        return rows.select("*", none)
    # Scores are whole numbers of a narrow range (gains are logarithms times 1000): a few hundred thousand counts at most.
    by_score = rows.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    least = by_score.withColumn("upto", upto).where(F.col("upto") >= draw).agg(F.max("score")).first()[0]
    reach = F.col("eligible") & (F.col("score") >= F.lit(least))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"))
    first = rows.where(reach)
    # Copies of a row lie anywhere among themselves, so that many of them are many partitions.
    first = first.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("spread")).sortWithinPartitions(*order, "spread").drop("spread")
    first = store(first.withColumn("place", F.monotonically_increasing_id()), "resampling-order")
    part = F.shiftright("place", 33)
    sizes = first.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    first = first.join(F.broadcast(sizes), part == F.col("part")).select(*rows.columns, F.when(rank <= draw, rank).alias("rank"))
    return first.unionByName(rows.where(~reach).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, fewest: int = 20, seed: int = 2024, runs: tuple[int, int] = (1, 1), size: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every row of docs(doc_id, text).

    Of the N rows with at least ``fewest`` words the floor(percent * N / 100) largest scores are drawn.  Null and empty texts have no
    features, weight 0.  Rows that repeat count each; those without a doc_id share the noise of an empty name and come last among equal
    scores.  An empty target, or empty documents, give the gains that the formula has for counts of 0.
    """
    rows = weights(docs, target, runs, size)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = store(rows.withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= fewest), "resampling-scores")
    n = rows.where("eligible").count()
    return ranked(rows, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
