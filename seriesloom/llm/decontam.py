"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window (10 consecutive words of an item, or the whole item if shorter) is a sequence of 3-word shingles
(of fewer words if it has fewer).  A document holds it if it holds all of them at the right distances.

1. One pass over the documents keeps, of every whole text, the positions of shingles that any window has.  The
   windows' shingles are broadcast in blocks of BLOCK hashes (8 MB), one pass a block, so the benchmark may have any size.
2. Shingles are ordered by rarity, counted over all documents.  For full containment the necessary prefix is one
   token: only a window's rarest shingle is joined with the positions.  A shingle that no document has rules its windows out.
3. The match gives the window's start.  Bounds on position and length (it must lie inside the text) come first;
   then the other shingles that cover the window are joined at their positions, and all must be there.

Equal word sequences are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, store
from .minhash import WordHashes

WINDOW = 10
SHINGLE = 3
BLOCK = 1 << 20

#: Bytes as words see them: A-Z in lower case, other ASCII than digits and letters as space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, one per start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash_words(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key (16 bytes: equal for equal windows), length, size (words a shingle) and shingles of every window of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["item_id", "key", "length", "size", "shingles"]
        types = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of((text or "").encode())
                values = _hash_words(words, hashes)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[at : at + window]
                    size = min(SHINGLE, len(part))
                    found = shingle_hashes(values[at : at + window], size)
                    for column, x in zip(rows, (item, xxhash.xxh3_128_digest(b" ".join(part)), len(part), size, found.view(np.int64).tolist()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    return arrow(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item_id string, key binary, length int, size int, shingles array<bigint>")


def positions(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, digest (of the word sequence), n_words, at and shingle (parallel arrays) of every row; wanted: sorted hashes by shingle size."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    mask = np.uint64((1 << 22) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, looks = WordHashes(), {}
        for size, found in shared.value.items():
            looks[size] = np.zeros(1 << 22, np.bool_)
            looks[size][found & mask] = True
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                digests, counts, ats, found = [], [], [], []
                for text in part.column(1).cast(pa.binary()):
                    words = words_of(text.as_py() or b"")
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    counts.append(len(words))
                    values = _hash_words(words, hashes)
                    at, own = [], []
                    for size, sorted_hashes in shared.value.items():
                        h = shingle_hashes(values, size)
                        where = np.flatnonzero(looks[size][h & mask])
                        if len(where):
                            h = h[where]
                            real = sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h
                            at += where[real].tolist()
                            own += h[real].view(np.int64).tolist()
                    ats.append(at)
                    found.append(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "digest", "n_words", "at", "shingle"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, "doc_id bigint, text_hash bigint, digest binary, n_words bigint, at array<int>, shingle array<bigint>")


def _blocks(vocabulary: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """The vocabulary(size, shingle), at most about BLOCK hashes at a time; one empty block if there is none."""
    n = vocabulary.count()
    parts = max(1, -(-n * 5 // (BLOCK * 4)))
    for k in range(parts):
        table = vocabulary.where(F.pmod(F.xxhash64("shingle"), F.lit(parts)) == k).toArrow()
        size, shingle = table["size"].to_numpy(), table["shingle"].to_numpy().view(np.uint64)
        yield {int(s): np.sort(shingle[size == s]) for s in np.unique(size)}


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows(doc_id, text_hash, digest, n_words) of all docs; found(digest, start, length, key): where each window occurs."""
    distinct = store(windows.dropDuplicates(["key"]).select("key", "length", "size", "shingles"), "leak-windows")
    vocabulary = store(distinct.select("size", F.explode("shingles").alias("shingle")).distinct(), "leak-vocabulary")
    rows, spots = None, []
    for wanted in _blocks(vocabulary):
        one = store(positions(docs, wanted), "leak-positions")
        rows = one.select("doc_id", "text_hash", "digest", "n_words") if rows is None else rows
        spots.append(one.where("size(at) > 0").select("digest", "n_words", F.explode(F.arrays_zip("at", "shingle")).alias("x")).select("digest", "n_words", "x.at", "x.shingle"))
    spots = _union(spots)
    spots = store(spots.groupBy("digest", "at", "shingle").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies")), "leak-spots")

    rarity = spots.groupBy("shingle").agg(F.sum("copies").alias("n"))
    tokens = distinct.select("key", "length", "size", "shingles", F.posexplode("shingles").alias("offset", "shingle")).join(rarity, "shingle", "left")
    rarest = tokens.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("token"))
    keys = store(distinct.join(rarest.where("token.n > 0"), "key").select("key", "length", "size", "shingles", "token.shingle", "token.offset"), "leak-prefixes")
    start = (F.col("at") - F.col("offset")).alias("start")
    candidates = spots.join(keys, "shingle").where("at >= offset AND at - offset + length <= n_words").select("digest", start, "key", "length", "size", "shingles")
    # Every size-th shingle, and the last, cover the window.
    last = F.col("length") - F.col("size")
    needed = F.filter(F.sequence(F.lit(0), last), lambda i: (i % F.col("size") == 0) | (i == last))
    checks = candidates.select("digest", "start", "key", "length", F.size(needed).alias("needed"), F.explode(needed).alias("offset"), "shingles")
    checks = checks.select("digest", "start", "key", "length", "needed", (F.col("start") + F.col("offset")).alias("at"), F.get("shingles", F.col("offset")).alias("shingle"))
    met = checks.join(spots.select("digest", "at", "shingle"), ["digest", "at", "shingle"])
    found = met.groupBy("digest", "start", "key", "length").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return rows, store(found.select("digest", "start", "length", "key"), "leak-found")


def _union(frames: list[DataFrame]) -> DataFrame:
    while len(frames) > 1:
        frames = [frames[i].unionAll(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]


def document_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs(doc_id, text).

    Null texts have no words.  Items without words, or with a null item_id, match nothing (the latter's words still
    count as hit).  Repeated items count once.  Empty benchmark: nothing is hit.  Long texts count whole: a task holds the words of one at a time.
    """
    return _hits(docs, benchmark, window).drop("text_hash")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """document_hits, and the 64-bit hash of each row's text."""
    windows = store(windows_of(benchmark, window), "leak-items")
    rows, found = occurrences(docs, windows)
    before = Window.partitionBy("digest").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("digest", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("digest").agg(F.sum("new").alias("n_hit"))
    owners = windows.select("item_id", "key").where("item_id IS NOT NULL").distinct()
    items = found.select("digest", "key").distinct().join(owners, "key").groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    marks = store(hit.join(items, "digest", "left").select("digest", "n_hit", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.array_join("items", ",").alias("names")), "leak-marks")
    out = rows.join(marks, "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, unchanged.  Each is judged by its own text, whatever its doc_id (or none)."""
    bad = _hits(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("seriesloom_bad_id"), F.col("text_hash").alias("seriesloom_bad_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("seriesloom_bad_id")) & (F.xxhash64("text") == F.col("seriesloom_bad_hash"))
    return docs.join(store(bad, "leak-bad").hint("shuffle_hash"), same, "left_anti")
