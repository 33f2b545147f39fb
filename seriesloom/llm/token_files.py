"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A folder holds, for every partition of the ascending document order,

* ``ids-NNNNNN.bin``: the ids, little-endian unsigned integers, 16 bits if the vocabulary fits, else 32;
* ``offsets-NNNNNN.bin``: 64-bit positions in ids, one for each document and one for the end;
* ``documents-NNNNNN.bin``: 64-bit document ids (a null one: the smallest 64-bit number);

and the table ``partitions`` (Parquet) with the names, counts and ``base`` of each, the ids that all
partitions before it hold: a prefix sum.  Files are written under names of the attempt's own and then
renamed, so a task that runs again after an executor was lost replaces its own files and no others.
The folder must be a mounted one (``file:`` or a plain path), as the files are memory-mapped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
NULL_ID = np.iinfo(np.int64).min
#: Rows that are read back at once; rows and bytes that are encoded at once (one longer text is by itself).
ROWS = 512
MOST_ROWS, MOST_BYTES = 4_000, 1 << 24


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped; {path} is not in a mounted folder")
    return parts.path


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them.

    This vocabulary's rules drop white space, never join pieces across it, and cut between a letter and the
    ASCII signs after it, so a text's ids are those of its pieces between ASCII white space, and a piece's those of
    its stem and of the signs at its end.  A letter whose normal form ends in a combining mark is no such letter: the
    mark and the signs are one piece, and the library encodes the whole.  Arrow cuts a batch of texts and finds its distinct pieces.  The library
    encodes each new stem once (many at a time, with a sign between that no stem of letters holds); it is then
    remembered.  Texts that may hold a special token's name go to the library whole.
    """

    SIGNS = ".,;:!?|*#$%&"
    #: Pieces and stems that are remembered.
    MEMO = 600_000

    def __init__(self, path: str, dtype: str) -> None:
        self.tokenizer, self.dtype = _tokenizer(path), np.dtype(dtype)
        self.memo: dict[str, bytes] = {"": b""}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.apart: dict[str, bool] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _stands_apart(self, last: str) -> bool:
        """Whether a sign after this character begins a piece of its own; of others than ASCII the library is asked once."""
        if last.isascii():
            return last.isalnum()
        if last not in self.apart:
            self.apart[last] = last.isalnum() and np.array_equal(self._ids(last + ","), np.concatenate((self._ids(last), self._ids(","))))
        return self.apart[last]

    def _learn_stems(self, stems: list[str]) -> None:
        letters = [s for s in stems if s.isalpha()] if len(self.mark) == 1 else []
        width = self.dtype.itemsize
        for at in range(0, len(letters), 1024):
            part = letters[at : at + 1024]
            ids = self._ids(" | ".join(part))
            ends = [*(np.flatnonzero(ids == self.mark[0]) * width).tolist(), len(ids) * width]
            raw, start = ids.tobytes(), 0
            for stem, end in zip(part, ends, strict=True):
                self.memo[stem] = raw[start:end]
                start = end + width
        for stem in stems:
            if stem not in self.memo:
                self.memo[stem] = self._ids(stem).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        memo, signs = self.memo, self.SIGNS
        stems, cut = [], []
        for piece in pieces:
            if piece[-1] in signs:
                stem = piece.rstrip(signs)
                # What is before the signs must end in a letter or digit, in its normal form too, else they may belong to a longer run.
                if stem and self._stands_apart(stem[-1]):
                    cut.append((piece, stem, piece[len(stem) :]))
                    stems += (stem, piece[len(stem) :])
                    continue
            stems.append(piece)
        self._learn_stems([x for x in set(stems) if x not in memo])
        for piece, stem, end in cut:
            memo[piece] = memo[stem] + memo[end]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each; no text is null."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.memo) > self.MEMO:
            self.memo = {"": b""}
        self._learn([p for p in pieces if p not in self.memo])
        found = list(map(self.memo.__getitem__, pieces))
        table, sizes = np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        which = coded.indices.to_numpy()
        own = sizes[which]
        ends = np.concatenate(([0], np.cumsum(own)))
        first = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        ids = table[np.repeat(first, own) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.diff(ends[offsets])
        for special in self.special:
            for at in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)):
                whole = np.array(self.tokenizer.encode(texts[int(at)].as_py(), add_special_tokens=False).ids, self.dtype)
                start = counts[:at].sum()
                ids, counts[at] = np.concatenate((ids[:start], whole, ids[start + counts[at] :])), len(whole)
        return ids, counts


@lru_cache(maxsize=1)
def _encoder(path: str, dtype: str) -> Encoder:
    """One for each worker process: what it remembers serves its next tasks too."""
    return Encoder(path, dtype)


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (doc_id, text) within MOST_ROWS and MOST_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and (held + size > MOST_BYTES or i - at >= MOST_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``text`` (null: empty) of every row, append ``end_id`` and write in ascending order of doc_id, nulls first.

    Rows with equal doc_id follow each other in the order of their texts.  An empty table gives a folder with no ids;
    a folder that is there already is an error.  Long texts are encoded whole, one at a time; other columns are not looked at.
    """
    spark, folder, tokenizer = docs.sparkSession, local_path(path), tokenizer or default_tokenizer()
    dtype = "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    os.makedirs(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, own = _encoder(tokenizer, dtype), TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{k}-{part:06d}.bin" for k in ("ids", "offsets", "documents")]
        at, n = 0, 0
        files = [open(f"{folder}/.{own}-{x}", "wb") for x in names]
        files[1].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for piece in pieces_of(batch):
                ids, counts = encoder(pc.fill_null(piece.column(1), ""))
                own = np.cumsum(counts)
                files[0].write(np.insert(ids, own, end_id).tobytes())
                ends = at + np.cumsum(counts + 1, dtype="<i8")
                files[1].write(ends.tobytes())
                files[2].write(np.array([NULL_ID if x is None else x for x in piece.column(0).to_pylist()], "<i8").tobytes())
                at, n = int(ends[-1]), n + len(counts)
        for f, x in zip(files, names, strict=True):
            f.close()
            os.replace(f.name, f"{folder}/{x}")
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [n], "ids": [at], "dtype": [dtype]}, pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("dtype", pa.string())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows that share a doc_id (or have none) spread by how their texts begin.
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    found = arrow(ordered, encode, "part int, documents bigint, ids bigint, dtype string")
    # One row per partition.
    spark.createDataFrame(found.toArrow()).withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).coalesce(1).write.parquet(f"{path}/partitions")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and token_ids (little-endian unsigned 32-bit) of every document, from the mapped files."""
    folder = local_path(path)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["documents"]:
                    continue
                ids, offsets, documents = (np.memmap(f"{folder}/{k}-{row['part']:06d}.bin", t, "r") for k, t in (("ids", row["dtype"]), ("offsets", "<i8"), ("documents", "<i8")))
                for at in range(0, row["documents"], ROWS):
                    to = min(at + ROWS, row["documents"])
                    who = documents[at:to]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(who), mask=np.array(who == NULL_ID)),
                        pa.array(row["base"] + np.array(offsets[at:to])),
                        pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[at:to], offsets[at + 1 : to + 1], strict=True)], pa.binary()),
                    ], ["doc_id", "start", "token_ids"])

    parts = spark.read.parquet(f"{path}/partitions")
    n = max(1, parts.count())
    return arrow(parts.repartitionByRange(n, "part"), load, "doc_id bigint, start bigint, token_ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of ``read``'s rows."""
    return tokens.select("doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))
