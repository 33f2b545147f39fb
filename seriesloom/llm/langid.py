"""Language identification: multinomial naive Bayes over hashed character 2- and 3-grams.

Counts of (language, bucket) come from all training documents: each task sums its own rows, and the
shuffle adds up at most BUCKETS numbers per task and language.  The matrix of log probabilities
(BUCKETS rows, one column per language) is broadcast in blocks of BLOCK languages, 64 MB each; with several
blocks a text has a row for each, which are put together by its row.  Texts are scored whole, in pieces, with numpy:
a text's buckets are a sparse row of counts, and a batch's scores a gather of matrix rows, summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, store

BUCKETS = 1 << 16
BLOCK = 256
SMOOTHING = 0.5
#: Characters that are hashed at once.
PIECE = 1 << 18


@dataclass
class Model:
    """languages in code point order; counts(lang, bucket, n): the stored counts; prior: log share of training documents."""

    languages: list[str]
    counts: DataFrame
    prior: np.ndarray

    def weights(self, start: int) -> np.ndarray:
        """float32, (BUCKETS, languages) of the block that begins at a language: log probabilities."""
        names = self.languages[start : start + BLOCK]
        table = self.counts.where(F.col("lang").between(names[0], names[-1]) & (F.col("bucket") >= 0)).toArrow()
        index = {lang: i for i, lang in enumerate(names)}
        matrix = np.full((BUCKETS, len(names)), SMOOTHING)
        matrix[table["bucket"].to_numpy(), np.array([index[x] for x in table["lang"].to_pylist()], np.int64)] += table["n"].to_numpy()
        return np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """The buckets of all 2- and 3-grams of a text, a piece at a time; case and runs of white space don't count."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        if at + PIECE + 2 < len(text):
            two = two[:-1]
        yield np.concatenate(((two ^ (two >> 15)) * np.uint32(0x2C1B3C6D) >> 16, (three ^ (three >> 15)) * np.uint32(0x297A2D39) >> 16))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame) -> Model:
    """Learn from (text, lang) of all rows with a language; null texts count for the prior only.

    No rows: a model without languages, which predicts ``und``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                documents[lang] = documents.get(lang, 0) + 1
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for b in buckets_of(text or ""):
                    if len(b) < BUCKETS // 8:
                        np.add.at(own, b, 1)
                    else:
                        own += np.bincount(b, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([documents[lang], *own[at].tolist()], pa.int64())], ["lang", "bucket", "n"])

    counts = arrow(docs.select("text", "lang").where("lang IS NOT NULL"), count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = store(counts, "langid-counts")
    documents = {r.lang: r.n for r in counts.where("bucket = -1").select("lang", "n").collect()}
    languages = sorted(documents)
    prior = np.array([documents[x] for x in languages], np.float64)
    return Model(languages, counts, np.log(prior / max(prior.sum(), 1)))


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score (posterior probability of lang_pred) of every row.

    Null texts, texts without a letter, and all texts if the model has no language: ``und``, score 0.
    Ties go to the language that comes first.  Rows that repeat are predicted each; an empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    own = [*docs.select(*kept).schema.fields]
    starts = range(0, len(model.languages), BLOCK) or range(1)
    if len(starts) == 1:
        score = F.when(F.col("rest") == 0, F.lit(0.0)).otherwise(1 / F.nullif("rest", F.lit(0.0)))
        return _scored(docs.select(*kept, "text"), model, 0).select(*kept, "lang_pred", score.alias("score"))
    rows = store(docs.select(*[c.alias(f"own_{i}") for i, c in enumerate(kept)], "text", F.monotonically_increasing_id().alias("row")), "langid-rows")
    parts = [_scored(rows.select("row", "text"), model, at) for at in starts]
    parts = store(reduce(DataFrame.unionAll, parts), "langid-parts")
    best = parts.groupBy("row").agg(F.max(F.struct("top", (-F.col("at")).alias("first"), "lang_pred", "rest")).alias("best"), F.collect_list(F.struct("top", "rest")).alias("blocks"))
    # One number for each block of languages.
    total = F.aggregate("blocks", F.lit(0.0), lambda a, x: a + x["rest"] * F.exp(x["top"] - F.col("best.top")))
    best = best.select("row", "best.lang_pred", F.when(F.col("best.rest") == 0, F.lit(0.0)).otherwise(1 / F.nullif(total, F.lit(0.0))).alias("score"))
    return rows.drop("text").join(best, "row").select(*[F.col(f"own_{i}").alias(f.name) for i, f in enumerate(own)], "lang_pred", "score")


def _scored(rows: DataFrame, model: Model, start: int) -> DataFrame:
    """rows without text, and lang_pred, top (its log posterior, not normalised), rest (the sum of all of the block over it; 0 for ``und``) and at."""
    names = model.languages[start : start + BLOCK]
    shared = rows.sparkSession.sparkContext.broadcast((names, model.weights(start) if names else None, model.prior[start : start + BLOCK]))
    keep = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("lang_pred string, top double, rest double, at int").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, prior = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            said, tops, rests = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if names and has_letter(t)]
            held: list[np.ndarray] = []
            owner: list[int] = []
            sums = np.tile(prior, (len(texts), 1)) if names else np.zeros((len(texts), 0))

            def add() -> None:
                """A sparse batch: the buckets of several texts in a row, with where each text's begin."""
                begin = np.cumsum([0, *map(len, held[:-1])])
                np.add.at(sums, owner, np.add.reduceat(weights.take(np.concatenate(held), axis=0), begin, axis=0, dtype=np.float64))
                held.clear()
                owner.clear()

            for i in real:
                for b in buckets_of(texts[i]):
                    held.append(b)
                    owner.append(i)
                    if sum(map(len, held)) > PIECE // 16:
                        add()
            if held:
                add()
            for i in real:
                at = int(sums[i].argmax())
                said[i], tops[i], rests[i] = names[at], sums[i, at], np.exp(sums[i] - sums[i, at]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(said, pa.string()), pa.array(tops), pa.array(rests), pa.array([start] * len(texts), pa.int32())], schema.names)

    return arrow(rows, score, schema)
