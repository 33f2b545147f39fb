"""No stage loses or mixes up rows: null and repeated ids, null sources, columns without an order."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import decontam, minhash, mixing, quality
from seriesloom.llm.common import ROW_ID, one_per_id, with_ids

WORDS = [f"word{i}" for i in range(400)]


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


A, B, C = text(1), text(2), text(3)
NEAR_B = B.replace(B.split()[0], "changed", 1)


def docs(spark, rows):
    return spark.createDataFrame([(*r, {"k": "v"}) for r in rows], "doc_id long, text string, source string, meta map<string,string>")


def rows_of(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_keep_one_keeps_what_has_no_id(spark):
    table = docs(spark, [(1, A, "a"), (None, A, "a"), (None, B, "a"), (2, C, "b"), (None, None, "a"), (None, "", "a"), (3, C, "b")])
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    assert rows_of(kept) == Counter([(1, A), (None, B), (2, C), (None, None), (None, "")])
    # Of a group without any doc_id one stays.
    assert sum(rows_of(minhash.keep_one(docs(spark, [(None, B, "a"), (None, NEAR_B, "a"), (None, B, "b")]))).values()) == 1


def test_keep_one_with_repeated_ids(spark):
    assert rows_of(minhash.keep_one(docs(spark, [(1, A, "a"), (1, B, "a"), (2, NEAR_B, "a"), (5, C, "a")]))) == Counter([(1, min(A, B)), (5, C)])


def test_drop_contaminated_judges_every_row(spark):
    item = spark.createDataFrame([("i", " ".join(A.split()[:12]))], "item_id string, text string")
    table = docs(spark, [(None, A, "a"), (None, B, "a"), (None, None, "a"), (1, C, "a"), (1, A, "a"), (2, A + " " + B, "b")])
    clean = decontam.drop_contaminated(table, item)
    assert clean.columns == table.columns
    assert rows_of(clean) == Counter([(None, B), (None, None), (1, C)])


def test_repeat_documents_meets_targets_without_ids(spark):
    rows = [(None, text(i, 40 + i), "ab"[i % 2]) for i in range(40)] + [(i, text(100 + i, 50), "c") for i in range(10)] + [(1, text(900), "c")]
    table = docs(spark, rows)
    got = mixing.repeat_documents(table)
    assert got.columns == table.columns
    taken = Counter()
    for r in got.collect():
        taken[r.source] += len(r.text.split())
    unique = [r for r in one_per_id(table).collect()]
    sizes = Counter()
    for r in unique:
        sizes[r.source] += len(r.text.split())
    total = sum(sizes.values())
    for source, weight in (("a", 1), ("b", 2), ("c", 3)):
        want = min(3 * sizes[source], total * weight / 6)
        # No source is cut here but c, and its excess goes to the others.
        assert source != "c" or abs(taken["c"] - want) <= 60
    assert abs(sum(taken.values()) - total) <= 180


def test_a_null_source_is_a_pool_of_its_own(spark):
    """60 texts of (en, null) with many symbols each are normal among themselves; the small sources of en, without any, are another pool."""
    noisy = [(i, " ".join(w + "#" * (1 + (i + j) % 3) for j, w in enumerate(text(i).split())), None) for i in range(60)]
    plain = [(100 + i, text(200 + i), "ab"[i % 2]) for i in range(60)]
    table = docs(spark, noisy + plain).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.kept for r in quality.judge(table).collect()}
    assert all(got.values()) and len(got) == 120


@pytest.mark.parametrize("which", range(4))
def test_each_statistic_rejects_by_itself(spark, which):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        w = list(rng.choice(WORDS, 120, replace=False))
        if i < 6:
            if which == 0:
                w = [x * 3 for x in w]
            elif which == 1:
                w = [x + "#" if j % 15 == 0 else x for j, x in enumerate(w)]
            elif which == 3:
                w = w[:30] + w[:30] + w[60:]
                w = w[:59] + w[60:]
        lines = [" ".join(w[j : j + 8]) for j in range(0, len(w), 8)]
        if i < 6 and which == 2:
            lines += ["-"] * 7
        rows.append((i, "\n".join(lines), "a"))
    table = docs(spark, rows).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert all(got[i].kept for i in range(6, 120))
    assert not any(got[i].kept or got[i].base_failed for i in range(6)), [tuple(got[i]) for i in range(6)]


def test_row_ids_and_maps(spark):
    table = docs(spark, [(7, "x", "a"), (None, "y", "a"), (None, "y", "a"), (-3, "z", "a")])
    ids = {(r.doc_id, r[ROW_ID]) for r in with_ids(table).collect()}
    assert {(7, 7), (-3, -3)} < ids and len(ids) == 4 and min(i for d, i in ids if d is None) > 7
    assert with_ids(docs(spark, [(1 << 62, "x", "a"), (None, "y", "a")])).select(ROW_ID).distinct().count() == 2
    assert rows_of(one_per_id(docs(spark, [(1, "b", "a"), (1, "a", "a"), (None, "c", "a"), (None, "c", "a")]))) == Counter([(1, "a"), (None, "c"), (None, "c")])


def test_strays_in_a_large_bucket_make_few_pairs(spark):
    """A bucket of one component of 3,000 members and five strays: blocks and pairs of blocks grow with the members, and no pair of components is missed."""
    rows = [(1, i, 0) for i in range(3000)] + [(1, 5000 + i, 5000 + i) for i in range(5)] + [(2, i, 0) for i in range(500)] + [(3, 1, 0), (3, 7000, 7000)]
    apart = minhash.blocks_apart(spark.createDataFrame(rows, "bucket long, rep long, component long"))
    found = apart.groupBy("bucket", "block").agg(F.collect_set("component").alias("components"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.bucket for r in found} == {1, 3} and sum(r.n for r in found) == 3007
    one = [r for r in found if r.bucket == 1]
    pairs = [(x, y) for i, x in enumerate(one) for y in one[i:] if not (len(x.components) == len(y.components) == 1 and x.components == y.components)]
    assert len(pairs) <= 3000 / minhash.BLOCK + 5
    met = {(a, b) for x, y in pairs for a in x.components for b in y.components if a != b}
    met |= {(b, a) for a, b in met}
    assert all((a, b) in met for a in [0, *range(5000, 5005)] for b in [0, *range(5000, 5005)] if a != b)
