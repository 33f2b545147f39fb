"""Sharding by a k-d tree over document metadata.

The tree splits a node at the weighted median (weight: bytes) of its widest dimension until every
leaf holds the target bytes.  A median is found by counting, not by sorting: the position on a
dimension is a 62-bit number, and four aggregations, each over the next 15 or 16 bits, narrow it
down.  Each one shuffles a sum per node and digit, whatever the number of documents, so no task
ever holds the documents of a node.  Of a level with few nodes the driver holds the medians, a few numbers each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, utf8_bytes

#: Bits of a position: the dimension's value first, then the group, so that equal groups stay side by side.
VALUE_BITS, GROUP_BITS = 24, 38
#: Shifts and widths of the digits, most significant first.
DIGITS = ((46, 16), (30, 16), (15, 15), (0, 15))
#: Nodes of a level whose medians the driver holds (a few numbers each); those of larger levels stay in tables and are joined.
HELD = 64
#: Rows that one task numbers.
SLOT_ROWS = 10_000


def _narrow(rows: DataFrame, nodes: DataFrame, position: str) -> DataFrame:
    """nodes(node, want) with the smallest ``at`` where the bytes up to it reach ``want``; ``below``: bytes before it, ``on``: at it."""
    found = nodes.select("node", "want", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below"))
    for shift, width in DIGITS:
        digit = F.shiftrightunsigned(F.col(position), shift).bitwiseAND(F.lit((1 << width) - 1))
        at_prefix = F.shiftrightunsigned(F.col(position), shift + width) == F.shiftrightunsigned(F.col("at"), shift + width)
        sums = (
            rows.join(found.select("node", "at"), "node")
            .where(at_prefix)
            .groupBy("node", digit.alias("digit"))
            .agg(F.sum("bytes").alias("digit_bytes"))
        )
        upto = F.sum("digit_bytes").over(Window.partitionBy("node").orderBy("digit"))
        found = store(
            sums.withColumn("upto", upto)
            .join(found, "node")
            .where(F.col("below") + F.col("upto") >= F.col("want"))
            .groupBy("node")
            .agg(
                F.first("want").alias("want"),
                F.first("at").alias("at"),
                F.first("below").alias("below"),
                F.min(F.struct("digit", "upto", "digit_bytes")).alias("hit"),
            )
            .select(
                "node",
                "want",
                F.col("at").bitwiseOR(F.shiftleft(F.col("hit.digit"), shift)).alias("at"),
                (F.col("below") + F.col("hit.upto") - F.col("hit.digit_bytes")).alias("below"),
                F.col("hit.digit_bytes").alias("on"),
            ),
            "kd-median",
        )
    return found


def _held(values: dict[int, int | float | str]) -> Column:
    """The value of the row's node, null for nodes without one."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for node, value in values.items() for x in (F.lit(node).cast("long"), value)]), F.col("node"))


def _narrow_held(rows: DataFrame, want: dict[int, float], position: str) -> dict[int, tuple[int, int, int]]:
    """What _narrow finds (at, below, on) for nodes that the driver holds: one job a digit, without joins."""
    found = {node: (0, 0, 0) for node in want}
    for shift, width in DIGITS:
        at, below = ({node: F.lit(x[i]).cast("long") for node, x in found.items()} for i in (0, 1))
        digit = F.shiftrightunsigned(F.col(position), shift).bitwiseAND(F.lit((1 << width) - 1))
        at_prefix = F.shiftrightunsigned(F.col(position), shift + width) == F.shiftrightunsigned(_held(at), shift + width)
        sums = rows.where(at_prefix).groupBy("node", digit.alias("digit")).agg(F.sum("bytes").alias("digit_bytes"))
        upto = F.sum("digit_bytes").over(Window.partitionBy("node").orderBy("digit"))
        hits = sums.withColumn("upto", upto).where(_held(below) + F.col("upto") >= _held(want)).groupBy("node").agg(F.min(F.struct("digit", "upto", "digit_bytes")).alias("hit"))
        found = {r.node: (found[r.node][0] | r.hit.digit << shift, found[r.node][1] + r.hit.upto - r.hit.digit_bytes, r.hit.digit_bytes) for r in hits.collect()}
    return found


def kd_shards(
    items: DataFrame,
    dims: Sequence[str],
    bytes_col: str,
    group: Sequence[str],
    ties: Sequence[str],
    n_shards: int | None = None,
    target_bytes: int | None = None,
    group_tolerance: float = 0.01,
) -> DataFrame:
    """Add ``shard`` (0 to the number of leaves less 1) and ``slot`` (0 on, without gaps in a shard).

    items: one row per document; ``bytes_col`` a positive long, ``dims`` numbers (null and NaN: as the
    smallest value).  ``n_shards``, or else ``target_bytes``, sets the number of leaves.  A node of k
    leaves is split at the floor(k/2)/k weighted quantile of the dimension that is widest in it (largest
    minus smallest value, as a part of that dimension's whole range; ties: the first).

    Rows that agree in ``group`` share every position if ``dims`` depend on the group alone, and then
    stay together, unless the one group at the median would put a side off by more than
    ``group_tolerance`` of a leaf's bytes: such a group is cut by the hash of ``ties``.  Rows that
    agree in ``ties`` too are never separated.  Columns that clash with ``shard`` or ``slot`` are
    replaced.  Empty input: empty output.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give either n_shards or target_bytes")
    own = [c for c in items.columns if c not in ("shard", "slot")]
    value = [F.coalesce(F.nanvl(F.col(f"`{d}`").cast("double"), F.lit(None).cast("double")), F.lit(None).cast("double")) for d in dims]
    ends = items.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(bytes_col), F.lit(0)).alias("bytes"),
        *[f(v).alias(f"{n}{i}") for i, v in enumerate(value) for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    leaves = max(1, n_shards if n_shards is not None else -(-ends["bytes"] // max(1, target_bytes)))
    group_hash = F.xxhash64(*[F.col(f"`{c}`") for c in group]).bitwiseAND(F.lit((1 << GROUP_BITS) - 1))

    def position(i: int, v: Column) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        part = (v - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0)
        code = F.floor(F.coalesce(part, F.lit(0.0)) * F.lit((1 << VALUE_BITS) - 1)).cast("long")
        return F.shiftleft(code, GROUP_BITS).bitwiseOR(group_hash)

    narrow = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)]
    rows = store(
        items.select(
            *narrow,
            F.col(f"`{bytes_col}`").cast("long").alias("bytes"),
            *[position(i, v).alias(f"dim{i}") for i, v in enumerate(value)],
            F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in [*ties, *group]]), 2).alias("tie"),
            F.lit(0).cast("long").alias("node"),
            F.lit(0).alias("first"),
            F.lit(leaves).alias("leaves"),
        ),
        "kd-rows",
    )
    size, level = leaves, 0
    while size > 1:
        rows = _split(rows, len(dims), group_tolerance, 1 << level <= HELD)
        size, level = -(-size // 2), level + 1
    return _slots(rows.select(*[f"own_{i}" for i in range(len(own))], "tie", F.col("first").alias("shard")), ends["rows"] or 0, leaves).select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], "shard", "slot"
    )


def _split(rows: DataFrame, n_dims: int, tolerance: float, held: bool) -> DataFrame:
    """One level: every node of two leaves or more is split; held: the driver holds the medians."""
    open_rows = rows.where("leaves > 1")
    spread = [F.max(f"dim{i}") - F.min(f"dim{i}") for i in range(n_dims)]
    nodes = open_rows.groupBy("node").agg(F.sum("bytes").alias("all"), F.first("leaves").alias("k"), *[s.alias(f"w{i}") for i, s in enumerate(spread)])
    best = F.greatest(*[F.col(f"w{i}") for i in range(n_dims)]) if n_dims > 1 else F.col("w0")
    widest = reduce(lambda other, i: F.when(F.col(f"w{i}") == best, F.lit(i)).otherwise(other), reversed(range(n_dims)), F.lit(0))
    nodes = nodes.select("node", "k", (F.col("all") / F.col("k")).alias("share"), widest.alias("dim"), (F.col("all") * F.floor(F.col("k") / 2) / F.col("k")).alias("want"))
    along = reduce(lambda other, i: F.when(F.col("dim") == i, F.col(f"dim{i}")).otherwise(other), range(n_dims), F.col("dim0"))
    out = _cut_held(rows, nodes, along, tolerance) if held else _cut_joined(rows, store(nodes, "kd-nodes"), along, tolerance)
    left = (F.col("along") < F.col("at")) | (
        (F.col("along") == F.col("at")) & ((F.col("side") == "after") | ((F.col("side") == "inside") & (F.col("tie") <= F.col("tie_at"))))
    )
    low = F.floor(F.col("leaves") / 2).cast("int")
    is_open = F.col("dim").isNotNull()
    out = out.withColumn("left", F.coalesce(left, F.lit(True)))
    return store(
        out.select(
            *[c for c in rows.columns if c not in ("node", "first", "leaves")],
            F.when(is_open, F.col("node") * 2 + 1 + F.when(F.col("left"), 0).otherwise(1)).otherwise(F.col("node")).alias("node"),
            F.when(is_open & ~F.col("left"), F.col("first") + low).otherwise(F.col("first")).alias("first"),
            F.when(~is_open, F.col("leaves")).when(F.col("left"), low).otherwise(F.col("leaves") - low).alias("leaves"),
        ),
        "kd-rows",
    )


def _cut_held(rows: DataFrame, nodes: DataFrame, along: Column, tolerance: float) -> DataFrame:
    """What _cut_joined returns, for few nodes."""
    known = {r.node: r for r in nodes.collect()}
    placed = rows.withColumn("dim", _held({node: r.dim for node, r in known.items()}).cast("int")).withColumn("along", along)
    here = placed.where(F.col("dim").isNotNull()).select("node", "bytes", "along", "tie")
    cut = _narrow_held(here, {node: r.want for node, r in known.items()}, "along")
    before = {node: known[node].want - below for node, (_, below, _) in cut.items()}
    after = {node: below + on - known[node].want for node, (_, below, on) in cut.items()}
    side = {node: "inside" if min(before[node], after[node]) > tolerance * known[node].share else "before" if before[node] < after[node] else "after" for node in cut}
    inside = {node: before[node] for node in cut if side[node] == "inside"}
    at = {node: F.lit(x[0]).cast("long") for node, x in cut.items()}
    ties = {}
    if inside:
        groups = here.where(F.col("along") == _held({node: at[node] for node in inside})).select("node", "bytes", "tie")
        ties = {node: F.lit(x[0]).cast("long") for node, x in _narrow_held(groups, inside, "tie").items()}
    return placed.select("*", _held(at).cast("long").alias("at"), _held(side).cast("string").alias("side"), _held(ties).cast("long").alias("tie_at"))


def _cut_joined(rows: DataFrame, nodes: DataFrame, along: Column, tolerance: float) -> DataFrame:
    """rows with dim and along, the node's widest dimension and the position on it, and at, side and tie_at, where the node is cut."""
    placed = rows.join(nodes.select("node", "dim"), "node", "left").withColumn("along", along)
    here = placed.where(F.col("dim").isNotNull()).select("node", "bytes", "along", "tie")
    cut = _narrow(here, nodes, "along").join(nodes.select("node", "share"), "node")
    before, after = F.col("want") - F.col("below"), F.col("below") + F.col("on") - F.col("want")
    cut = store(
        cut.select(
            "node",
            "at",
            F.when(F.least(before, after) > F.lit(tolerance) * F.col("share"), F.lit("inside")).when(before < after, F.lit("before")).otherwise(F.lit("after")).alias("side"),
            before.alias("want"),
        ),
        "kd-cuts",
    )
    inside = cut.where("side = 'inside'")
    ties = cut.select("node", F.lit(None).cast("long").alias("tie_at"))
    if inside.limit(1).count():
        groups = here.join(inside.select("node", "at", "want"), "node").where("along = at").select("node", "bytes", "tie")
        ties = _narrow(groups, inside.select("node", "want"), "tie").select("node", F.col("at").alias("tie_at"))
        ties = cut.select("node").join(ties, "node", "left")
    return placed.join(cut.select("node", "at", "side"), "node", "left").join(ties, "node", "left")


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Number the rows of a shard: a window per bucket of about SLOT_ROWS rows, plus the rows of the buckets before it."""
    buckets = max(1, -(-n // (SLOT_ROWS * shards)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    before = F.sum("bucket_rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("bucket_rows")
    bases = sizes.select("shard", "bucket", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", *[c for c in rows.columns if c.startswith("own_")]))
    return rows.withColumn("inside", inside).join(bases, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.col("inside") - 1).cast("long"))


def document_items(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the metadata of a text: log2 of its bytes, bytes a character, characters a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.char_length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.log2(utf8_bytes(F.col("text")) + 1).alias("log_bytes"),
        (F.octet_length(text) / F.greatest(chars, F.lit(1))).alias("bytes_per_char"),
        F.log2(chars / lines + 1).alias("line_chars"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every document.

    Null text: size 1, CRC of no bytes.  Equal texts share a shard unless their group is too large for that.
    Rows that are equal in doc_id and text share a shard and get slots of their own.
    """
    items = store(document_items(docs), "kd-items")
    out = kd_shards(items, ("log_bytes", "bytes_per_char", "line_chars"), "size", ("text_hash",), ("doc_id",), n_shards=n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
