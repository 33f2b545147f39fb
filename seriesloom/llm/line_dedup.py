"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles, in lower case; a line of fewer words is one token.  Lines of
equal words form a class, represented by its first line.  Classes with a Jaccard similarity of PERCENT hundredths
or more are linked.

* Sketch: a line keeps the first n - ceil(t n) + s tokens in the order of their hashes, s (`_spare`) growing with n; two linked classes share s of
  them, s by the smaller one.  Tokens are counted by class; a class with fewer tokens in its sketch that others have can't be linked, and most
  go here.  Only the rest is cut into all of its tokens.
* Classes: lines are folded to classes, by combinable sums; a line that occurs a billion times is one class from here on.
* Rarity: the tokens of the classes left are counted and ordered by their counts.  A class that has more than n - ceil(t n) tokens for itself goes, too.
* Prefix: two linked classes share one of the first n - ceil(t n) + 1 tokens of the larger and of the first
  n - ceil(2 t n / (1 + t)) + 1 tokens of the smaller.
* Blocks: each class is put to its token that most classes have, and the classes of a token are cut into blocks of
  about BLOCK_TOKENS tokens.  Two blocks are compared if some class of one and some class of the other share a prefix token, their
  sizes allow the similarity (length), and so do the tokens that follow the shared one (position).
* Verification: sets whose parities differ in too many bits can't be linked; the others are compared in full.  A row holds two blocks with the whole token sets of their classes and gives the links of each class.  So no row
  is made for a pair of classes, and large groups of near copies make rows by blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, store

#: What separates words within a line, the space first.
BLANKS = " \t\x0b\x0c\r"
SHINGLE = 5
PERCENT = 75
#: A sketch has a token more for so many tokens of its line, and linked classes share one more.
SPARE = 16
#: 64-bit words of the parities that a pair is compared by first.
WORDS = 4
#: Tokens of the classes in one block.
BLOCK_TOKENS = 32_768
#: Lines to verify that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Shared prefix tokens that are broadcast at most (16 bytes each and the hash table); more are joined by a shuffle.
BROADCAST_TOKENS = 2_000_000
#: Classes that hold more than a HOT-th of all lines: fewer than HOT, so they are broadcast.
HOT, SALTS = 1_000, 64
#: Bits of line_no where it is held in one number with doc_id.
LINE_BITS = 24


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, keep, line_no (from 0) and line (in lower case) of every line with a word."""
    line = docs.select("doc_id", *keep, F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
    # A trim from the left ends at the first word; one from both sides walks the whole line, and a filter on it would have it done twice.
    return line.where(F.ltrim("line", F.lit(BLANKS)) != "")


def _keyed(lines: DataFrame, *keep: str) -> DataFrame:
    """doc_id, keep, line_no, norm (words of the line, one space between), k1 and k2 (a hash of it)."""
    line = lines.select("doc_id", *keep, "line_no", F.trim("line", F.lit(BLANKS)).alias("line"))
    # Most lines have single spaces: finding that out is much cheaper than a replacement at every space.
    odd = reduce(lambda a, b: a | b, [F.contains("line", F.lit(x)) for x in ("  ", *BLANKS[1:])])
    norm = line.select("doc_id", *keep, "line_no", F.when(odd, F.regexp_replace("line", SPACE, " ")).otherwise(F.col("line")).alias("norm"))
    return norm.select("*", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"))


def _with_tokens(frame: DataFrame) -> DataFrame:
    """frame(norm, ...) with tokens, its distinct shingles (fewer words: one token), and full (whether it has the words of a shingle) for norm.

    Functions of elements are interpreted one by one.  So words are hashed by one, slices of the hashes zipped in a step of its own, by
    generated code, and the zipped numbers hashed by another.
    """
    keep = [c for c in frame.columns if c != "norm"]
    hashed = frame.select(*keep, F.transform(F.split("norm", " "), lambda x: F.xxhash64(x)).alias("hashes"))
    n = F.greatest(F.size("hashes") - SHINGLE + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("hashes", at + 1, n).alias(f"w{at}") for at in range(SHINGLE)])
    rows = hashed.select(*keep, F.xxhash64("hashes").alias("whole"), zipped.alias("shingles"))
    full = F.size("shingles") > 0
    tokens = F.when(full, F.array_distinct(F.transform("shingles", lambda x: F.xxhash64(x)))).otherwise(F.array("whole"))
    return rows.select(*keep, full.alias("full"), tokens.alias("tokens"))


def _bits(tokens: Column) -> Column:
    """WORDS 64-bit parities of tokens: two sets differ in at least as many tokens as their parities do in bits."""
    word = lambda k: F.filter(tokens, lambda t: F.shiftrightunsigned(t, 58).bitwiseAND(F.lit(WORDS - 1)) == k)
    parity = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(t, 52).bitwiseAND(F.lit(63)).cast("int"))))
    return F.array(*[parity(word(k)) for k in range(WORDS)])


def _at_least(share: float, n: Column) -> Column:
    """ceil(share * n), safe against rounding."""
    return F.ceil(F.lit(share) * n - 1e-9)


def _spare(n: Column) -> Column:
    """How many tokens of a sketch two linked classes share at least, if n is the size of the one with fewer."""
    return F.floor(n / SPARE).cast("int") + 1


def line_sketches(docs: DataFrame, percent: int = PERCENT, *keep: str) -> DataFrame:
    """doc_id, keep, line_no, k1, k2, n and sketch (null if no other line can have the token) of every line with a word; the only pass that hashes all words."""
    rows = _with_tokens(_keyed(_lines(docs, *keep), *keep)).withColumn("tokens", F.sort_array("tokens"))
    n = F.size("tokens")
    # A line of few words is a token of its own; one that repeats its only shingle can be linked with others that do.
    sketch = F.when(F.col("full"), F.slice("tokens", 1, n - _at_least(percent / 100, n).cast("int") + _spare(n)))
    return store(rows.select("doc_id", *keep, "line_no", "k1", "k2", n.alias("n"), sketch.alias("sketch")), "line-sketches")


def _places_fit(lines: DataFrame) -> bool:
    """Whether doc_id (an integer, nowhere null) and line_no fit a long together, LINE_BITS of it for line_no."""
    if not isinstance(lines.schema["doc_id"].dataType, T.IntegralType):
        return False
    r = lines.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("line_no").alias("line_no"), F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("rows")).first()
    bound = 1 << (63 - LINE_BITS)
    return 0 < r.rows == r.ids and -bound <= r.least and r.most < bound and r.line_no < 1 << LINE_BITS


def line_classes(lines: DataFrame) -> DataFrame:
    """id, k1, k2, first (its first line: last, doc_id, line_no), lines and n of every class."""
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    if not _places_fit(lines):
        classes = lines.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("lines"), F.min("n").alias("n"))
    else:
        # Least numbers are found by hashing, least structs by sorting.
        doc, line = lines.schema["doc_id"].dataType, lines.schema["line_no"].dataType
        place = F.shiftleft(F.col("doc_id").cast("long"), LINE_BITS).bitwiseOR(F.col("line_no").cast("long"))
        found = lines.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("lines"), F.min("n").alias("n"))
        first = F.struct(F.lit(False).alias("last"), F.shiftright("place", LINE_BITS).cast(doc).alias("doc_id"), F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast(line).alias("line_no"))
        classes = found.select("k1", "k2", first.alias("first"), "lines", "n")
    return store(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")


def candidates(lines: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The classes that share enough of their sketch with others to be linked with any."""
    spread = lines.select("k1", F.explode("sketch").alias("token"))
    # A token of one class only has one k1: counts of lines would take a line that repeats for many.
    shared = spread.groupBy("token").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least <> most").select("token")
    shared = store(shared, "line-shared")
    few = shared.count() <= BROADCAST_TOKENS
    hits = spread.join(F.broadcast(shared) if few else shared, "token").groupBy("k1").agg(F.count(F.lit(1)).alias("hits"))
    # Each line of a class brings the same hits.
    enough = F.col("hits") >= F.col("lines") * _spare(_at_least(percent / 100, F.col("n")))
    return store(classes.join(hits, "k1").where(enough).select("id", "k1", "k2", "first"), "line-wanted")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, first and tokens of the wanted classes, from their first lines."""
    few = wanted.count() <= BROADCAST_LINES
    hint = F.broadcast if few else (lambda frame: frame)
    lines = docs.select("doc_id", "text")
    if few:
        # Texts and lines that aren't wanted go before they are trimmed and hashed.
        places = wanted.select(F.col("first.doc_id").alias("wanted_id"), F.col("first.line_no").alias("wanted_no")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("wanted_id"))
        lines = _lines(lines.join(F.broadcast(places.select("wanted_id").distinct()), same, "left_semi"))
        lines = lines.join(F.broadcast(places), same & (F.col("line_no") == F.col("wanted_no")), "left_semi")
    else:
        lines = _lines(lines)
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    found = _keyed(lines).join(hint(wanted), ["k1", "k2"]).where(here)
    # Rows that repeat a document give its lines again.
    once = found.groupBy("id").agg(F.first("first").alias("first"), F.first("norm").alias("norm"))
    return store(_with_tokens(once).select("id", "first", "tokens"), "line-sets")


def rare_tokens(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n, home (its token that most classes have), at and prefix (its rarest tokens that others have, from place ``at`` on) of the classes that may be linked.

    A class that has more tokens for itself than two linked ones differ by is left out.
    """
    spread = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).repartition("token")
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = spread.join(counts.hint("shuffle_hash"), "token")
    ranked = members.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "token"))).alias("ranked"))
    at = F.col("n") - F.size("ranked")
    ranked = ranked.where(F.size("ranked") >= _at_least(percent / 100, F.col("n")))
    length = F.col("n") - _at_least(percent / 100, F.col("n")).cast("int") + 1 - at
    prefix = F.transform(F.slice("ranked", 1, length), lambda x: x["token"])
    return store(ranked.select("id", "n", F.element_at("ranked", -1)["token"].alias("home"), at.alias("at"), prefix.alias("prefix")), "line-ranked")


def _may_link(a: Column, b: Column, t: float) -> Column:
    """Whether a prefix token that a and b (structs n, id, at) share allows a link, a being the smaller one."""
    smaller = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["id"] < b["id"]))
    length = a["n"] >= t * b["n"] - 1e-9
    indexed = a["at"] <= a["n"] - _at_least(2 * t / (1 + t), a["n"])
    rest = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return smaller & length & indexed & (rest >= _at_least(t / (1 + t), a["n"] + b["n"]))


def block_pairs(ranked: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(placed, pairs): placed(id, home, part), the block of a class; pairs(x_home, x_part, y_home, y_part), all blocks to compare, each pair once."""
    parts = ranked.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    placed = ranked.join(parts, "home").select("id", "n", "at", "prefix", "home", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    placed = store(placed, "line-placed")
    spread = placed.select("id", "n", "home", "part", F.col("at").alias("before"), F.posexplode("prefix").alias("place", "token"))
    member = F.struct("n", "id", (F.col("before") + F.col("place")).alias("at"))
    held = store(spread.groupBy("token", "home", "part").agg(F.collect_list(member).alias("held")), "line-held")
    x, y = (held.select("token", F.struct("home", "part").alias(k), F.col("held").alias(f"{k}_held")) for k in "xy")
    some = F.exists("x_held", lambda a: F.exists("y_held", lambda b: _may_link(a, b, percent / 100)))
    found = x.join(y, "token").where(some).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return placed, store(found.select(*[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "xy" for c in ("home", "part")]), "line-pairs")


def _blocks(sets: DataFrame, placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """home, part and held (structs id, first, tokens) of every block in a pair."""
    wanted = pairs.select(F.col("x_home").alias("home"), F.col("x_part").alias("part")).union(pairs.select("y_home", "y_part")).distinct()
    lines = placed.select("id", "home", "part").join(wanted, ["home", "part"])
    held = sets.join(lines, "id").groupBy("home", "part").agg(F.collect_list(F.struct("id", "first", "tokens")).alias("held"))
    return store(held, "line-blocks")


def class_links(docs: DataFrame, lines: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n_links and earliest (the first line of the earliest linked class) of every class with a link."""
    sets = line_sets(docs, candidates(lines, classes, percent))
    placed, pairs = block_pairs(rare_tokens(sets, percent), percent)
    blocks = _blocks(sets, placed, pairs)

    def near(a: Column, b: Column) -> Column:
        alike = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
        differ = reduce(lambda x, y: x + y, [F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in range(WORDS)])
        return alike & ((100 + percent) * differ <= (100 - percent) * (a["n"] + b["n"]))

    def linked(a: Column, b: Column) -> Column:
        once = F.col("apart") | (a["id"] < b["id"])
        return once & near(a, b) & ((100 + percent) * F.size(F.array_intersect(a["tokens"], b["tokens"])) >= percent * (a["n"] + b["n"]))

    measured = F.transform("held", lambda x: F.struct(x["id"].alias("id"), x["first"].alias("first"), F.size(x["tokens"]).alias("n"), _bits(x["tokens"]).alias("bits"), x["tokens"].alias("tokens")))
    blocks = blocks.withColumn("held", measured)
    same = pairs.where("x_home = y_home AND x_part = y_part").select(F.col("x_home").alias("home"), F.col("x_part").alias("part"))
    inner = blocks.join(same, ["home", "part"], "left_semi").select(F.lit(False).alias("apart"), F.col("held").alias("x"), F.col("held").alias("y"))
    apart = pairs.where("x_home <> y_home OR x_part <> y_part")
    hint = F.broadcast if apart.count() <= BROADCAST_LINES else (lambda frame: frame)
    keys = {k: [f"{k}_home", f"{k}_part"] for k in "xy"}
    x, y = (blocks.select(F.col("home").alias(keys[k][0]), F.col("part").alias(keys[k][1]), F.col("held").alias(k)).join(hint(apart.select(*keys[k]).distinct()), keys[k], "left_semi") for k in "xy")
    # Two blocks meet by sizes and parities first, a tenth of the bytes; then only the classes that may be linked bring their tokens.
    small = lambda frame, k: frame.withColumn(k, F.transform(k, lambda a: F.struct(a["id"].alias("id"), a["n"].alias("n"), a["bits"].alias("bits"))))
    # By number: pairs are few bytes, but much work.
    dealt = apart.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *apart.columns)
    met = dealt.join(small(x, "x"), keys["x"]).join(small(y, "y"), keys["y"])
    who = lambda one, other: F.transform(F.filter(one, lambda a: F.exists(other, lambda b: near(a, b))), lambda a: a["id"])
    met = store(met.select(*apart.columns, who("x", "y").alias("x_ids"), who("y", "x").alias("y_ids")), "line-met").where(F.size("x_ids") > 0)
    only = lambda k: F.filter(k, lambda a: F.array_contains(f"{k}_ids", a["id"])).alias(k)
    outer = met.join(x, keys["x"]).select(*keys["y"], "y_ids", only("x")).join(y, keys["y"]).select(F.lit(True).alias("apart"), "x", only("y"))
    both = inner.union(outer)
    both = both.withColumn("links", F.transform("x", lambda a: F.transform("y", lambda b: linked(a, b))))
    of = lambda one, other, is_link: F.transform(one, lambda a, i: F.struct(a["id"].alias("id"), F.transform(F.filter(other, lambda b, j: is_link(i, j)), lambda b: b["first"]).alias("firsts")))
    at = lambda i, j: F.get(F.get("links", i), j)
    # explode() would infer a filter, which works the comparisons out once more.
    each = both.select(F.explode_outer(F.concat(of("x", "y", at), of("y", "x", lambda i, j: at(j, i)))).alias("found")).select("found.id", "found.firsts")
    each = each.select("id", F.size("firsts").alias("n"), F.array_min("firsts").alias("first")).where("n > 0")
    return store(each.groupBy("id").agg(F.sum("n").alias("n_links"), F.min("first").alias("earliest")), "line-links")


def _judged(docs: DataFrame, percent: int, *keep: str) -> DataFrame:
    lines = line_sketches(docs, percent, *keep)
    classes = line_classes(lines)
    links = class_links(docs, lines, classes, percent)
    late = F.coalesce(F.col("earliest") < F.col("first"), F.lit(False))
    named = store(classes.join(links, "id", "left").select("k1", "k2", "first", "lines", F.coalesce("n_links", F.lit(0)).alias("n_links"), late.alias("late")), "line-named")
    total = named.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    is_hot = F.col("lines") > total // HOT
    hot = store(named.where(is_hot).select("k1", "k2", F.lit(True).alias("hot")), "line-hot")
    # The lines of a hot class are dealt over SALTS keys.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    lines = lines.drop("n", "sketch").join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", salt)
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    out = lines.join(named.withColumn("salt", F.explode(salts)), ["k1", "k2", "salt"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select("doc_id", *keep, "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), F.col("n_links").cast("long").alias("n_links"), (F.col("late") | ~is_first).alias("removed"))


def judge_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no, class_doc, class_line, n_links and removed of every line with a word, of docs(doc_id, text).

    The class is named by its first line, in the order of doc_id (null last) and line_no; n_links counts the other
    classes that it is linked with.  A line is removed if an earlier line has the same words or is linked.
    Null and empty texts and an empty table have no lines; other columns are not looked at.  A line may be as long as a text. Rows
    with one doc_id are one document, so repeated rows keep the same lines.
    """
    return _judged(docs.select("doc_id", "text"), percent)


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the removed lines taken out of ``text``; lines without words stay, null texts stay null.

    Texts that differ under one doc_id lose their own lines only.
    """
    of_text = F.xxhash64("text").alias("seriesloom_text")
    gone = _judged(docs.select("doc_id", "text", of_text), percent, "seriesloom_text").where("removed")
    gone = gone.groupBy(F.col("doc_id").alias("seriesloom_gone_id"), F.col("seriesloom_text").alias("seriesloom_gone_text")).agg(F.collect_set("line_no").alias("seriesloom_gone_lines"))
    on = F.col("doc_id").eqNullSafe(F.col("seriesloom_gone_id")) & (F.xxhash64("text") == F.col("seriesloom_gone_text"))
    both = docs.join(store(gone, "lines-gone"), on, "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("seriesloom_gone_lines", F.array().cast("array<int>")), i))
    text = F.when(F.col("seriesloom_gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
