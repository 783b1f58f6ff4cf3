"""Benchmark decontamination by SimHash windows and a multi-index Hamming join (operator 2).

A text is the bag of its five-word shingles (lower case; a shingle's weight is how often it occurs). Every
item of a benchmark is compared with windows of its own length: a window begins at a shingle that an item of
that length has, since moving a window right to its first such shingle never lowers its similarity, and
windows without one have similarity 0. At a document's end windows are shorter. Equal windows are judged once.

Items and windows get 64-bit SimHash fingerprints of their weighted shingles. The fingerprint is cut into
16 blocks of 4 bits; the index holds each item's blocks with every single-bit change, so each fingerprint
within ``radius`` (at most 31 bits) agrees with some entry. Pairs within the radius are then verified by
the exact weighted Jaccard coefficient of their shingle bags.

A shingle's later occurrences in a bag enter the fingerprint under hashes of their own, so that bags are sets
there and repeated shingles do not weigh the bits. The radius is chosen so that a pair at similarity 0.75, whose
bits differ with chance 0.172, lies beyond it with a chance of about 2e-7. Only the benchmark's shingles and index and the hashes
of the texts that hold any are broadcast, and only if they have at most ``broadcast_rows`` rows; otherwise they are
joined by shuffles. Texts are split twice: once to find the windows, once to cut out those of different content.

Defined results: null or empty texts and items match nothing; a text of fewer than five words is one
shingle; repeated rows and equal items each count; a null doc_id or item_id gives rows like any other; rows that
share an item_id are compared each with its own text, and the best gives the row of that item_id; other columns
are not read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"


def shingles(text: str, words: int = 5) -> tuple[Column, Column]:
    """Two steps: the words of column ``text``, then from a column ``w`` of them the shingle hashes in order."""
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SPACE), lambda x: x != "")
    n = F.size("w")
    many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(words))))
    one = F.array(F.xxhash64(F.array_join("w", " ")))
    return split, F.when(n >= words, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))


def _bags(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    split, hashes = shingles(text_col, words)
    return df.select(F.col(id_col).alias("id"), split.alias("w")).select("id", hashes.alias("bag"))


def numbered(bag: Column) -> Column:
    """The bag as a set: each occurrence of a hash after the first gets a hash of its own.

    The sorted bag is cut into runs of equal hashes, so the work grows with its length (and the logarithm of that), however
    often hashes repeat. Arrays that are used twice are bound once, as the only element of an array.
    """
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def runs(s: Column) -> Column:
        begin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ~F.get(s, k - 1).eqNullSafe(F.get(s, k)))
        one = lambda a, b: F.transform(F.sequence(F.lit(1), b - a), lambda j: F.when(j == 1, F.get(s, a)).otherwise(F.xxhash64(F.get(s, a), j)))
        return bound(begin, lambda p: F.flatten(F.zip_with(p, F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.size(s))), one)))

    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), bag).otherwise(bound(F.sort_array(bag), runs))


def fingerprints(bags: DataFrame, keys: list[str], bits: int = 64) -> DataFrame:
    """``keys``, one row for each, and ``fp``: bit i is set if more than half of the hashes of ``bag``, a set, have it.

    Each of 32 sums counts two bits, one in either half of a long, so bags of up to 2**31 hashes are exact.
    """
    each = bags.select(*keys, F.size("bag").alias("_n"), F.explode("bag").alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(0x0000000100000001))).alias(f"_s{i}") for i in range(32)]
    counted = each.groupBy(*keys, "_n").agg(*sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        for shift, count in ((i, F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"_s{i}", 32))):
            fp = fp.bitwiseOR(F.when(2 * count > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 75, radius: int = 26, broadcast_rows: int = 2_000_000, task_shingles: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_windows``: each item that a document holds, with its most similar
    window (the first of equals): the window's first word, counted from 0, and how many windows qualify."""
    if not 0 <= radius <= 31:
        raise ValueError("the index of single-bit changes covers a radius of at most 31")
    scratch = Scratch(docs.sparkSession, "leaks")
    item_key = (F.xxhash64("bag").alias("i1"), F.xxhash64(F.lit(1), "bag").alias("i2"))
    given = scratch.table(_bags(items, item_col, item_text, words).select(F.col("id").alias("item_id"), "bag", F.size("bag").alias("size"), *item_key), "items").where("size > 0")
    # items are compared by content, as windows are; their ids, which may be null or repeated, come back at the end
    held = given.groupBy("i1", "i2", "size").agg(F.first("bag").alias("bag"))
    held = scratch.table(held.select("i1", "i2", "size", "bag", numbered(F.col("bag")).alias("set")), "item-contents")
    known = scratch.table(held.select(F.explode("bag").alias("h"), "size").groupBy("h").agg(F.collect_set("size").alias("sizes")), "shingles")
    hint = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    # a filter on ``bag`` would move below the projection and split the text again for every shingle, so the explode of the
    # documents is an outer one. Windows are kept as places in a text of a content (b1, b2) with the hashes of their own:
    # the shingles of a window are cut out again, for one window of each content
    texts = _bags(docs, id_col, text_col, words).select("id", "bag", F.xxhash64("bag").alias("b1"), F.xxhash64(F.lit(1), "bag").alias("b2"))
    placed = texts.select("*", F.posexplode_outer("bag").alias("start", "h")).join(hint(known), "h")
    opened = placed.select(F.col("id").alias("doc_id"), "b1", "b2", "start", "bag", F.explode("sizes").alias("size"))
    own = F.slice("bag", F.col("start") + 1, F.col("size"))
    window = opened.select("doc_id", "b1", "b2", "start", "size", own.alias("bag"))
    windows = scratch.table(window.select("doc_id", "b1", "b2", "start", "size", F.xxhash64("bag").alias("k1"), F.xxhash64(F.lit(1), "bag").alias("k2")), "windows")
    contents = windows.groupBy("k1", "k2", "size").agg(F.min(F.struct("b1", "b2", "start")).alias("at"))
    contents = scratch.table(contents.select("k1", "k2", "size", "at.*"), "contents")
    wanted = scratch.table(contents.select("b1", "b2").distinct(), "wanted")
    bags = scratch.table(texts.join(hint(wanted), ["b1", "b2"], "left_semi").groupBy("b1", "b2").agg(F.first("bag").alias("bag")), "bags")

    # rows of contents are light and their windows are not, so tasks follow the shingles to be cut out
    tasks = 1 + (contents.agg(F.sum("size")).first()[0] or 0) // task_shingles

    def cut(some: DataFrame) -> DataFrame:
        """The contents ``some`` with their shingles as a set."""
        sliced = some.repartition(tasks, "k1", "k2").join(bags, ["b1", "b2"]).select(*(c for c in some.columns if c not in ("b1", "b2", "start")), own.alias("bag"))
        return sliced.withColumn("bag", numbered(F.col("bag")))

    def block(i: Column) -> Column:
        return F.expr(f"cast(shiftrightunsigned(fp, 4 * {i}) & 15 as int)")

    index = fingerprints(held.select("i1", "i2", "size", F.col("set").alias("bag")), ["i1", "i2", "size"]).select("i1", "i2", "size", F.col("fp").alias("item_fp"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.expr(f"cast(shiftrightunsigned(fp, {4 * i}) & 15 as int) ^ {m}").alias("v")) for i in range(16) for m in (0, 1, 2, 4, 8)))).alias("b"))
    index = scratch.table(index.select("i1", "i2", "size", "item_fp", "b.i", "b.v"), "index")
    probes = fingerprints(cut(contents), ["k1", "k2", "size"]).select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), block(i).alias("v")) for i in range(16)))).alias("b")).select("k1", "k2", "size", "fp", "b.i", "b.v")
    near = probes.join(hint(index), ["size", "i", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = near.select("k1", "k2", "size", "i1", "i2").distinct()

    sets = held.select("i1", "i2", "size", F.col("set").alias("item_bag"))
    judged = cut(pairs.join(contents, ["k1", "k2", "size"])).join(sets, ["i1", "i2", "size"]).withColumn("shared", F.size(F.array_intersect("bag", "item_bag")))
    both = F.size("bag") + F.size("item_bag") - F.col("shared")
    ids = given.select("item_id", "i1", "i2", "size").distinct()
    found = scratch.table(judged.where(100 * F.col("shared") >= percent * both).join(ids, ["i1", "i2", "size"]).select("k1", "k2", "size", "item_id", F.round(F.col("shared") / both, 6).alias("similarity")), "found")
    matched = windows.select("doc_id", "start", "size", "k1", "k2").join(found, ["k1", "k2", "size"])
    best = F.max_by("start", F.struct("similarity", -F.col("start"))).cast("long").alias("start")
    return matched.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best, F.countDistinct("start").alias("n_windows"))
