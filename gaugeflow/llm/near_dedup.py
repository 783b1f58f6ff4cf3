"""Near-duplicate documents by bottom-k sketches of word shingles (operator 1).

Every document becomes the set of its distinct five-word shingles (64-bit hashes). One hash function
gives the sketch: the k smallest values of the set. Inverted lists of retained values bring together
documents that share values; the sketch of a pair's union estimates its similarity and drops most
pairs; the exact Jaccard coefficient of the full sets confirms the rest.

Nothing is capped. Documents with equal sets fold into one node first. A linked pair shares at least
``need`` retained values (see ``_need``), so each node enters only the lists of its ``hits - need + 1``
rarest values: two linked nodes still meet in one of them, while a passage that many texts quote drops
out unless it fills most of a text. Small sketches of all documents leave the few nodes that can have a
partner; those get larger sketches, whose need is nearer to the threshold, and lists of their own.
Within a list, nodes are first compared with one hub (the node whose values are most common; in further
hub rounds one picked by hash); lists whose nodes are all in one component are then finished, so groups of
copies cost about one comparison a member. The nodes of the other lists are variants near the threshold, of
which sketches cannot say enough. They are listed by their whole sets: only values that occur in different
components count, nodes with fewer of these than any partner would share go (twice, since each that goes
makes others' values worthless), and the rest meet by their rarest values, where the pair's own sizes and
places ask for as many values more as a link needs. Links between components are never skipped.

Defined results: null text, or a text without words, has the empty set and no links; fewer words than
a shingle give one shingle of all words; rows that share a doc_id are one node; a null doc_id has
n_shingles, but component_id null and kept true. Other columns are neither read nor returned. An empty
table gives an empty result. Hash equality stands for shingle equality within one pair of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.words import binaries, blocks
from gaugeflow.operators.graph import connected_components
from gaugeflow.session import Scratch


def _shingle_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as 63-bit values so that signed order is theirs."""
    for b in blocks(texts, lower=True):
        h = b.hashes()
        w = b.windows(h, words) >> np.uint64(1)
        for j in range(b.hi - b.lo):
            lo, hi = int(b.first[j]), int(b.first[j + 1])
            if hi - lo >= words:
                yield np.unique(w[lo : hi - words + 1])
            elif hi > lo:
                yield b.windows(h[lo:hi], hi - lo, seed=3 + hi - lo) >> np.uint64(1)
            else:
                yield w[:0]


def _sketcher(words: int, k: int | None):
    """The ``k`` smallest values of each text's set, or all of them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, key, sketch = [], [], []
            for s in _shingle_sets(binaries(batch.column(1)), words):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch.append(s[:k].view(np.int64))
            ends = np.cumsum([0, *map(len, sketch)], dtype=np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sketch]))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "sketch"])

    return run


def _confirmer(words: int, percent: int):
    def run(batches):
        import pyarrow as pa

        last, held = None, None
        for batch in batches:
            left, right, keep = binaries(batch.column("text_a")), binaries(batch.column("text_b")), []
            for x, y, s in zip(left, right, _shingle_sets(right, words), strict=True):
                if x != last:
                    last, held = x, next(_shingle_sets([x], words))
                both = len(np.intersect1d(held, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(s) - both))
            pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield pairs.filter(pa.array(keep, pa.bool_()))

    return run


def _sampled_need(k: int, percent: int, loss: float) -> int:
    """The most shared values that a pair at the threshold has among the k smallest of its union, but for a chance of ``loss``."""
    t, tail = percent / 100, 0.0
    for s in range(k + 1):
        tail += comb(k, s) * t**s * (1 - t) ** (k - s)
        if tail > loss:
            return s
    return k


def _need(n: Column, k: int, percent: int, loss: float) -> Column:
    """How many retained values a document of n shingles shares at least with each partner.

    A set of at most k shingles is wholly retained: a partner also wholly retained shares
    ceil(t n); a larger one has at most (1 - t) n / t shingles outside, hence k minus those inside.
    """
    whole = F.least(F.ceil(n * percent / 100), k - F.floor(n * (100 - percent) / percent))
    return F.greatest(F.lit(1), F.when(n <= k, whole).otherwise(_sampled_need(k, percent, loss))).cast("long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75,
    first_k: int = 64, k: int = 256, loss: float = 1e-8, hub_rounds: int = 1,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``loss`` bounds the chance that the sketches of one pair at the threshold overlap too little.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n long, key binary, sketch array<long>"
    base = scratch.table(texts.mapInArrow(_sketcher(words, first_k), schema), "base")
    known = base.where("doc_id is not null and key is not null")
    nodes = scratch.table(_distinct_sets(known), "nodes")
    involved = _lists(nodes, first_k, percent, loss).select(F.col("node").alias("doc_id")).distinct()
    held = scratch.table(texts.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    sets = _distinct_sets(held.mapInArrow(_sketcher(words, k), schema).where("key is not null"))
    sets = scratch.table(sets, "sets")
    lists = scratch.table(_lists(sets, k, percent, loss), "lists")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The links among ``pairs``: small sets by their sketches, others by the sketch of the union, then by the texts."""
        ends = sets.select("node", "n", "sketch")
        a, b = (ends.toDF(x, f"n_{x}", f"s_{x}") for x in "ab")
        both = F.array_intersect("s_a", "s_b")
        seen = pairs.join(a, "a").join(b, "b").withColumn("both", both).withColumn("shared", F.size("both"))
        whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
        linked = 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))
        union_sketch = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
        likely = F.size(F.array_intersect(union_sketch, F.col("both"))) >= _sampled_need(k, percent, loss)
        verdict = F.when(whole, F.when(linked, "link")).when(likely, "check")
        judged = scratch.table(seen.select("a", "b", verdict.alias("is")).where("`is` is not null"), f"{name}-judged")
        a, b = (held.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        unsure = judged.where("`is` = 'check'").select("a", "b").join(b, "b").join(a, "a")
        checked = unsure.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(words, percent), "a long, b long")
        return scratch.table(judged.where("`is` = 'link'").select("a", "b").union(checked), name)

    by_id = known.join(nodes.select("key", "node"), "key").select("doc_id", "node")
    several = by_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    links = by_id.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    unsettled = lists.withColumn("part", F.col("node"))
    for k_round in range(hub_rounds):
        met = _hub_pairs(unsettled, k_round, percent)
        links = links.union(confirmed(met.distinct(), f"links-{k_round}"))
        # parts only save comparisons, so two rounds of merging do
        parts = connected_components(links, max_rounds=2, settle=False).withColumnRenamed("component", "part")
        labelled = lists.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        unsettled = scratch.table(labelled.join(_mixed(labelled), "v", "left_semi"), f"open-{k_round}")
    left = unsettled.groupBy("node").agg(F.first("part").alias("part"))
    whole = held.join(left.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    whole = _distinct_sets(whole.mapInArrow(_sketcher(words, None), schema).where("key is not null"))
    entries = whole.join(left, "node").select("node", "key", "n", "part", F.explode("sketch").alias("v"))
    entries = scratch.table(entries, "entries")
    for peel in range(2):
        entries = scratch.table(_with_possible_partners(entries, percent), f"entries-{peel}")
    met = scratch.table(_rare_value_pairs(entries, percent).distinct(), "met")
    links = links.union(confirmed(met, "links-whole"))
    components = connected_components(links)
    scratch.drop("texts", "sets", "lists", "entries", "entries-0", "entries-1", "met")

    rows = base.select("doc_id", "n", "key").join(nodes.select("key", "node"), "key", "left")
    rows = rows.join(components.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _fits(n: str, m: str, percent: int) -> Column:
    """Sets whose sizes differ more than this cannot reach the threshold."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _mixed(lists: DataFrame) -> DataFrame:
    """``v, m``: the values that nodes of different parts hold, and how many nodes do."""
    held = lists.groupBy("v").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m"))
    return held.where("p < q").select("v", "m")


def _hub_pairs(lists: DataFrame, k_round: int, percent: int) -> DataFrame:
    """Pairs of a node and the hub of each of its lists."""
    rank = F.struct("typical", -F.col("node")) if k_round == 0 else F.struct(F.xxhash64("v", "node", F.lit(k_round)), "node")
    hubs = lists.groupBy("v").agg(F.max_by(F.struct("node", "n", "part"), rank).alias("hub"), F.count("*").alias("m"))
    met = lists.join(hubs.where("m > 1"), "v").where("part <> hub.part").where(_fits("n", "hub.n", percent))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def _with_possible_partners(entries: DataFrame, percent: int) -> DataFrame:
    """The entries of nodes that hold as many values of other parts as a partner in one would share."""
    shared = entries.join(_mixed(entries).select("v"), "v", "left_semi")
    enough = shared.groupBy("node", "key", "n").agg(F.count("*").alias("hits"))
    enough = enough.where(100 * F.col("hits") >= percent * F.col("n"))
    return shared.join(enough.select("node", "key"), ["node", "key"], "left_semi").select(*entries.columns)


def _rare_value_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs from different parts that share one of their rarest values and can still share enough from there on."""
    ranked = _by_rarity(entries.join(_mixed(entries), "v"), ["node", "key"])
    least = F.ceil(F.col("n") * percent / 100)
    rare = ranked.where(F.col("rank") <= F.col("hits") - least + 1)
    rare = rare.select("v", "node", "n", "part", (F.col("hits") - F.col("rank") + 1).alias("spare"))
    other = rare.select("v", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "part", "spare")))
    more = F.ceil((F.col("n") + F.col("o_n")) * percent / (100 + percent))
    enough = (F.col("spare") >= more) & (F.col("o_spare") >= more) & _fits("n", "o_n", percent)
    met = rare.join(other, "v").where("node < o_node and part <> o_part").where(enough)
    return met.select(F.col("node").alias("a"), F.col("o_node").alias("b"))


def _distinct_sets(documents: DataFrame) -> DataFrame:
    """One row for each set of shingles: its smallest doc_id as ``node``."""
    first = [F.first(c).alias(c) for c in ("n", "sketch")]
    return documents.groupBy("key").agg(F.min("doc_id").alias("node"), *first)


def _by_rarity(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``hits`` with the number of each node's, its own ``rank`` from the rarest value on, and the sum of ``m``."""
    own = Window.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy("m", "v"))
    return hits.select("*", F.count("*").over(own).alias("hits"), rank.alias("rank"), F.sum("m").over(own).alias("common"))


def _lists(sets: DataFrame, k: int, percent: int, loss: float) -> DataFrame:
    """``v, node, n, typical``: each node in the inverted lists of its rarest shared values (see above)."""
    entries = sets.select("node", "key", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    ranked = _by_rarity(entries.join(shared, "v"), ["node", "key"])
    kept = ranked.where(F.col("rank") <= F.col("hits") - _need(F.col("n"), k, percent, loss) + 1)
    return kept.select("v", "node", "n", (F.col("common") / F.least(F.col("n"), F.lit(k))).alias("typical"))
