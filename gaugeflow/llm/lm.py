"""Scores of a log-bilinear language model (operator 9).

Counts first: each partition counts its words (64-bit hashes; one end token follows each text), and the
counts are summed over all training documents. The network reads and predicts units, whose number follows
the root of the vocabulary: one half are the most frequent tokens, the other half are classes that share all
other tokens, unknown ones included, by their hash. So every token has a vector as context and as target. The
counts of (unit before, unit) at a distance of one and of two tokens are kept as a written table of groups of
contexts, with which noise-contrastive estimation needs no text again. They cover all training documents
but those of one fold, the one after the held-out fold, which decide on the mixture below.

For either distance log P(unit | context) is proportional to the product of two learned vectors plus a bias.
Contexts are dealt into ``BLOCKS`` groups; in each round every group improves its own contexts' vectors and a copy
of the target vectors with numpy, by the NCE objective over its counts with unigram noise taken in expectation,
and the copies are averaged by their share of the corpus. So only vectors, never counts, reach the driver.
The probability of a token is a mixture of both distances and the unigram law, each normalised exactly by
batched matrix products, with the mixture's weights that fit the fold kept for it best, times the token's share
(c + 1) of its unit, where one unit of each class stands for unknown tokens. So probabilities sum to one.

Only tokens above a cut of their count, at most ``head``, reach driver and tasks, as an array of bounded size; the
cut comes from a histogram. Counts of rarer tokens come by a join, whatever their number.

Defined results: null and empty texts are one end token; a null doc_id counts as the text ''; repeated
rows each count; without training documents every count is 0. Other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.words import Block, binaries, blocks, mix
from gaugeflow.session import Scratch

DISTANCES = 2
BLOCKS = 16  # groups of contexts for each distance
PRIOR = 4.0  # the inverse variance of a vector's numbers before any text is seen
#: Weights of the two distances between which training texts decide; the rest is the unigram law's.
MIXTURES = tuple((a / 10, b / 10) for a in range(10) for b in range(5) if a + b < 10)
END = np.int64(-0x61C8864680B583EB)  # the end token's hash; any fixed value, a word's would meet it by chance of 2**-64


def is_held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids], bool)


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a block, each text's end included, and where each text begins."""
    first = b.first + np.arange(len(b.first))
    out = np.empty(int(first[-1]), np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[first[1:] - 1] = True
    out[is_end], out[~is_end] = END, b.hashes().view(np.int64)
    return out, first


def _training(batches, folds: int, fold: int, part: str = "all"):
    """The blocks of a partition's training texts: all, those of the ``next`` fold, or the ``others``."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        wanted, following = ~is_held_out(ids, folds, fold), is_held_out(ids, folds, (fold + 1) % folds)
        if part != "all":
            wanted &= following == (part == "next")
        yield from blocks([t for t, w in zip(binaries(batch.column(1)), wanted, strict=True) if w], lower=True)


def _counted(values, names: list[str], held: int = 2_000_000):
    """Record batches with each distinct number of the given arrays and how often it occurs; at most about ``held``
    are kept at a time, so a number can come in several batches."""
    import pyarrow as pa

    def merged(parts):
        w, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return w, np.bincount(at, np.concatenate([p[1] for p in parts]).astype(float), len(w)).astype(np.int64)

    parts, size = [], 0
    for v in values:
        parts.append(np.unique(v, return_counts=True))
        size += len(parts[-1][0])
        if size > held:
            parts = [merged(parts)]
            size = len(parts[0][0])
            if size > held // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=names)
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=names)


def _word_counter(folds: int, fold: int):
    def run(batches):
        yield from _counted((tokens(b)[0] for b in _training(batches, folds, fold)), ["w", "c"])

    return run


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted value's place in the sorted keys, -1 where it is absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Vocabulary:
    """The most frequent tokens by hash, with their counts and units (-1 for those that share a class)."""

    words: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    own: int  # units of one token each; the classes follow
    classes: int

    @property
    def n(self) -> int:
        return self.own + self.classes

    def of(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place among the frequent ones (-1: not there) and its unit."""
        at = _lookup(self.words, t)
        unit = np.where(at >= 0, self.units[at] if len(self.units) else -1, -1)
        return at, np.where(unit >= 0, unit, self.own + class_of(t, self.classes))

    def contexts(self, unit: np.ndarray, first: np.ndarray, distance: int) -> np.ndarray:
        """The unit ``distance`` before each token; n where the text has none."""
        out = np.full_like(unit, self.n)
        out[distance:] = unit[:-distance] if distance < len(unit) else unit[:0]
        for d in range(distance):
            at = first[:-1] + d
            out[at[at < first[1:]]] = self.n
        return out


def class_of(t: np.ndarray, classes: int) -> np.ndarray:
    return (mix(t.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)).astype(np.int64)


def _pair_counter(shared, folds: int, fold: int):
    def run(batches):
        voc = shared.value

        def codes():
            for b in _training(batches, folds, fold, "others"):
                t, first = tokens(b)
                unit = voc.of(t)[1]
                for d in range(DISTANCES):
                    yield (voc.contexts(unit, first, d + 1) + d * (voc.n + 1)) * voc.n + unit

        yield from _counted(codes(), ["pair", "c"])

    return run


@dataclass
class LogBilinear:
    context: np.ndarray  # one row for each unit, and one for the beginning
    target: np.ndarray
    bias: np.ndarray

    def log10(self) -> np.ndarray:
        """The normalised log-probability of every unit after every context."""
        s = (self.context @ self.target.T + self.bias).astype(np.float64)
        return (s - self.log_sums()[:, None]) / np.log(10)

    def log_sums(self, rows: int = 1024) -> np.ndarray:
        """The logarithm of the sum over all units after every context, by batched products."""
        out = []
        for lo in range(0, len(self.context), rows):
            s = self.context[lo : lo + rows] @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out.append(top[:, 0] + np.log(np.exp(s - top).sum(axis=1, dtype=np.float64)))
        return np.concatenate(out)


def improve(
    n: np.ndarray, model: LogBilinear, q: np.ndarray, steps: int, rates: tuple[float, float], priors: tuple[float, float] = (0.0, 0.0), noise: float = 10.0,
) -> LogBilinear:
    """Adam on the NCE objective over counts ``n`` (contexts by units), with unigram noise ``q`` in expectation; the rate
    falls evenly from the first to the second. ``priors`` are the inverse variances of context and target vectors."""
    params = [x.copy() for x in (model.context, model.target, model.bias)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    log_noise = np.log(noise * q).astype(np.float32)
    noise_mass = n.sum(axis=1, keepdims=True) * np.exp(log_noise)
    scale = np.float32(1 / max(1.0, float(n.sum())))
    for k in range(1, steps + 1):
        c, t, b = params
        true = 1 / (1 + np.exp(np.clip(log_noise - (c @ t.T + b), -30, 30)))  # chance that a pair is data, not noise
        slope = (n * (1 - true) - noise_mass * true) * scale
        step = rates[0] + (rates[1] - rates[0]) * (k - 1) / steps
        pull = [np.float32(x) * scale for x in priors]
        for i, g in enumerate((slope @ t - pull[0] * c, slope.T @ c - pull[1] * t, slope.sum(axis=0))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] += np.float32(step) * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-12)
    return LogBilinear(*params)


def fresh(contexts: int, q: np.ndarray, dim: int, seed: int) -> LogBilinear:
    rng = np.random.default_rng(seed)
    c, t = (rng.normal(0, 0.1, (n, dim)).astype(np.float32) for n in (contexts, len(q)))
    return LogBilinear(c, t, np.log(q).astype(np.float32))


def train(pairs: np.ndarray, dim: int = 24, steps: int = 120, rate: float = 0.05, seed: int = 9) -> LogBilinear:
    """The model of one table of counts (contexts by units)."""
    n = pairs.astype(np.float32)
    q = (n.sum(axis=0) + 1) / (n.sum() + n.shape[1])
    return improve(n, fresh(len(n), q, dim, seed), q, steps, (rate, 0.0))


def _packed(pdf):
    """One row for a group of contexts: the contexts, where each one's counts end, their units and values."""
    import pandas as pd

    ends = np.cumsum([len(u) for u in pdf["units"]]).astype(np.int64)
    units, c = (np.concatenate(pdf[name].to_list()) for name in ("units", "c"))
    row = {"distance": int(pdf["distance"].iloc[0]), "at": pdf["context"].to_numpy(np.int64).tobytes(), "ends": ends.tobytes()}
    return pd.DataFrame([row | {"units": units.astype(np.int32).tobytes(), "c": c.astype(np.float32).tobytes()}])


PACKED = "distance int, at binary, ends binary, units binary, c binary"


def _trainer(models, q: np.ndarray, steps: int, rates: tuple[float, float]):
    """For each group of contexts its vectors, its copy of the target vectors and its share of the corpus."""

    def one(group):
        at, ends = (np.frombuffer(group[name], np.int64) for name in ("at", "ends"))
        n = np.zeros((len(at), len(q)), np.float32)
        rows = np.repeat(np.arange(len(at)), np.diff(ends, prepend=0))
        n[rows, np.frombuffer(group["units"], np.int32)] = np.frombuffer(group["c"], np.float32)
        model = models.value[group["distance"]]
        got = improve(n, LogBilinear(model.context[at], model.target, model.bias), q, steps, rates, (PRIOR, PRIOR / BLOCKS))
        row = {"distance": group["distance"], "mass": float(n.sum()), "at": group["at"]}
        return row | {k: getattr(got, k).tobytes() for k in ("context", "target", "bias")}

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for group in pdf.to_dict("records"):
                yield pd.DataFrame([one(group)])

    return run


def train_on_table(rows: DataFrame, q: np.ndarray, dim: int = 32, rounds: int = 6, steps: int = 20, rate: float = 0.08, seed: int = 9) -> list[LogBilinear]:
    """A model for each distance from packed groups of contexts. In a round each group trains on its own counts;
    target vectors and biases are then averaged by the groups' mass."""
    sc = rows.sparkSession.sparkContext
    models = [fresh(len(q) + 1, q, dim, seed + d) for d in range(DISTANCES)]
    kinds = "distance int, mass double, at binary, context binary, target binary, bias binary"
    for k in range(rounds):
        rates = (rate * (rounds - k) / rounds, rate * (rounds - k - 1) / rounds)
        shared = sc.broadcast(models)
        found = rows.mapInPandas(_trainer(shared, q, steps, rates), kinds).toPandas()  # vectors of 2 * BLOCKS groups
        shared.unpersist()
        for d, model in enumerate(models):
            parts = found[found["distance"] == d].sort_values("at")
            if len(parts) == 0:
                continue
            for at, vectors in zip(parts["at"], parts["context"], strict=True):
                model.context[np.frombuffer(at, np.int64)] = np.frombuffer(vectors, np.float32).reshape(-1, dim)
            share = (parts["mass"] / parts["mass"].sum()).to_numpy(np.float32)
            model.target = sum(w * np.frombuffer(x, np.float32).reshape(-1, dim) for w, x in zip(share, parts["target"], strict=True))
            model.bias = sum(w * np.frombuffer(x, np.float32) for w, x in zip(share, parts["bias"], strict=True))
    return models


@dataclass
class Model:
    vocabulary: Vocabulary
    distances: list[LogBilinear]
    log_sums: list[np.ndarray]
    unigram: np.ndarray  # of the units
    log_shares: np.ndarray  # log10 of what a unit's tokens' counts (c + 1) add up to; 0 for units of one token
    weights: tuple[float, ...] = ()

    def laws(self, unit: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The probability of each token's unit by every distance and by the unigram law."""
        out = []
        for d, (m, z) in enumerate(zip(self.distances, self.log_sums, strict=True)):
            at = self.vocabulary.contexts(unit, first, d + 1)
            s = np.einsum("ij,ij->i", m.context[at], m.target[unit]) + m.bias[unit]
            out.append(np.exp(s - z[at]))
        return [*out, self.unigram[unit]]

    def mixed(self, laws: list[np.ndarray], weights: tuple[float, ...]) -> np.ndarray:
        return sum(w * p for w, p in zip((*weights, 1 - sum(weights)), laws, strict=True))


def _mixer(model, folds: int, fold: int):
    """The log-likelihood of a partition's texts of the next fold under each of ``MIXTURES``."""

    def run(batches):
        import pyarrow as pa

        m, total = model.value, np.zeros(len(MIXTURES))
        for b in _training(batches, folds, fold, "next"):
            t, first = tokens(b)
            laws = m.laws(m.vocabulary.of(t)[1], first)
            total += [np.log10(m.mixed(laws, w)).sum() for w in MIXTURES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(MIXTURES)), pa.int32()), pa.array(total)], names=["mixture", "fit"])

    return run


def _scorer(model, n: int, v: int, complete: bool, folds: int, fold: int):
    def run(batches):
        import pyarrow as pa

        m, voc = model.value, model.value.vocabulary
        for batch in batches:
            held_out = is_held_out(batch.column(0).to_pylist(), folds, fold)
            cols: list[list] = [[], [], [], [], []]
            for b in blocks(binaries(batch.column(1)), lower=True):
                t, first = tokens(b)
                at, unit = voc.of(t)
                count = np.where(at >= 0, voc.counts[at] if len(voc.counts) else 0, 0)
                far = (at < 0) & (not complete)  # their counts come by the join
                base = np.where(far, 0.0, np.log10((count + 1) / (n + v + 1)))
                share = np.where(unit >= voc.own, np.where(far, 0.0, np.log10(count + 1)), 0.0) - m.log_shares[unit]
                score = np.log10(m.mixed(m.laws(unit, first), m.weights)) + share
                known = np.add.reduceat(count > 0, first[:-1], dtype=np.int64)
                sums = (np.add.reduceat(x, first[:-1]) for x in (base, score))
                for col, x in zip(cols, (np.diff(first), known, *sums), strict=False):
                    col.append(x)
                cols[4] += [t[i:j][far[i:j]] for i, j in zip(first[:-1], first[1:], strict=True)]
            flat = [np.concatenate(c) if c else np.zeros(0) for c in cols[:4]]
            ends = pa.array(np.cumsum([0, *map(len, cols[4])], dtype=np.int32))
            rare = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *cols[4]])))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [batch.column(0), pa.array(held_out), *(pa.array(x, kind) for x, kind in zip(flat, kinds, strict=True)), rare]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def _vocabulary(counts: DataFrame, v: int, units: int, head: int) -> Vocabulary:
    """The tokens above the smallest cut that at most ``head`` reach; the cut comes from a histogram of log-counts."""
    level = F.floor(16 * F.log2("c")).cast("int").alias("level")
    held, cut = 0, None
    for r in sorted(counts.groupBy(level).count().collect(), key=lambda r: -r["level"]):  # at most 16 * 63 rows
        held += r["count"]
        if held > head:
            break
        cut = r["level"]
    top = counts.where(F.floor(16 * F.log2("c")) >= cut) if cut is not None else counts.where("false")
    top = top.toPandas().sort_values(["c", "w"], ascending=[False, True])
    own = min(len(top), max(1, units // 2))
    place = np.arange(len(top))
    order = np.argsort(top["w"].to_numpy(np.int64))
    words, freq = (top[c].to_numpy(np.int64)[order] for c in "wc")
    return Vocabulary(words, freq, np.where(place < own, place, -1)[order], own, max(1, units - own))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None, head: int = 1 << 18, folds: int = 7, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``classes`` is the number of units; without it, the root of the vocabulary's size, at least 2048.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_word_counter(folds, fold), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = scratch.table(found, "counts")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    voc = _vocabulary(counts, v, classes or max(2048, math.isqrt(v)), head)
    shared = spark.sparkContext.broadcast(voc)
    model = spark.sparkContext.broadcast(_fit(scratch, texts, counts, shared, folds, fold))
    complete = v <= len(voc.words)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    found = texts.mapInArrow(_scorer(model, n, v, complete, folds, fold), kinds)
    out = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    if complete:
        scratch.drop("counts", "contexts")
        return found.select(*out)
    found = scratch.table(found.withColumn("_row", F.monotonically_increasing_id()), "scores")
    each = found.select("_row", F.explode("rare").alias("w")).groupBy("_row", "w").agg(F.count("*").alias("times"))
    c = F.coalesce("c", F.lit(0))
    joined = each.join(counts, "w", "left").select("_row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(c + 1)).alias("l"), "times")
    # sums of rounded terms do not depend on their order
    added = joined.groupBy("_row").agg(F.sum("known").alias("known"), F.sum(F.round(F.col("l") * 1e9).cast("long")).alias("l"), F.sum("times").alias("times"))
    rows = found.drop("rare").join(added, "_row", "left").na.fill(0, ["known", "l", "times"])
    rows = rows.withColumn("n_known", F.col("n_known") + F.col("known"))
    rows = rows.withColumn("base_score", F.col("base_score") + F.col("l") / 1e9 - F.col("times") * float(np.log10(n + v + 1)))
    return rows.withColumn("score", F.col("score") + F.col("l") / 1e9).select(*out)


def _fit(scratch: Scratch, texts: DataFrame, counts: DataFrame, shared, folds: int, fold: int) -> Model:
    """Counts of pairs, training and the choice of the mixture."""
    spark, voc = texts.sparkSession, shared.value
    w = voc.n
    pairs = texts.mapInArrow(_pair_counter(shared, folds, fold), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    cell = F.struct(F.expr(f"cast(pair % {w} as int)").alias("unit"), "c")
    cells = pairs.groupBy(F.expr(f"pair div {w}").alias("row")).agg(F.collect_list(cell).alias("cells"))
    context, distance = F.expr(f"cast(row % {w + 1} as int)"), F.expr(f"cast(row div {w + 1} as int)")
    lists = [F.col("cells.unit").alias("units"), F.col("cells.c").alias("c")]
    cells = cells.select(distance.alias("distance"), context.alias("context"), *lists)
    # a number of partitions of its own keeps the few groups apart
    spread = cells.repartition(DISTANCES * BLOCKS, "distance", F.col("context") % BLOCKS)
    packed = spread.groupBy("distance", F.col("context") % BLOCKS).applyInPandas(_packed, PACKED)
    rows = scratch.table(packed, "contexts")

    held = np.zeros(w)  # what the counts (c + 1) of each unit's tokens add up to, one unknown token in each class
    held[voc.units[voc.units >= 0]] = voc.counts[voc.units >= 0] + 1
    held[voc.own :] = 1
    frequent = counts.sparkSession.createDataFrame([(int(x),) for x in voc.words[voc.units >= 0]], "w long")  # voc.own rows
    others = counts.join(F.broadcast(frequent), "w", "left_anti").mapInArrow(_class_sums(shared), "unit long, held long")
    for r in others.groupBy("unit").agg(F.sum("held").alias("held")).collect():  # voc.classes rows
        held[r["unit"]] += r["held"]
    unigram = held / held.sum()
    models = train_on_table(rows, unigram.astype(np.float32))
    log_shares = np.where(np.arange(w) < voc.own, 0.0, np.log10(held))
    model = Model(voc, models, [m.log_sums() for m in models], unigram, log_shares, MIXTURES[0])
    tried = spark.sparkContext.broadcast(model)
    fits = texts.mapInArrow(_mixer(tried, folds, fold), "mixture int, fit double").groupBy("mixture").agg(F.sum("fit").alias("fit"))
    best = max(fits.collect(), key=lambda r: (round(r["fit"], 3), -r["mixture"]), default=None)  # a row for each mixture
    model.weights = MIXTURES[best["mixture"] if best else 0]
    return model


def _class_sums(shared):
    def run(batches):
        import pyarrow as pa

        voc, total = shared.value, np.zeros(shared.value.classes, np.int64)
        for batch in batches:
            w, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, class_of(np.ascontiguousarray(w), voc.classes), c + 1)
        yield pa.RecordBatch.from_arrays([pa.array(voc.own + np.arange(voc.classes)), pa.array(total)], names=["unit", "held"])

    return run
