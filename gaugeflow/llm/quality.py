"""Quality rules: base statistics and robust multivariate outliers (operator 4).

Five statistics of each text become a transformed vector on a grid of 1/256: logarithms of the words,
of the mean word length, and of the shares of symbols, duplicate lines and repeated words. For each
language and source a minimum-covariance-determinant estimate is fitted over all documents that pass
the base rules. It has three deterministic starts: medians with quartile deviations, mean and covariance
of all vectors, and the covariance of the vectors' directions from the medians. Concentration steps take the
``coverage`` share of vectors with the smallest Mahalanobis distances and recompute mean and covariance from
them. After two steps the start with the least determinant goes on, until no step lowers a determinant. A
document is rejected where its squared distance exceeds ``cutoff``.

All sums are of integers, so the verdicts do not depend on partitioning. Order statistics come from
counts per bin (bounded numbers of bins for each group), never from collected values; so a concentration
step takes all vectors up to the bin of distances, 1/64 wide in their logarithm, in which the share is reached.
A group with fewer than ``min_group`` vectors uses the estimate of its language, and that of all documents where
the language is small too. Covariances are multiplied by the consistency factor of the share; a deviation below
its ``FLOOR`` is raised to it, so that a statistic that is constant in a group cannot reject by rounding.

Repeated words are counted by 64-bit hashes of their windows.

Defined results: null text has no words and fails the base rules; null language or source is a group of
its own; repeated rows each count and each give a row; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"
GRID = 256
NAMES = ("x0", "x1", "x2", "x3", "x4")
#: The least standard deviation of each statistic. With the cutoff of 28, 60 % of duplicate lines or 19 % of repeated words (a
#: fifth fails the base rules) are enough to reject a document by themselves; one repeated line of ten and its words are not.
FLOOR = (0.5, 0.1, 0.25, 0.75, 0.55)
#: fixed values: coverage / P(chi-square with 7 degrees of freedom <= q), where q is the coverage's quantile for 5
CONSISTENCY = {0.5: 1.912, 0.75: 1.412, 0.9: 1.178}


def _repeated_words(shingles: Column, words: int) -> Column:
    """How many words the windows cover whose hash occurs twice or more: sorted (hash, place) pairs with an equal
    neighbour give the places, whose union of intervals is measured in order."""
    pairs = F.sort_array(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        grow = lambda a, p: F.struct((p + words).alias("end"), (a["total"] + F.least(F.lit(words), p + words - a["end"])).alias("total"))
        return F.aggregate(places, start, grow, lambda a: a["total"])

    some = F.size(F.array_distinct(shingles)) < F.size(shingles)
    # the sorted array is bound once, as the only element of an array
    return F.when(some, F.get(F.transform(F.array(pairs), covered), F.lit(0))).otherwise(0)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source"), window: int = 5) -> DataFrame:
    """``doc_id``, ``keep``, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "").alias("w")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines")
    df = df.select("doc_id", *keep, words, lines, F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"))
    n = F.size("w")
    shingles = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(window))))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("doc_id", *keep, n.alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"), shingles.alias("shingles"))
    df = df.select("*", _repeated_words(F.col("shingles"), window).alias("n_repeat_words")).drop("shingles")
    df = df.select("doc_id", *keep, *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vectors() -> list[Column]:
    share = lambda a, b: F.log1p(100 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = [F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(c * GRID).cast("long").alias(name) for c, name in zip(x, NAMES, strict=True)]


def _quantiles(counts: DataFrame, keys: list[str], bin_: str, **shares: float) -> DataFrame:
    """The smallest bin at which each share of n is reached, for each key; ``counts`` has one row for each key and bin."""
    own = Window.partitionBy(*keys)
    up = F.sum("n").over(own.orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, bin_, up.alias("up"), F.sum("n").over(own).alias("all"))
    reached = {name: F.min(F.when(F.col("up") >= share * F.col("all"), F.col(bin_))) for name, share in shares.items()}
    return ranked.groupBy(*keys).agg(*(c.alias(name) for name, c in reached.items()))


D = len(NAMES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _whitened(moments: DataFrame) -> DataFrame:
    """``grp, start``, the centre ``m*``, the inverse Cholesky factor ``w*`` of the covariance ``c*`` with its floor, and
    ``det``, the logarithm of the determinant."""
    df = moments
    for j in range(D):
        for i in range(j, D):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            own = F.greatest(F.col(f"c{j}{i}"), F.lit((FLOOR[i] * GRID) ** 2)) if i == j else F.col(f"c{j}{i}")
            own = own - rest
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(own, F.lit(1e-9))) if i == j else own / F.col(f"l{j}{j}"))
    for j in range(D):
        for i in range(j, D):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            df = df.withColumn(f"w{i}{j}", (1 / F.col(f"l{i}{i}")) if i == j else -rest / F.col(f"l{i}{i}"))
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))
    return df.select("grp", "start", F.round(det, 9).alias("det"), *(f"m{i}" for i in range(D)), *(f"w{i}{j}" for j, i in PAIRS))


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` for each start of their group with ``d2``, the squared Mahalanobis distance, rounded to 1e-6."""
    terms = [sum((F.col(f"w{i}{j}") * (F.col(NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
    d2 = F.round(sum((t * t for t in terms), F.lit(0.0)), 6).alias("d2")
    return rows.join(estimates, "grp").select(*rows.columns, "start", d2)


def _moments(cells: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means ``m*`` and covariances ``c*`` times ``factor`` of vectors that count ``n`` each."""
    x = [F.col(c) for c in NAMES]
    n, s = F.col("n"), [F.col(f"s{i}") for i in range(D)]
    products = [F.sum(n * x[i] * x[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    sums = cells.groupBy(*keys).agg(F.sum(n).alias("n"), *(F.sum(n * x[i]).alias(f"s{i}") for i in range(D)), *products)
    covariances = [(factor * (F.col(f"s{i}{j}") / n - s[i] / n * s[j] / n)).alias(f"c{i}{j}") for i, j in PAIRS]
    return sums.select(*keys, *((s[i] / n).alias(f"m{i}") for i in range(D)), *covariances)


def _concentrated(cells: DataFrame, estimates: DataFrame, coverage: float) -> DataFrame:
    """One concentration step for each group and start."""
    near = _distances(cells, estimates).withColumn("bin", F.floor(64 * F.log(F.col("d2") + 1e-3)))
    cut = _quantiles(near.groupBy("grp", "start", "bin").agg(F.sum("n").alias("n")), ["grp", "start"], "bin", cut=coverage)
    chosen = near.join(cut, ["grp", "start"]).where("bin <= cut")
    return _whitened(_moments(chosen, ["grp", "start"], CONSISTENCY[coverage]))


def _starts(cells: DataFrame) -> DataFrame:
    """Medians with quartile deviations (0), mean and covariance of all (1), medians with the covariance of the
    directions from there, each statistic first divided by its quartile deviation (2)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("x")) for k, c in enumerate(NAMES)))).alias("b")
    bins = cells.select("grp", "n", each).groupBy("grp", "b.k", "b.x").agg(F.sum("n").alias("n"))
    q = _quantiles(bins, ["grp", "k"], "x", q1=0.25, q2=0.5, q3=0.75)
    at = lambda i, c: F.max(F.when(F.col("k") == i, c))
    middle = [at(i, F.col("q2")).cast("double").alias(f"m{i}") for i in range(D)]
    deviation = [F.greatest(at(i, (F.col("q3") - F.col("q1")) / 1.349), F.lit(FLOOR[i] * GRID)).alias(f"d{i}") for i in range(D)]
    robust = q.groupBy("grp").agg(*middle, *deviation)
    diagonal = [(F.pow(f"d{i}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    one = robust.select("grp", F.lit(0).alias("start"), *(f"m{i}" for i in range(D)), *diagonal)
    two = _moments(cells, ["grp"], 1.0).withColumn("start", F.lit(1))
    y = [((F.col(NAMES[i]) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"y{i}") for i in range(D)]
    placed = cells.join(robust, "grp").select("grp", "n", *y)
    length = F.greatest(sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)), F.lit(0.0)), F.lit(1e-9))
    sums = placed.groupBy("grp").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.round(1e6 * F.col(f"y{i}") * F.col(f"y{j}") / length).cast("long")).alias(f"s{i}{j}") for i, j in PAIRS))
    spread = [(D * F.col(f"s{i}{j}") / 1e6 / F.col("n") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
    three = sums.join(robust, "grp").select("grp", F.lit(2).alias("start"), *(f"m{i}" for i in range(D)), *spread)
    return _whitened(one.unionByName(two.select(one.columns)).unionByName(three))


def _least(estimates: DataFrame) -> DataFrame:
    """For each group the estimate with the least determinant."""
    best = estimates.groupBy("grp").agg(F.min_by(F.struct(*estimates.columns), F.struct("det", "start")).alias("e"))
    return best.select("e.*").withColumn("start", F.lit(0))


def minimum_covariance_determinants(cells: DataFrame, scratch: Scratch, coverage: float = 0.75, most_steps: int = 50, small: int = 100_000) -> DataFrame:
    """The estimate of each ``grp`` of ``cells`` (``grp``, the vector, its count ``n``), as ``_whitened`` gives it.

    Estimates are broadcast if there are at most ``small``. After ``most_steps`` the best so far holds.
    """
    found = scratch.table(_starts(cells), "starts")
    hint = F.broadcast if found.count() <= small else (lambda df: df)
    for k in range(2):
        found = scratch.table(_concentrated(cells, hint(found), coverage), f"estimates-{k}")
    found = scratch.table(_least(found), "estimates-least")
    names = []
    for k in range(2, most_steps):
        after = _concentrated(cells, hint(found), coverage).withColumn("start", F.lit(1))
        was = found.select("grp", F.col("det").alias("was"))
        step = _least(found.unionByName(after)).join(was, "grp").withColumn("open", F.col("det") < F.col("was")).drop("was")
        names.append(f"estimates-{k}")
        step = scratch.table(step, names[-1])
        found = step.where("open").drop("open")  # settled groups leave the loop
        if found.isEmpty():
            break
    if not names:
        return found
    settled = scratch.spark.read.schema(step.schema).parquet(*map(scratch.path, names)).where("not open").drop("open")
    return settled.unionByName(found)


def outlier_distances(stats: DataFrame, coverage: float = 0.75, min_group: int = 100, group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``stats`` with ``d2``: each row's squared robust distance within its language and source."""
    scratch = Scratch(stats.sparkSession, "quality")
    lang, source = (F.col(c).cast("string") for c in group_cols)
    g_own = F.to_json(F.struct(lang.alias("l"), source.alias("s"))).alias("g_own")
    g_lang = F.to_json(F.struct(lang.alias("l"), F.lit("").alias("any"))).alias("g_lang")
    rows = scratch.table(stats.select("*", *_vectors(), g_own, g_lang), "statistics")
    fitted = rows.where("not base_failed")
    # the groups that have an estimate of their own; each row then counts in its own, its language's and the whole group
    per = rows.groupBy("g_own", "g_lang").agg(F.count_if(~F.col("base_failed")).alias("n"))
    per_lang = per.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    grp = F.when(F.col("n") >= min_group, F.col("g_own")).when(F.col("n_lang") >= min_group, F.col("g_lang")).otherwise("all")
    chosen = scratch.table(per.join(per_lang, "g_lang").select("g_own", grp.alias("grp")), "groups")
    hint = F.broadcast if chosen.count() <= 100_000 else (lambda df: df)
    # vectors repeat on the grid: fitting goes over distinct vectors with their counts
    levels = fitted.groupBy("g_own", "g_lang", *NAMES).agg(F.count("*").alias("n"))
    levels = levels.select(F.explode(F.array("g_own", "g_lang", F.lit("all"))).alias("grp"), *NAMES, "n")
    levels = levels.join(hint(chosen.select("grp").distinct()), "grp", "left_semi")
    cells = scratch.table(levels.groupBy("grp", *NAMES).agg(F.sum("n").alias("n")), "vectors")
    estimates = minimum_covariance_determinants(cells, scratch, coverage)
    placed = rows.join(hint(chosen), "g_own", "left").withColumn("grp", F.coalesce("grp", F.lit("all")))
    judged = _distances(placed, hint(estimates))
    # without any fitted vector there is no estimate, and nothing to be far from
    left = placed.join(hint(estimates.select("grp")), "grp", "left_anti").withColumn("d2", F.lit(0.0))
    return judged.select(*stats.columns, *NAMES, "d2").unionByName(left.select(*stats.columns, *NAMES, "d2"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = 28.0) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2``."""
    stats = base_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")))
    judged = outlier_distances(stats)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("d2") <= cutoff)).alias("kept"), F.col("d2").alias("distance2"))
