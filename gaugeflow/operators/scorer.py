"""The whole scorer: one cube of moments from one look at the rows, rolled up to every grain into one nested document.

A cell holds the moments of one model, key, lead hour and overlap state, centred within the cell, so they merge without
loss of digits. Scores of keys, lead buckets, subsets and lead hours are all roll-ups of the cells. Per key there is one row
from there on; medians over keys and the document are of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.forecasts import KINDS, with_forecasts
from gaugeflow.operators.metrics import EPS
from gaugeflow.operators.selection import quantiles
from gaugeflow.sources.panel import long_targets

SUBSETS = {"dev_clean": "not overlap", "dev_overlap": "overlap", "dev_target_seen": "target_seen"}


def moments_cube(rows: DataFrame, flags: DataFrame | None = None, width: int = 12) -> DataFrame:
    """``model, key, lead_h, bucket, overlap, target_seen`` with counts, means, centred moments and errors.

    ``rows`` has ``model, key, origin, lead_h, obs, pred, bar``. ``flags`` has ``key, origin, input_seen, target_seen``; a
    window without flags counts as seen; without ``flags`` both states are null.
    """
    state = [F.lit(None).cast("boolean").alias(c) for c in ("overlap", "target_seen")]
    if flags is not None:
        seen = [F.coalesce(c, F.lit(True)) for c in ("input_seen", "target_seen")]
        state = [(seen[0] | seen[1]).alias("overlap"), seen[1].alias("target_seen")]
        rows = rows.join(flags.select("key", "origin", "input_seen", "target_seen"), ["key", "origin"], "left")
    bucket = F.floor((F.col("lead_h") - 1) / width).cast("int")
    o, p, b = F.col("obs"), F.col("pred"), F.col("bar")
    return rows.groupBy("model", "key", "lead_h", bucket.alias("bucket"), *state).agg(
        F.count("*").alias("n"), F.avg(o).alias("o"), F.avg(p).alias("p"),
        (F.var_pop(o) * F.count("*")).alias("oo"), (F.var_pop(p) * F.count("*")).alias("pp"), (F.covar_pop(o, p) * F.count("*")).alias("op"),
        F.sum(F.abs(p - o)).alias("sae"), F.sum((p - o) * (p - o)).alias("see"), F.sum((b - o) * (b - o)).alias("seb"),
    )


def _rolled(cells: DataFrame, scale: DataFrame | None) -> DataFrame:
    """Sums of the cells by model and key, by bucket, by each overlap state, and by lead hour over all keys."""
    own = Window.partitionBy("model", "key")  # at most four cells a lead hour
    shift = lambda c: (F.sum(F.col("n") * F.col(c)).over(own) / F.sum("n").over(own)).alias(f"shift_{c}")
    moved = cells.select("*", shift("o"), shift("p"))
    moved = moved.withColumn("std", F.lit(1.0)) if scale is None else moved.join(scale.select("key", "std"), "key", "left")
    n, do, dp = F.col("n"), F.col("o") - F.col("shift_o"), F.col("p") - F.col("shift_p")
    parts = {"n_do": n * do, "n_dp": n * dp, "oo": F.col("oo") + n * do * do, "pp": F.col("pp") + n * dp * dp, "op": F.col("op") + n * do * dp}
    # errors in units of the key's deviation, in which lead hours are pooled over keys
    parts |= {"ze": F.col("see") / (F.col("std") * F.col("std")), "zb": F.col("seb") / (F.col("std") * F.col("std"))}
    wide = moved.select("model", "key", "lead_h", "bucket", "overlap", "target_seen", "n", "sae", "see", "seb", "shift_o", "shift_p", *(v.alias(k) for k, v in parts.items()))
    grains = [["model", "key"], ["model", "key", "bucket"], ["model", "key", "overlap"], ["model", "key", "target_seen"], ["model", "lead_h"]]
    dims = ["model", "key", "bucket", "overlap", "target_seen", "lead_h"]
    sums = [F.sum(c).alias(c) for c in ("n", "sae", "see", "seb", *parts)]
    windows = F.sum(F.when(F.col("lead_h") == 1, F.col("n"))).alias("n_windows")
    rolled = wide.groupingSets([[F.col(c) for c in g] for g in grains], *(F.col(c) for c in dims))
    rolled = rolled.agg(F.grouping_id().alias("grain"), *sums, windows, F.max("shift_o").alias("shift_o"), F.max("shift_p").alias("shift_p"))
    code = {"|".join(g): sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in g) for g in grains}
    name = F.create_map(*(F.lit(x) for g, k in code.items() for x in (k, g.split("|")[-1])))
    return rolled.withColumn("grain", name[F.col("grain").cast("int")])


def _scores() -> Column:
    """The scores of a roll-up: zero variance gives an NSE of 0; KGE's parts are 1 where they are not defined."""
    n = F.col("n")
    mean_o, mean_p = F.col("shift_o") + F.col("n_do") / n, F.col("shift_p") + F.col("n_dp") / n
    oo = F.greatest(F.lit(0.0), F.col("oo") - F.col("n_do") * F.col("n_do") / n)
    pp = F.greatest(F.lit(0.0), F.col("pp") - F.col("n_dp") * F.col("n_dp") / n)
    so, sp = F.sqrt(oo / n), F.sqrt(pp / n)
    r = F.when((so <= EPS) | (sp <= EPS), 1.0).otherwise(F.try_divide((F.col("op") - F.col("n_do") * F.col("n_dp") / n) / n, so * sp))
    alpha = F.when(so <= EPS, 1.0).otherwise(F.try_divide(sp, so))
    beta = F.when(F.abs(mean_o) <= EPS, 1.0).otherwise(F.try_divide(mean_p, mean_o))
    nse = lambda e: F.when(oo <= EPS, 0.0).otherwise(1 - F.try_divide(F.col(e), oo))
    kge = 1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))
    named = {"nse": nse("see"), "nse_bar": nse("seb"), "kge": kge, "kge_r": r, "kge_alpha": alpha, "kge_beta": beta, "rmse": F.sqrt(F.col("see") / n), "mae": F.col("sae") / n}
    return F.struct(F.col("n_windows").alias("n_samples"), (oo > EPS).alias("varies"), *(v.alias(k) for k, v in named.items()))


def key_scores(cells: DataFrame, scale: DataFrame | None = None, width: int = 12, ahead: int = 48) -> DataFrame:
    """``model, key, whole, buckets, bar_buckets, subsets, skill``: one row for each model and key, and one with a null key
    and ``skill``, the array over lead hours of one minus the ratio of squared errors to those of the bar.

    ``scale`` has each key's ``std`` (1 without it). ``buckets`` maps ``h1-12`` and so on to the NSE within; buckets and subsets without variation are absent.
    """
    scored = _rolled(cells, scale).select("*", _scores().alias("s"))
    name = F.concat(F.lit("h"), F.col("bucket") * width + 1, F.lit("-"), F.least(F.lit(ahead), (F.col("bucket") + 1) * width))
    in_bucket = (F.col("grain") == "bucket") & F.col("s.varies")
    collected = lambda when, k, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct(k.alias("k"), v.alias("v"))))))
    subset = F.when(F.col("grain") == "overlap", F.when(F.col("overlap"), "dev_overlap").otherwise("dev_clean")).otherwise("dev_target_seen")
    of_subset = F.col("s.varies") & (((F.col("grain") == "overlap") & F.col("overlap").isNotNull()) | ((F.col("grain") == "target_seen") & F.col("target_seen")))
    hour = F.struct(F.col("lead_h").alias("k"), F.when(F.col("zb") > 0, 1 - F.try_divide("ze", "zb")).alias("v"))
    return scored.groupBy("model", "key").agg(
        F.max(F.when(F.col("grain") == "key", F.col("s"))).alias("whole"),
        collected(in_bucket, name, F.col("s.nse")).alias("buckets"), collected(in_bucket, name, F.col("s.nse_bar")).alias("bar_buckets"),
        collected(of_subset, subset, F.col("s.nse")).alias("subsets"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("grain") == "lead_h", hour))), lambda x: x["v"]).alias("skill"),
    )


def score_document(
    rows: DataFrame, scale: DataFrame, flags: DataFrame | None = None, tails: DataFrame | None = None, width: int = 12, ahead: int = 48, with_keys: bool = True
) -> DataFrame:
    """``model, document``: every score of each model as one struct of numbers, maps and arrays.

    ``scale`` has each key's ``std``; ``tails`` has ``model, key, highflow_beta, fhv``. ``with_keys`` adds an array with the
    scores of each key, for as many keys as a document can hold; ``key_scores`` has them as rows.
    """
    each = key_scores(moments_cube(rows, flags, width), scale, width, ahead)
    if tails is None:
        each = each.withColumn("highflow_beta", F.lit(None).cast("double")).withColumn("fhv", F.lit(None).cast("double"))
    else:
        each = each.join(tails.select("model", "key", "highflow_beta", "fhv"), ["model", "key"], "left")
    w = lambda c: F.col(f"whole.{c}")
    known = F.col("key").isNotNull()
    valid = known & w("nse").isNotNull() & ~F.isnan(w("nse")) & w("kge").isNotNull() & ~F.isnan(w("kge"))
    of = lambda c: F.when(valid, w(c))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    share = lambda least: 100 * F.count_if(valid & (w("nse") > least)) / F.count_if(known)
    names = [f"h{lo + 1}-{min(ahead, lo + width)}" for lo in range(0, ahead, width)]

    def medians(column: str, labels: Sequence[str]) -> Column:
        """A map of the labels that some key has to their medians over keys."""
        entries = F.array(*(F.struct(F.lit(x).alias("k"), F.median(F.try_element_at(column, F.lit(x))).alias("v")) for x in labels))
        return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))

    fields = {
        "n_basins": F.count_if(valid), "n_basins_total": F.count_if(known), "n_samples": F.sum(w("n_samples")),
        "median_nse": F.median(of("nse")), "mean_nse": F.avg(of("nse")), "std_nse": F.stddev_pop(of("nse")), "mean_nse_clip": F.avg(F.when(valid, F.greatest(w("nse"), F.lit(-1.0)))),
        "pct_nse_05": share(0.5), "pct_nse_07": share(0.7), "median_kge": F.median(of("kge")), "mean_kge": F.avg(of("kge")),
        "median_rmse": F.median(of("rmse")), "median_mae": F.median(of("mae")), "median_highflow_beta": F.median(real("highflow_beta")), "median_fhv": F.median(real("fhv")),
        "median_nse_persistence": F.median(w("nse_bar")), "horizon_nse": medians("buckets", names), "horizon_nse_persistence": medians("bar_buckets", names),
        "skill_by_lead": F.flatten(F.collect_list(F.when(~known, F.col("skill")))), "subset_median_nse": medians("subsets", list(SUBSETS)),
    }
    if with_keys:
        scores = [w(c).alias(c) for c in ("n_samples", "nse", "kge", "kge_r", "kge_alpha", "kge_beta", "rmse", "mae")]
        fields["per_basin"] = F.array_sort(F.collect_list(F.when(known, F.struct("key", *scores, F.col("buckets").alias("horizon")))), _by_key)
    return each.groupBy("model").agg(F.struct(*(v.alias(k) for k, v in fields.items())).alias("document"))


def _by_key(x: Column, y: Column) -> Column:
    return F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)


def baseline_rows(windows: DataFrame, kinds: Sequence[str] = KINDS, bar: str = "persistence") -> DataFrame:
    """``model, key, origin, lead_h, obs, pred, bar`` of all closed-form forecasts, from one look at the windows."""
    made = with_forecasts(windows, *dict.fromkeys([*kinds, bar]))
    long = long_targets(made, *dict.fromkeys([*kinds, bar]))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.col(k).alias("pred")) for k in kinds)))
    return long.select("key", "origin", "lead_h", "obs", F.col(bar).alias("bar"), each.alias("m")).select("m.model", "key", "origin", "lead_h", "obs", "m.pred", "bar")


def evaluate(rows: DataFrame, scale: DataFrame, split: str, flags: DataFrame | None = None, tails: DataFrame | None = None) -> DataFrame:
    """``score_document`` as for a split: the subsets by overlap are of the dev split only."""
    return score_document(rows, scale, flags if split == "dev" else None, tails)


def known_and_unseen(scores: DataFrame, training_keys: DataFrame) -> DataFrame:
    """``model, known, n_keys, median_nse`` of ``model, key, nse``: keys that training has had, and those it has not."""
    seen = training_keys.select("key").distinct().withColumn("known", F.lit(True))
    marked = scores.join(seen, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return quantiles(marked, ["model", "known"], "nse", {"median_nse": 0.5}).select("model", "known", F.col("n_rows").alias("n_keys"), "median_nse")
