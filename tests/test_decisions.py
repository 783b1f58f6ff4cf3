"""Rules over paired runs by hand: adopted, rejected, pending, and what a missing figure does."""

import math

import pytest

from gaugeflow.operators.decisions import decide, ema_votes, metric_rows, pair_texts, resolved

RUN = "arm string, seed int, median_nse double, horizon_nse map<string,double>, skill_by_lead array<double>, highflow_beta double, sanval double"
RULE = "rule string, kind string, treat string, ref string"


def run(arm, seed, nse, late=0.3, skill=(0.1, 0.1, 0.1), beta=0.95, sanval=0.5):
    return (arm, seed, nse, {"h25_36": late, "h37_48": late} if late is not None else {"h25_36": 0.1}, list(skill) if skill else None, beta, sanval)


def judge(spark, runs, *rules):
    metrics = metric_rows(spark.createDataFrame(runs, RUN))
    asked = spark.createDataFrame([(f"{k} {t}-{r}", k, t, r) for k, t, r in rules], RULE)
    return {r.rule: r for r in decide(asked, metrics).collect()}, {r.rule: r.pairs for r in pair_texts(asked, metrics).collect()}


def test_rules(spark):
    seeds = (42, 123, 177)
    runs = [run("base", s, 0.60) for s in seeds] + [run("good", s, 0.63 + s / 1e5, late=0.31, skill=(0.2, 0.2, 0.2)) for s in seeds]
    runs += [run("uneven", s, v) for s, v in zip(seeds, (0.59, 0.68, 0.68), strict=True)] + [run("late", s, 0.65, late=0.2) for s in seeds]
    runs += [run("two", s, 0.7) for s in seeds[:2]] + [run("other", 7, 0.9)] + [run("nolate", s, 0.7, late=None) for s in seeds]
    runs += [run("biased", s, 0.7, beta=b) for s, b in zip(seeds, (0.8, float("nan"), 0.9), strict=True)] + [run("noskill", 42, 0.7, skill=None), run("flat", 42, 0.61, skill=(0.1, 0.1, 0.1), sanval=0.519)]
    arms = ("good", "uneven", "late", "two", "other", "nolate", "biased", "noskill", "flat", "none")
    got, texts = judge(spark, runs, *[(k, a, "base") for k in ("adopt", "pick", "gate", "close") for a in arms])
    verdicts = lambda kind: {a: got[f"{kind} {a}-base"].verdict for a in arms}
    waits = {a: "PENDING" for a in arms}
    assert verdicts("adopt") == waits | {"good": "ADOPT", "uneven": "REJECT", "late": "REJECT", "biased": "ADOPT"}
    assert verdicts("pick") == waits | {"good": "MAE", "uneven": "MAE", "late": "MAE", "nolate": "MAE", "biased": "Huber 0.5"}
    assert verdicts("gate") == waits | {"good": "PASS", "uneven": "FAIL", "late": "FAIL", "two": "FAIL", "nolate": "FAIL", "biased": "FAIL", "flat": "FAIL"}
    assert verdicts("close") == waits | {"good": "KEEP", "uneven": "CLOSE", "late": "KEEP", "two": "KEEP", "nolate": "KEEP", "biased": "KEEP", "noskill": "KEEP", "flat": "CLOSE"}
    assert got["adopt good-base"].n_pairs == 3 and got["adopt two-base"].n_pairs == 2 and got["adopt other-base"].n_pairs == 0
    assert got["adopt uneven-base"]["values"]["median_nse min"] == pytest.approx(-0.01)
    assert texts["adopt uneven-base"] == "s42: -0.0100 (h25-48 +0.0000)  s123: +0.0800 (h25-48 +0.0000)  s177: +0.0800 (h25-48 +0.0000)"
    assert texts["adopt none-base"] == "-" and texts["adopt nolate-base"].startswith("s42: +0.1000 (h25-48 -)")


def test_texts_round_the_double_and_not_its_text(spark):
    runs = [run("base", s, 0.0, late=0.0) for s in (1, 2, 3)] + [run("arm", 1, -0.31765, late=0.03125), run("arm", 2, 0.09375, late=1.00005), run("arm", 3, -0.00001, late=float("nan"))]
    _, texts = judge(spark, runs, ("adopt", "arm", "base"))
    assert texts["adopt arm-base"] == "s1: -0.3176 (h25-48 +0.0312)  s2: +0.0938 (h25-48 +1.0001)  s3: -0.0000 (h25-48 +nan)"


def test_which_file_of_a_run_counts(spark):
    rows = [("a", "own", [0.1], 1.0), ("a", "rescore", [0.2], 2.0), ("b", "own", None, 1.0), ("b", "rescore", None, 2.0), ("c", "own", [], 1.0), ("d", "rescore", [0.1], 2.0), ("e", "else", [0.1], 3.0)]
    got = resolved(spark.createDataFrame(rows, "run string, source string, skill_by_lead array<double>, v double"))
    assert {r.run: r.v for r in got.collect()} == {"a": 1.0, "b": 2.0, "c": 1.0, "d": 2.0}


def test_votes_of_curves(spark):
    curves = {"up": ([0.1, 0.2, 0.3, 0.2], [0.2, 0.3, 0.3, 0.3]), "down": ([0.5] * 3, [0.4] * 3), "short": ([0.1] * 2, [0.9] * 2), "none": ([0.1] * 3, [None] * 3), "nan": ([math.nan] * 3, [0.5] * 3), "same": ([0.2] * 5, [0.2] * 5)}
    rows = [(k, e, raw[e], ema[e]) for k, (raw, ema) in curves.items() for e in range(len(raw))]
    votes = ema_votes(spark.createDataFrame(rows, "run string, epoch int, nse double, ema double"))
    assert tuple(votes.first()) == ("*", 0, "votes", 2.0)
    rule = spark.createDataFrame([("ema", "votes", "*", "*")], RULE)
    assert decide(rule, votes).first().verdict == "REJECT"
    assert decide(rule, votes.selectExpr("arm", "seed", "metric", "value + 2 AS value")).first().verdict == "ADOPT"
    assert decide(rule, votes.limit(0)).first().verdict == "PENDING"
