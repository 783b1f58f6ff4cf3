"""Merged settings and their canonical text against Python's own JSON."""

import hashlib
import json
import random

from gaugeflow.operators.configs import content_keys, merge_configs

LAYERS = "id string, priority int, config string"


def merge(base, more):
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            merge(base[k], v)
        else:
            base[k] = json.loads(json.dumps(v))
    return base


def check(spark, layers):
    want = {}
    for i, _, text in sorted(layers, key=lambda x: (x[0], x[1])):
        try:
            config = json.loads(text)
        except (TypeError, ValueError):
            config = {}
        merge(want.setdefault(i, {}), config if isinstance(config, dict) else {})
    got = {r["id"]: (r["config"], r["key"]) for r in merge_configs(spark.createDataFrame(layers, LAYERS)).collect()}
    assert set(got) == set(want)
    for i, config in want.items():
        text = json.dumps(config, sort_keys=True)
        assert got[i] == (text, hashlib.sha256(text.encode()).hexdigest()[:12])


def test_values_as_python_writes_them(spark):
    values = [0, -7, 10**17, 10**25, 1.0, -0.5, 0.1, 1e-4, 1e-5, 123456.789, 1e15, 1e16, 1.5e300, 2.5e-300, 0.1 + 0.2, 100.0, True, False, None, "", "é😀\x7f\x01\"\\/\n\t", [], {}, [1, [2.5, {"b": [], "a": None}], "x"]]
    layers = [(f"v{k}", 1, json.dumps({"x": v, "É": {"z": v, "a": 1, "B": 2}})) for k, v in enumerate(values)]
    check(spark, layers + [("keys", 1, json.dumps({"é": 1, "z": 2, "Z": 3, "a b": 4, 'q"': 5, "😀": 6, "￿": 7, "": 8}))])


def test_later_layers_win_deeply(spark):
    layers = [
        ("scalar", 1, '{"a": {"b": 1, "c": 2}}'), ("scalar", 2, '{"a": 5}'), ("scalar", 3, '{"a": {}}'),
        ("join", 1, '{"a": {"b": 1}, "l": [1, 2]}'), ("join", 2, '{"a": {"c": {"d": 1}}, "l": [3]}'), ("join", 3, '{"a": {}, "n": null}'),
        ("back", 1, '{"a": 1}'), ("back", 2, '{"a": {"x": {"y": 2}}}'), ("back", 3, '{"a": {"x": 3}}'),
        ("bad", 1, None), ("bad", 2, "{nope"), ("bad", 3, "[1]"), ("null", 1, '{"seed": 1}'), ("null", 2, '{"seed": null}'), ("empty", 1, "{}"),
    ]
    check(spark, layers)


def test_random_layers(spark):
    rng = random.Random(6)

    def some(depth):
        kind = rng.random()
        if depth and kind < 0.6:
            return {rng.choice("abc"): some(depth - 1) for _ in range(rng.randrange(3))}
        return rng.choice([1, 2.5, "s", None, [], [1, {"b": 2}], {}])

    layers = []
    for i in range(80):
        for p in range(rng.randrange(1, 5)):
            layers.append((f"r{i}", p, json.dumps({k: some(3) for k in rng.sample("abcd", 2)})))
    check(spark, layers)


def test_content_keys_ignore_other_fields_and_defaults(spark):
    def key(**settings):
        rows = [("x", 1, json.dumps(settings))]
        return content_keys(spark.createDataFrame(rows, LAYERS), ["noise", "trials"], {"version": 3}, {"edge": "anchor"}).first()

    plain = key(noise=0.05, trials=100, n_high=2)
    text = json.dumps({"noise": 0.05, "trials": 100, "version": 3}, sort_keys=True)
    assert (plain["config"], plain["key"]) == (text, hashlib.sha256(text.encode()).hexdigest()[:12])
    assert key(trials=100, noise=0.05, n_high=3, edge="anchor")["key"] == plain["key"]
    assert key(trials=100, noise=0.05, edge="mirror")["key"] != plain["key"] != key(trials=50, noise=0.05)["key"]
    assert merge_configs(spark.createDataFrame([], LAYERS)).count() == 0


def test_levels_are_one_pass_and_equal_layers_count_once(spark):
    from pyspark.sql import functions as F

    from gaugeflow.operators.configs import merge_configs, open_paths

    rows = spark.createDataFrame([('{"a": {"b": [1, {"c": "x\\n"}], "d": {}}, "e": "y\\"z"}',)], "config string")
    opened = open_paths(rows.select(F.try_parse_json(F.col("config")).alias("v"), F.array().cast("array<string>").alias("path")))
    assert "Union" not in opened._jdf.queryExecution().optimizedPlan().toString()  # a union would parse the texts again for each level
    assert opened.count() == 4
    layers = spark.createDataFrame([(1, 5, '{"l": [1, 2]}'), (1, 5, '{"l": [1, 2]}'), (1, 4, '{"l": [3], "m": "{[{["}')], "id long, priority long, config string")
    assert merge_configs(layers).first()["config"] == '{"l": [1, 2], "m": "{[{["}'
