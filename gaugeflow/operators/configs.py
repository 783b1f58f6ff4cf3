"""Nested settings: layers merged by priority, written in one canonical text, and named by its hash.

A layer is a JSON object. It is parsed to VARIANT and opened level by level into rows of paths, so merging is grouping: at
equal paths the layer with the highest priority wins, a value replaces all that earlier layers have below it, and an object
replaces an earlier value at its place but joins an earlier object. Lists are values. The canonical text is that of Python's
``json.dumps(..., sort_keys=True)``: keys by code point, ", " and ": " between, non-ASCII characters escaped.

Layers that are null, no JSON or no object add nothing; an id without any other gives ``{}``. Numbers written with a fraction
or an exponent are floats and take the shortest digits that give them back, others are integers; of whole numbers with more
than 18 digits a fraction of zeros is not told apart.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import Scratch



def json_string(text: Column) -> Column:
    """The text as a JSON string in ASCII."""
    u = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c == '"', short['"'])
        for plain, text_ in list(short.items())[1:]:
            out = out.when(c == F.lit(plain), text_)
        high = F.lit(0xD800) + F.floor((code - 0x10000) / 1024).cast("int")
        pair = F.concat(u(high), u(F.lit(0xDC00) + (code - 0x10000) % 1024))
        return out.when((code >= 32) & (code <= 126), c).when(code < 0x10000, u(code)).otherwise(pair)

    characters = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    plain = text.rlike(r"\A[ !#-\[\]-~]*\z")  # nothing to escape
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(characters, escaped), "")), F.lit('"'))


def float_text(x: Column) -> Column:
    """A double by the fewest digits that give it back; plain between 1e-4 and 1e16, else with an exponent."""
    tries = [F.format_string(f"%.{p}e", x) for p in range(17)]
    shortest = F.coalesce(*(F.when(t.cast("double") == x, t) for t in tries[:-1]), tries[-1])
    sign = F.when(shortest.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.split_part(shortest, F.lit("e"), F.lit(1)), "[-.]", ""), "(?<=.)0+$", "")
    power = F.split_part(shortest, F.lit("e"), F.lit(2)).cast("int")
    whole = F.substring(F.rpad(digits, 20, "0"), F.lit(1), power + 1)
    rest = F.substring(digits, power + 2, F.lit(30))
    plain = F.when(power >= 0, F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)))
    plain = plain.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(30)))).otherwise(""))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    finite = F.concat(sign, F.when((power >= -4) & (power < 16), plain).otherwise(scientific))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(finite)


def _scalar_text(v: Column) -> Column:
    kind, text = F.schema_of_variant(v), F.to_json(v)
    long_integer = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    real = (kind == "DOUBLE") | (kind == "FLOAT") | (kind.startswith("DECIMAL") & ~long_integer)
    return F.when(kind == "STRING", json_string(F.try_variant_get(v, "$", "string"))).when(real, float_text(F.try_variant_get(v, "$", "double"))).otherwise(text)


def open_paths(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows with ``path`` and VARIANT ``v`` opened to scalars and their canonical ``text``; empty objects and lists are values
    too. A step is ``k`` and a key, or ``i`` and a place in a list.

    A level is opened at a time, as deep as the data go; rows that are scalars already pass through, so all levels are one pass.
    Nothing is written in between, since writing VARIANT may turn integers into decimals. ``most`` bounds the depth, where it
    is known, so that the last level need not be looked at.
    """
    others = [c for c in rows.columns if c not in ("path", "v")]
    for level in itertools.count():
        kind = F.schema_of_variant("v")
        open_ = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        if level == most or rows.where(open_).isEmpty():
            return rows.select(*others, "path", _scalar_text(F.col("v")).alias("text"))
        marked = rows.withColumn("_open", F.when(open_, F.col("v")))
        parts = marked.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("k"), "key")).otherwise(F.concat(F.lit("i"), F.lpad(F.col("pos").cast("string"), 10, "0")))
        opened = F.col("_open").isNotNull()
        rows = parts.select(*others, F.when(opened, F.array_append("path", step)).otherwise(F.col("path")).alias("path"), F.when(opened, F.col("value")).otherwise(F.col("v")).alias("v"))


def _above(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each place above a row's path, as ``path``; the row's own is ``below``."""
    steps = F.explode(F.sequence(F.lit(0), F.size("path") - 1))
    return rows.where(F.size("path") > 0).select("id", F.col("path").alias("below"), *columns, steps.alias("_k")).select("id", "below", F.slice("below", F.lit(1), F.col("_k")).alias("path"), *columns)


def merged_paths(layers: DataFrame) -> DataFrame:
    """``id, path, text``: the values of ``layers`` (``id, priority, config``) that no later layer replaces.

    Of layers with equal priority the one with the greater text is the later.
    """
    scratch = Scratch(layers.sparkSession, "merge-configs")
    # layers in order are numbered, so a turn is a number: rows of an id lie together and their maxima are taken before the shuffle
    ordered = layers.select("id", "priority", "config").orderBy("id", "priority", "config")
    ordered = scratch.table(ordered.select("id", "config", F.monotonically_increasing_id().alias("turn")), "layers")
    brackets = F.length("config") - F.length(F.translate("config", "{[", ""))  # no text is deeper than it has of them
    deepest = ordered.agg(F.max(brackets)).first()[0] or 0
    parsed = ordered.select("id", "turn", F.try_parse_json(F.col("config")).alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT<")).withColumn("path", F.array().cast("array<string>"))
    whole = F.coalesce(F.array_position(F.transform("path", lambda x: x.startswith("i")), True), F.lit(0))  # the first step into a list
    at_path = F.when(whole > 0, F.slice("path", F.lit(1), whole.cast("int") - 1)).otherwise(F.col("path"))
    found = scratch.table(open_paths(parsed, deepest).select("id", "turn", at_path.alias("at"), F.col("path").alias("full"), "text"), "values")
    empty = (F.col("text") == "{}") & (F.size("full") == F.size("at"))
    at = found.groupBy("id", F.col("at").alias("path")).agg(
        F.max("turn").alias("top"), F.max(F.when(~empty, F.col("turn"))).alias("value_top"), F.max_by(empty, "turn").alias("empty")
    )
    at = scratch.table(at, "at")
    inside = _above(at, "top").groupBy("id", "path").agg(F.max("top").alias("inside"))
    over = _above(at).join(at.select("id", "path", "value_top"), ["id", "path"]).groupBy("id", F.col("below").alias("path")).agg(F.max("value_top").alias("over"))
    alive = at.join(inside, ["id", "path"], "left").join(over, ["id", "path"], "left")
    alive = alive.where(F.coalesce(F.col("over") < F.col("top"), F.lit(True)))
    alive = scratch.table(alive.where(F.col("empty") | F.coalesce(F.col("inside") < F.col("top"), F.lit(True))).select("id", "path", "top", "empty"), "alive")
    filled = _above(alive).select("id", "path").distinct()
    last = alive.where("not empty").unionByName(alive.where("empty").join(filled, ["id", "path"], "left_anti"))
    last = last.select("id", F.col("path").alias("at"), F.col("top").alias("turn"))
    return found.join(last, ["id", "at", "turn"], "left_semi").select("id", F.col("full").alias("path"), "text")


def canonical_text(paths: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, config``: the canonical text of the values ``id, path, text``; ``ids`` without any have ``{}``."""
    texts = Scratch(paths.sparkSession, "canonical-text").table(paths.select("id", "path", "text"), "texts")
    depth = texts.agg(F.max(F.size("path"))).first()[0] or 0
    for d in range(depth, 0, -1):
        last = F.element_at("path", -1)
        inner = texts.where(F.size("path") == d).groupBy("id", F.slice("path", 1, d - 1).alias("path"))
        # what one object or list holds, by its keys or places
        inner = inner.agg(F.array_sort(F.collect_list(F.struct(last.alias("step"), "text"))).alias("held"))
        named = F.array_join(F.transform("held", lambda x: F.concat(json_string(F.substring(x["step"], F.lit(2), F.length(x["step"]))), F.lit(": "), x["text"])), ", ")
        listed = F.array_join(F.transform("held", lambda x: x["text"]), ", ")
        is_list = F.col("held")[0]["step"].startswith("i")
        text = F.when(is_list, F.concat(F.lit("["), listed, F.lit("]"))).otherwise(F.concat(F.lit("{"), named, F.lit("}")))
        texts = texts.where(F.size("path") < d).unionByName(inner.select("id", "path", text.alias("text")))
    texts = texts.select("id", F.col("text").alias("config"))
    return texts if ids is None else ids.select("id").distinct().join(texts, "id", "left").select("id", F.coalesce("config", F.lit("{}")).alias("config"))


def merge_configs(layers: DataFrame) -> DataFrame:
    """``id, config, key``: the layers of each id merged, in canonical text, and the first twelve digits of its SHA-256."""
    return canonical_text(merged_paths(layers), layers).withColumn("key", F.substring(F.sha2("config", 256), 1, 12))


def content_keys(layers: DataFrame, fields: Sequence[str], constants: dict | None = None, unless: dict | None = None) -> DataFrame:
    """``id, config, key`` of the settings that decide a content: the merged ``fields``, ``constants`` by name, and those of
    ``unless`` whose value is not the one given there (a scalar), so that a new setting keeps the keys from before it."""
    first = F.try_element_at("path", F.lit(1))
    merged = Scratch(layers.sparkSession, "content-keys").table(merged_paths(layers), "merged")
    kept = merged.where(first.isin([f"k{f}" for f in fields]))
    for name, default in (unless or {}).items():
        same = (F.col("text") == json.dumps(default)) & (F.size("path") == 1)
        kept = kept.unionByName(merged.where((first == f"k{name}") & ~same))
    for name, value in (constants or {}).items():
        text = F.lit(json.dumps(value, sort_keys=True)).alias("text")
        kept = kept.unionByName(layers.select("id").distinct().select("id", F.array(F.lit(f"k{name}")).alias("path"), text))
    return canonical_text(kept, layers).withColumn("key", F.substring(F.sha2("config", 256), 1, 12))
