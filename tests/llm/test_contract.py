"""The registered queries on the smallest tables, with every contract column worked out anew in plain Python."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def query(spark, name):
    import __spark_entry__ as entry

    return {r["doc_id"]: r for r in entry.queries()[name](spark, SF).collect()}


def words(text, lower=False):
    data = text.encode()
    return (data.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else data).split()


def test_op1(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in query(spark, "op1_near_dedup").items()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_op4(spark, texts):
    got = query(spark, "op4_quality_rules")
    assert set(got) == set(texts)
    for i, t in texts.items():
        w, at = words(t), collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {k + j for p in at.values() if len(p) > 1 for k in p for j in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_op5(spark, texts):
    first, got = {}, query(spark, "op5_substring_dedup")
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts.items():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_op7(spark, texts):
    got = query(spark, "op7_sharding")
    for i, t in texts.items():
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None)
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    counts = [len(s) for s in slots.values()]
    assert sorted(slots) == list(range(8)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, texts):
    tokens = {i: [*words(t, True), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    got = query(spark, "op9_lm_scores")
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), abs_tol=1e-5)
        assert r["score"] < 0
    total = lambda c: sum(r[c] for r in got.values() if r["held_out"])
    assert total("score") > total("base_score")
