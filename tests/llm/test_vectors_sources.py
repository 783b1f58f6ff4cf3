"""Divergence of sources, near-duplicate embeddings and vector codes against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from gaugeflow.llm import divergence
from gaugeflow.llm.codes import codebooks_sha256, compress, decode, kd_tree, nearest
from gaugeflow.llm.divergence import shares, source_divergence, terms_of
from gaugeflow.llm.vectors import shared_counts, similar_vectors, spread_pivots


def plain_divergence(rows, least=30, top=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", [w.translate(lower) for w in term.findall(text or "")]) for text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in held[lang].items() if n >= least)
        by = {s: [counts[lang, s][w] for w in kept] for s in sources}
        by[None] = [sum(by[s][i] for s in sources) for i in range(len(kept))]
        p = {s: [1 + 10**9 * (c + 5) // (sum(v) + 5 * len(kept)) for c in v] for s, v in by.items()}
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources - {s}]
            best = [(a - q, w) for a, q, c, w in zip(p[s], p[None], by[s], kept, strict=True) if c and a > q]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, value string, item int"


def test_divergence_over_blocks_chunks_and_flushes(spark):
    rng = np.random.default_rng(3)
    words = ["the", "The", "été", "naïve", "o'clock", "x1y2", "日本語", "A", "zebra", "Straße", "mid-word", " nbsp"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, rng.integers(0, 30)))
        rows.append((i if i % 9 else None, text, ["en", "de", None][i % 3], None if i % 11 == 0 else f"s{int(rng.integers(0, 7))}", "clash", 1))
    rows += [(1, None, "en", "s1", None, None), (2, "", "fr", "alone", None, None), (3, "...", "it", "a", None, None), (4, None, "it", "b", None, None)]
    rows += rows[:20]
    want = plain_divergence([r[1:4] for r in rows], least=10, top=3)
    docs = spark.createDataFrame(rows, DOCS)
    for settings in ({}, {"block": 2, "chunk_rows": 7, "postings": 5}):
        got = source_divergence(docs, least_docs=10, top=3, **settings).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == want
    assert any(r[0] == "it" and r[4] == 0 for r in want) and not any(r[0] == "fr" for r in want)
    assert source_divergence(docs.limit(0)).count() == 0


def test_divergence_with_terms_longer_than_a_batch(spark):
    """Runs of a term go over record batches of any size."""
    rows = [(i, "many words here " * (i % 3 + 1), "en", f"s{i % 40}", None, None) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = source_divergence(spark.createDataFrame(rows, DOCS), least_docs=5, postings=1, block=8)
        assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence([r[1:4] for r in rows], least=5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_terms_of_pieces_and_exact_shares():
    text = ("Ünder " + "x" * 5000 + "  A-b\t" + "été " * 50).encode()
    whole = list(terms_of(text, 1 << 20))[0]
    for piece in (1, 3, 17, 4096):
        assert [w for words in terms_of(text, piece) for w in words] == whole
    big = np.array([9_000_000_000_000_000 - 5, 10**12, 0])
    total = 9_000_000_000_000_001
    assert shares(big, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in big]
    assert divergence.SCALE == 10**9


def plain_links(rows, least=0.95):
    fine = [v is not None and len(v) == 4 and None not in v and all(np.isfinite(v)) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)) if f else None for (_, v), f in zip(rows, fine, strict=True)]
    link = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and fine[a] and fine[b] and unit[a] @ unit[b] >= least}
    label = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for a, b in link:
            x, y = rows[a][0], rows[b][0]
            label[x] = label[y] = min(label[x], label[y])
    return [(i, sum(a == k for a, _ in link), label.get(i), i is None or label[i] == i) for k, (i, _) in enumerate(rows)]


def test_similar_vectors_small_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0, 0.0])]
    rows += [(7, [inf, 0.0, 0.0, 0.0]), (8, [nan, 0.0, 0.0, 0.0]), (9, [1e200, 1e200, 0.0, 0.0]), (10, [1e-200, 1e-200, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0, 0.0])]
    rows += [(12, [1.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0]), (20, [0.0, 0.0, 3.0, 0.0]), (13, []), (1, [1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, links string")
    got = [tuple(r) for r in similar_vectors(table).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(plain_links(rows), key=key)
    assert similar_vectors(table.limit(0)).count() == 0
    assert [tuple(r) for r in similar_vectors(table.where("vec_id = 4")).collect()] == [(4, 0, 4, True)]


def test_similar_vectors_recall_and_hot_groups(spark):
    """A third of the rows are near copies of one vector, over several blocks; pairs lie closely around the threshold."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 16))
    hot = base[0] + 0.06 * rng.normal(size=(500, 16))
    near = np.repeat(base[1:151], 2, axis=0) + 0.2 * rng.normal(size=(300, 16))
    x = np.concatenate([base, hot, near, np.repeat(base[5:6], 60, axis=0)])
    x = x[rng.permutation(len(x))].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = ((u @ u.T >= 0.95).sum(axis=1) - 1).astype(int)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in similar_vectors(table, block=128).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum() and want.max() > 400
    for i, j in zip(*np.nonzero(u @ u.T >= 0.95), strict=True):
        if n[i] == want[i]:
            assert got[i].component_id == got[j].component_id
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got.values())


def test_shared_counts_and_pivots():
    rng = np.random.default_rng(2)
    for high in (8, 500):
        a, b = (np.array([rng.choice(high, 6, replace=False) for _ in range(n)]) for n in (40, 70))
        a[rng.random(a.shape) < 0.3] = -1
        want = [[len((set(x) & set(y)) - {-1}) for y in b.tolist()] for x in a.tolist()]
        assert shared_counts(a, b).tolist() == want
    some = rng.normal(size=(600, 5))
    some /= np.linalg.norm(some, axis=1)[:, None]
    found = spread_pivots(some, 100, 0.8)
    c = found @ found.T - 2 * np.eye(len(found))
    assert c.max() <= 0.8 and (len(found) == 100 or ((some @ found.T).max(axis=1) > 0.8).all())


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cells = [[int(np.floor(4096 * x)) if abs(x) < 1e15 else 4096 * int(x) for x in v] for _, v, _ in rows]
    w = len(cells[0]) // parts
    cut = [[tuple(c[k * w : (k + 1) * w]) for c in cells] for k in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def assign(k):
        return [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(books[k])) for p in cut[k]]

    for _ in range(rounds):
        for k in range(parts):
            of = assign(k)
            for i in {i for _, i in of}:
                own = [p for p, (_, j) in zip(cut[k], of, strict=True) if i == j]
                books[k][i] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = [assign(k) for k in range(parts)]
    error = [sum(d for d, _ in f) for f in zip(*found, strict=True)]
    code = ["".join(f"{i:02x}" for _, i in f) for f in zip(*found, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], c, e if e < 2**63 else None) for r, c, e in zip(rows, code, error, strict=True)], sha


@pytest.mark.parametrize("huge", [False, True])
def test_codes_against_plain_python(spark, huge):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 16) / 64 + rng.choice([0, 1e-5, -1e-5])], int(i % 3) if i % 5 else None) for i in rng.permutation(90)]
    rows += rows[:7] + [(3, rows[0][1], 1), (None, rows[1][1], 2), (200, [0.0] * 15 + [None], 0), (201, None, 0), (202, [float("nan")] * 16, 0), (203, [float("-inf")] + [0.0] * 15, 0)]
    if huge:
        rows += [(-1, [3e38] * 16, 0), (300, [1e12] * 16, 9), (301, [-1e30] + [0.5] * 15, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, part string, total int")
    codes, books = compress(table)
    want, sha = plain_codes(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in codes.select("vec_id", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert codebooks_sha256(books) == sha
    if not huge:
        one = codes.where("vec_id = 3").first()
        assert len(decode(one.code, books)) == 16


def test_codes_of_few_and_other_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert compress(spark.createDataFrame([], kind))[0].count() == 0
    rows = [(1, [0.5] * 8, "a"), (2, [0.25] * 8, "a"), (3, [1.0] * 16, "b"), (4, [], "b")]
    codes, books = compress(spark.createDataFrame(rows, kind))
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)] and books[0].tolist() == [[2048], [1024]]
    assert compress(spark.createDataFrame([(1, [0.5] * 9, "a")], kind))[0].count() == 0


def test_nearest_keeps_lower_index_ties():
    rng = np.random.default_rng(5)
    for _ in range(20):
        entries, points = rng.integers(-3, 4, (16, 3)), rng.integers(-4, 5, (200, 3))
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, distance = nearest(kd_tree(entries), entries, points)
        assert index.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()


def test_registered_query_of_codes(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op13_vector_codes"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, sha = plain_codes(rows)
    label = {r[0]: r[2] for r in rows}
    total = Counter()
    for i, _, e in want:
        total[label[i]] += e
    assert sorted(tuple(r) for r in got) == sorted((i, c, e, total[label[i]], sha) for i, c, e in want)
