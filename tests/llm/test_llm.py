import collections
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import decontaminate, lm, near_dedup, packing, quality, sharding, substrings, tokens, urls, warc
from gaugeflow.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 4, 5, 30, 120, 300]))]
        if rng.random() < 0.3:
            w[rng.randint(0, len(w)) : 0] = passage.split()
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
        if rng.random() < 0.4:
            other = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    return texts + [None, "", "  \n", texts[3], "A b C d E", "a B c D e", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text, lower=False):
    data = (text or "").encode()
    return (data.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else data).split()


def test_near_duplicates_against_brute_force(docs, empty):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = split(r["text"], True)
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for options in ({}, {"first_k": 16, "k": 32, "loss": 1e-6}, {"hub_rounds": 2}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, **options).collect()}
        assert {i: g[:2] for i, g in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
        assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 2), (4, "a b c d e f", 3), (9, "a b c d e f", 4)], "doc_id long, text string, kept int")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted([("None", None, True), ("4", 4, True), ("4", 4, True), ("4", 4, True), ("9", 4, False)])


def test_repeats_against_brute_force(docs, empty):
    rows = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    first = {}
    for i, w in sorted(rows):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, single_spaces=True).collect()}
    spaced = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    removed = 0
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        removed += sum(gone)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert hashlib.sha256(got[i]["text"].encode()).digest() == hashlib.sha256(b" ".join(kept)).digest()
        assert split(spaced[i]["text"]) == kept
    assert removed > 500
    assert substrings.remove_repeats(empty).count() == 0


def test_leaked_items_against_brute_force(spark, empty):
    rng = random.Random(5)
    items = [(k, " ".join(f"b{rng.randrange(400)}" for _ in range(n))) for k, n in enumerate([14, 30, 30, 55, 3])] + [(8, None), (9, "")]
    rows = []
    for i in range(80):
        w = [f"d{rng.randrange(300)}" for _ in range(rng.randint(0, 90))]
        if i % 2:
            leak = items[rng.randrange(4)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                leak[rng.randrange(len(leak))] = "changed"
            w[rng.randint(0, len(w)) : 0] = leak
        rows.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    rows += [(90, items[4][1]), (91, None), (92, "")]
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    want = {}
    for i, text in rows:
        w = (text or "").lower().split()
        for k, item in items:
            b = bag((item or "").split())
            n = sum(b.values())
            for s in range(max(0, len(w) - 4) or bool(w)):
                x = bag(w[s : s + n + 4] if len(w) >= 5 else w)
                both, either = sum((x & b).values()), sum((x | b).values())
                if b and 100 * both >= 75 * either:
                    want[i, k] = max(want.get((i, k), 0), round(both / either, 6))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked_items(df, bench, broadcast_rows=limit).collect()} == want
    assert len(want) > 12
    assert decontaminate.leaked_items(empty, bench).count() == 0 and decontaminate.leaked_items(df, bench.limit(0)).count() == 0


def test_leaked_items_of_a_long_item_that_repeats_shingles(spark):
    """2000 words of which some come again, held by several documents: every window begins at one of its shingles."""
    rng = random.Random(9)
    item = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(1500)]
    item += item[100:400] + ["again and again so"] * 50
    item = " ".join(item)
    other = " ".join(w if i % 40 else f"other{i}" for i, w in enumerate(item.split()))
    docs = spark.createDataFrame([(1, "before it " + item + " after it"), (2, item), (3, item.upper()), (4, other), (5, "nothing of it")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["similarity"], r["start"]) for r in decontaminate.leaked_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k] for k in (1, 2, 3)] == [(1.0, 2), (1.0, 0), (1.0, 0)] and 0.75 <= got[4][0] < 0.9
    assert time.time() - began < 60


def test_numbered_bags_are_sets(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(5) for _ in range(n)],) for n in (0, 1, 2, 5, 30, 30)]
    table = spark.createDataFrame(rows, "bag array<long>")
    sets = [r[0] for r in table.select(decontaminate.numbered(F.col("bag"))).collect()]
    assert all(len(s) == len(set(s)) == len(b) for s, (b,) in zip(sets, rows, strict=True))
    for s, (a,) in zip(sets, rows, strict=True):
        for t, (b,) in zip(sets, rows, strict=True):
            assert len(set(s) & set(t)) == sum((Counter(a) & Counter(b)).values())


def test_leaked_items_with_repeated_and_null_ids_and_repeated_shingles(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"b{rng.randrange(900)}" for _ in range(n))
    texts = [words(40) for _ in range(4)]
    items = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2]), (2, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(k, "d e f " + t + " g h") for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], str(r["item_id"]), r["similarity"], r["start"], r["n_windows"] > 0) for r in decontaminate.leaked_items(df, bench).collect())
    assert got == [(0, "1", 1.0, 3, True), (1, "None", 1.0, 3, True), (2, "None", 1.0, 3, True), (3, "2", 1.0, 3, True), (3, "3", 1.0, 3, True)]
    # a seventh of the shingles is one repeated shingle that the other text does not have
    pairs = [words(210) for _ in range(20)]
    bench = spark.createDataFrame([(k, t + " x" * 33) for k, t in enumerate(pairs)], "item_id long, text string")
    df = spark.createDataFrame([(k, t + " y" * 33) for k, t in enumerate(pairs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaked_items(df, bench).collect()}
    assert got == {(k, k): round(206 / 272, 6) for k in range(20)}


def test_encoder_equals_the_tokenizer():
    encode, rng = tokens.Encoder(*tokens.public_vocabulary()), random.Random(2)
    parts = [" ", "  ", "\n", "a", "the", "é", "don't", " \n", "<|endoftext|>", "12", "!?", "\t", "漢字", "\x1c", " ", "'ll", "­", "\r"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_length_histogram(docs, empty):
    lengths = tokens.encoded_lengths(docs, tokens.public_vocabulary()).toPandas()["n_tokens"]
    rows = tokens.length_histogram(tokens.encoded_lengths(docs, tokens.public_vocabulary()), span=16).collect()
    assert {r["context_limit"] for r in rows} == set(lengths)
    for r in rows:
        n = r["context_limit"]
        assert (r["n_docs"], r["docs_at_most"], r["docs_at_least"], r["truncated_docs"]) == ((lengths == n).sum(), (lengths <= n).sum(), (lengths >= n).sum(), (lengths > n).sum())
        assert (r["tokens_at_least"], r["truncated_tokens"], r["total_tokens"]) == (lengths[lengths >= n].sum(), lengths.clip(upper=n).sum(), lengths.sum())
    assert tokens.length_histogram(tokens.encoded_lengths(empty, tokens.public_vocabulary())).count() == 0


def test_base_statistics_and_outliers(spark, docs, empty):
    import re

    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        text, g = r["text"] or "", got[r["doc_id"]]
        w = split(text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 400))), "en", "s", 0) for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{i}x{k}" + "#$%" for k in range(100)), "en", "s", 0) for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[1000 + i] for i in range(5))
    assert quality.quality_rules(empty).count() == 0


def test_archive_round_trip(spark):
    big, html = "<p>é</p>" * 200, "<p>small</p>"
    rows = [(1, "http://a.com/", big, 0), (2, None, big, 0), (5, "http://b.com/\r\nX: y", big, 0), (3, "http://c.com", html, 0), (4, "http://c.com", html, 0), (6, "u", None, 0), (None, "v", big, 0)]
    path = Scratch(spark, "test-warc").path("archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), path)
    got = {}
    for r in warc.read_archive(spark, path).select("*", warc.record_ids(warc.field("WARC-Record-ID")).alias("id"), warc.field("WARC-Type").alias("type"), warc.record_ids(warc.field("WARC-Refers-To")).alias("to")).collect():
        got[r["id"]] = (r["type"], r["to"], bytes(r["payload"]).decode())
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        n = int(head.split(b"Content-Length: ")[1])
        assert rest[n:] == b"\r\n\r\n" and (rest[:n].endswith(bytes(r["payload"])) or r["type"] == "revisit")
    assert got == {1: ("revisit", 5, big), 2: ("revisit", 5, big), 5: ("response", None, big), 3: ("response", None, html), 4: ("response", None, html), 6: ("response", None, ""), None: ("response", None, big)}


def test_shards_are_exact_and_uniform(spark, empty):
    df = spark.range(0, 1003, 1, 7).selectExpr("id", "'x' AS shard", "1 AS same")
    for rows in (1 << 20, 20):
        got = sharding.shuffle_into_shards(df, block_rows=rows).toPandas()
        assert sorted(got["id"]) == list(range(1003))
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g))) and len(g) in (125, 126)
    draws = collections.Counter(sharding.hypergeometric(random.Random(i), 5, 7, 6) for i in range(4000))
    from math import comb

    for k in range(6):
        assert abs(draws[k] / 4000 - comb(5, k) * comb(7, 6 - k) / comb(12, 6)) < 0.03
    assert sharding.shuffle_into_shards(empty.select("doc_id")).count() == 0


def test_packing(docs, empty):
    pieces = packing.token_pieces(docs, tokens.public_vocabulary(), capacity=128)
    got = packing.pack(pieces, capacity=128, part_rows=40).toPandas()
    encode = tokens.Encoder(*tokens.public_vocabulary())
    ids = {r["doc_id"]: encode(r["text"] or "") + bytes(4) for r in docs.collect()}
    for i, g in got.sort_values("piece").groupby("doc_id"):
        assert b"".join(g["ids"]) == ids[i] and list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]] and (g["length"][1:] == 128).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 128
    assert got["sequence_id"].nunique() <= packing.lower_bound(got["length"].to_numpy(), 128) + 1
    assert packing.pack(packing.token_pieces(empty, tokens.public_vocabulary())).count() == 0
    rng = np.random.default_rng(1)
    for top in (20, 60, 100):
        lengths = rng.integers(1, top + 1, 200)
        bins, _, fill = packing.best_fit_decreasing(lengths, 100)
        assert (np.bincount(bins, lengths) == fill).all() and fill.max() <= 100 and packing.lower_bound(lengths, 100) <= len(fill)
    assert packing.lower_bound(np.array([60, 60, 60, 45, 45]), 100) == 4


def test_language_model(docs, empty):
    rows = [(r["doc_id"], split(r["text"], True) + [None]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter(w for i, t in rows if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    results = [lm.score_documents(docs, classes=50, head=h).collect() for h in (1 << 18, 100)]
    for got in results:
        for r, (i, t) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows)):
            assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held[i], len(t), sum(counts[w] > 0 for w in t), n)
            assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t)) < 1e-5
    one, two = ({r["doc_id"]: r["score"] for r in got} for got in results)
    assert all(abs(one[i] - two[i]) < 1e-5 for i in one)
    pairs = np.array([[90.0, 5, 5], [5, 80, 15], [1, 1, 98], [30, 30, 40]])
    table = 10 ** lm.train(pairs, steps=800).log10()
    assert np.allclose(table.sum(axis=1), 1) and np.abs(table - pairs / pairs.sum(axis=1, keepdims=True)).max() < 0.08
    assert lm.score_documents(empty).count() == 0


def test_url_lists(spark):
    events = [("example.com", "a", "2024-01-02", "add"), ("example.com", "a", "2024-01-05", "remove"), ("sub.example.com", "b", "2024-01-03", "add"), ("x.org", "a", "2024-01-01", "add"), ("x.org", "a", "2024-01-01", "remove"), (None, "a", "2024-01-01", "add")]
    e = spark.createDataFrame(events, "domain string, list string, at string, action string").selectExpr("domain", "list", "cast(at as timestamp) at", "action")
    pages = [(1, "http://u@Example.com:80/p", "2024-01-02"), (2, "http://example.com", "2024-01-05"), (3, "https://sub.example.com/x", "2024-01-04"), (4, "https://a.sub.example.com/x", "2024-01-09"), (5, "http://x.org", "2024-01-03"), (6, None, "2024-01-03"), (7, "http://notexample.com", "2024-01-03"), (8, "http://example.com", None)]
    c = spark.createDataFrame(pages, "page_id long, url string, f string").selectExpr("page_id", "url", "cast(f as timestamp) fetched")
    got = {r["page_id"]: (r["blocked"], r["n_active"], r["domain"], r["list"]) for r in urls.filter_captures(c, e).collect()}
    no = (False, 0, None, None)
    assert got == {1: (True, 1, "example.com", "a"), 2: no, 3: (True, 2, "sub.example.com", "b"), 4: (True, 1, "sub.example.com", "b"), 5: no, 6: no, 7: no, 8: no}
    assert urls.filter_captures(c.limit(0), e).count() == 0 and urls.filter_captures(c, e.limit(0)).where("blocked").count() == 0


def test_pipeline_stages(docs, empty, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, "no such item in any text at all today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for df in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in df.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_against_brute_force_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    item, passage, near = words(40), words(60), words(100)
    near_too = near[:99] + ["other"]
    texts = [(1, near), (2, near_too), (None, near), (5, words(30) + passage), (7, words(40) + passage), (7, words(80)), (7, passage + words(20)), (9, words(3)), (9, words(70)), (None, words(4)), (None, words(60) + passage), (11, words(20) + item), (11, words(90)), (None, item + words(15)), (None, words(50))]
    texts += [(100 + k, words(rng.randint(40, 120))) for k in range(30)]
    rows = [(i, " ".join(w), "en", "s", k) for k, (i, w) in enumerate(texts)]
    rows += [(13, rows[12][1][:200], "en", "s", 900)] * 2
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda r: (r[0] is None, r[0] or 0, str(r))

    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], DOCS)).collect()}

    def shingles(text, n=5):
        w = text.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def near_copies(rows):
        group = list(range(len(rows)))
        sets = [shingles(r[1]) for r in rows]
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = group[a], group[b]
                    group = [y if g == x else g for g in group]
        return [min((r for r, g in zip(rows, group) if g == h), key=order) for h in set(group)]

    def cut(rows):
        out, seen = [], set()
        for r in sorted(rows, key=order):
            w, own = r[1].split(), []
            gone = [False] * len(w)
            for s in range(len(w) - 49):
                own.append(tuple(w[s : s + 50]))
                if own[-1] in seen:
                    gone[s : s + 50] = [True] * 50
            seen |= set(own)
            text = " ".join(x for x, g in zip(w, gone) if not g)
            out.append((r[0], text, *r[2:4], len(text) if any(gone) else r[4]))
        return out

    def clean(rows):
        return [r for r in rows if " ".join(item) not in r[1]]

    want = [r for k, r in enumerate(rows) if verdicts[k]]
    assert 2 <= len(rows) - len(want) and any(r[0] == 9 for r in want)
    key = lambda rows: sorted((tuple(r) for r in rows), key=order)
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), expect in zip(corpus_pipeline.STAGES, (lambda rows: want, near_copies, cut, clean)):
        before, want = want, expect(want)
        got = stage(spark, got, str(tmp_path)).collect()
        assert key(got) == key(want)
        assert expect is not cut or sum(a != b for a, b in zip(key(before), key(want))) >= 3
        got = spark.createDataFrame(got, DOCS)
    encode = tokens.Encoder(*tokens.public_vocabulary())
    pieces = [(i, 0, zlib.crc32(b)) for i, b in ((r[0], encode(r[1]) + bytes(4)) for r in want)]
    ran = [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert key(ran) == key(pieces)
