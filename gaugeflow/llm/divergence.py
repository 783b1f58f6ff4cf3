"""How the words of each source differ from those of the others of its language (operator 11).

Sort-based streaming. Postings (lang, term, source, document) are repartitioned by (lang, term) and sorted within the
partitions; one scan adds up the runs, so a term's document frequency and counts by source are known when its run ends.
A map task adds up its own postings first, document by document, so a word that most documents hold arrives once per
task and source. Kept terms are then dealt by chunks of terms and blocks of sources and sorted again, behind the groups'
totals: a second scan rebuilds each term's row of shares and emits, for its run of terms, partial sums of every pair of
sources and the best terms of every source. Nothing grows in a task but a batch, a block of pairs of sources and one
term's sources.

Shares are p = 1 + floor(10**9 * (count + 5) / (N + 5 V)) in integers, exact for counts below 9 * 10**15. A null text,
lang or source is ''. Each row is a document of its own, repeated or without a doc_id alike. A lang without kept terms has
the value 0 for its pairs; a lang of one source has no pairs. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.words import binaries
from gaugeflow.session import Scratch

#: Letters lower-cased, bytes of other alphabets as they are, all else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE, PRIOR = 1_000_000_000, 5
POSTINGS = "lang string, term binary, source string, document long, docs long, count long"
RUNS = "lang string, term binary, source string, count long, lang_count long, lead long"
KEYS = ("lang", "left", "right", "chunk")


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists from pieces of about ``piece`` bytes that end between terms."""
    at = 0
    while at < len(text):
        to, cut = min(len(text), at + piece), b""
        part = text[at:to].translate(_TERMS)
        while to < len(text) and not cut.count(b" "):  # the rest of a term that goes on
            cut = text[to : to + 1024].translate(_TERMS)
            whole = cut.find(b" ") + 1 or len(cut)
            part += cut[:whole]
            to += whole
        yield part.split()
        at = to


def _postings(most: int):
    """Postings of a task's documents, added up by (lang, source, term) until there are ``most`` of them."""

    def table(found: dict) -> object:
        import pyarrow as pa

        n = [len(counts) for counts, _, _ in found.values()]
        terms = [t for counts, _, _ in found.values() for t in counts]
        docs = [docs[t] for counts, docs, _ in found.values() for t in counts]
        count = [c for counts, _, _ in found.values() for c in counts.values()]
        keys = np.repeat(np.arange(len(n)), n)
        lang, source = (pa.array([k[i] for k in found], pa.string()).take(pa.array(keys)) for i in (0, 1))
        document = pa.array([first for _, _, first in found.values()], pa.int64()).take(pa.array(keys))
        columns = [lang, pa.array(terms, pa.binary()), source, document, pa.array(docs, pa.int64()), pa.array(count, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "docs", "count"])

    def run(batches):
        found, held = {}, 0
        for batch in batches:
            texts = binaries(batch.column("text"))
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True)
            for doc_id, lang, source, text in rows:
                if (lang, source) not in found:
                    found[lang, source] = (Counter(), Counter(), doc_id)
                counts, docs, _ = found[lang, source]
                before, own = len(counts), None
                for words in terms_of(text or b""):
                    counts.update(words)
                    own = set(words) if own is None else own | set(words)
                docs.update(own or ())
                held += len(counts) - before
                if held >= most:
                    yield table(found)
                    found, held = {}, 0
        if held:
            yield table(found)

    return run


def _starts(batch, *names: str) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    import pyarrow.compute as pc

    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in names:
        column = batch.column(name)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _joined(held, batch):
    import pyarrow as pa

    parts = [p for p in (held, batch) if p is not None and p.num_rows]
    return pa.Table.from_batches([p.combine_chunks().to_batches()[0] if isinstance(p, pa.Table) else p for p in parts]).combine_chunks() if parts else None


def _kept_runs(least: int):
    """Sorted postings to ``RUNS``: the counts by source of each (lang, term) that ``least`` documents hold."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in chain(batches, [None]):
            rows = _joined(held, batch)
            if rows is None:
                continue
            at = _starts(rows, "lang", "term", "source")
            docs, count = (np.add.reduceat(rows.column(c).to_numpy(), at) for c in ("docs", "count"))
            first = rows.take(pa.array(at))
            for name, values in (("docs", docs), ("count", count)):
                first = first.set_column(first.schema.get_field_index(name), name, pa.array(values))
            first = first.combine_chunks()
            at = _starts(first, "lang", "term")
            held = first.slice(at[-1]) if batch is not None else None
            n = len(first) if batch is None else at[-1]
            at = at[at < n]
            if not len(at):
                continue
            size = np.diff(np.append(at, n))
            df, total = np.add.reduceat(docs[:n], at), np.add.reduceat(count[:n], at)
            lead = np.zeros(n, np.int64)
            lead[at] = 1
            keep = pa.array(np.repeat(df >= least, size))
            out = first.slice(0, n).select(["lang", "term", "source", "count"])
            out = out.append_column("lang_count", pa.array(np.repeat(total, size))).append_column("lead", pa.array(lead))
            yield from out.filter(keep).to_batches()

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), by long division in steps of a thousand, so nothing overflows."""
    rest, p = count + PRIOR, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        p, rest = p * 1000 + rest // total, rest % total
    return 1 + p


class _Block:
    """Sums over a chunk of terms for the pairs of a left and a right block of sources of one lang."""

    def __init__(self, key: tuple, top: int):
        self.key, self.top, self.headers, self.best, self.sums = key, top, [], [], None

    def begin(self) -> None:
        import pyarrow as pa

        rows = [r for r in self.headers if r["source"] is not None]
        self.lang_total = next(r["total"] for r in self.headers if r["source"] is None)
        self.names = [r["source"] for r in rows]
        self.index = pa.array(self.names, pa.string())
        self.total = np.array([r["total"] for r in rows], np.int64)
        side = np.array([r["side"] for r in rows], np.int64)
        self.alone = self.key[1] == self.key[2]
        self.left, self.right = np.flatnonzero(side == self.key[1]), np.flatnonzero(side == self.key[2])
        self.none = shares(np.zeros(len(rows), np.int64), self.total)
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def add(self, rows, terms_at_once: int = 1024) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.sums is None:
            self.begin()
        where = pc.index_in(rows.column("source"), value_set=self.index).to_numpy()
        p = shares(rows.column("count").to_numpy(), self.total[where])
        at = _starts(rows, "term")
        term = np.repeat(np.arange(len(at)), np.diff(np.append(at, rows.num_rows)))
        for lo in range(0, len(at), terms_at_once):
            some = slice(at[lo], at[lo + terms_at_once] if lo + terms_at_once < len(at) else rows.num_rows)
            n = term[some.stop - 1] - lo + 1
            grid = np.repeat(self.none[None, :], n, axis=0)
            grid[term[some] - lo, where[some]] = p[some]
            right = grid[:, self.right]
            for i, s in enumerate(self.left):
                self.sums[i] += np.abs(right - grid[:, s : s + 1]).sum(axis=0)
        if self.alone:
            f = p - shares(rows.column("lang_count").to_numpy(), np.int64(self.lang_total))
            some = np.flatnonzero(f > 0)
            new = pa.table({"s": where[some].astype(np.int64), "f": f[some], "term": rows.column("term").take(pa.array(some))})
            # rows arrive by term, and the sort is stable, so equal values stay in the order of their terms
            all_of = pa.concat_tables([*self.best, new]).combine_chunks()
            s, f = all_of.column("s").to_numpy(), all_of.column("f").to_numpy()
            order = np.lexsort((-f, s))
            first = np.searchsorted(s[order], s[order])
            self.best = [all_of.take(pa.array(np.sort(order[np.arange(len(order)) - first < self.top])))]

    def rows(self):
        import pyarrow as pa

        if self.sums is None:
            self.begin()
        names = ["lang", "source", "part", "item", "value"]

        def out(source, part, item, value):
            n = len(value)
            columns = [pa.array([self.key[0]] * n, pa.string()), source, pa.array([part] * n, pa.string()), item.cast(pa.binary()), pa.array(value, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for i, s in enumerate(self.left):
            others, value = self.right[self.right != s], self.sums[i][self.right != s]
            one = self.index.take(pa.array(np.repeat(s, len(others))))
            yield out(one, "pair", self.index.take(pa.array(others)), value)
            if not self.alone:
                yield out(self.index.take(pa.array(others)), "pair", one, value)
        for best in self.best:
            best = best.combine_chunks()
            yield out(self.index.take(pa.array(best.column("s").to_numpy())), "term", best.column("term").combine_chunks(), best.column("f").to_numpy())


def _partials(top: int):
    """Rows sorted by ``KEYS``, totals first and then terms, to partial sums of pairs and the ``top`` terms of each key."""

    def run(batches):
        block, held = None, None
        for batch in chain(batches, [None]):
            rows = _joined(held, batch)
            held = None
            if rows is None:
                continue
            at = np.append(_starts(rows, *KEYS), rows.num_rows)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                part = rows.slice(lo, hi - lo)
                key = tuple(part.column(c)[0].as_py() for c in KEYS)
                if block is None or block.key != key:
                    if block is not None:
                        yield from block.rows()
                    block = _Block(key, top)
                n = int((part.column("kind").to_numpy() == 0).sum())
                block.headers += part.slice(0, n).select(["source", "side", "total"]).to_pylist()
                part = part.slice(n).combine_chunks()
                if hi == rows.num_rows and batch is not None and part.num_rows:
                    last = _starts(part, "term")[-1]
                    part, held = part.slice(0, last), part.slice(last)
                if part.num_rows:
                    block.add(part.combine_chunks())
        if block is not None:
            yield from block.rows()

    return run


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, block: int = 256, chunk_rows: int = 100_000, postings: int = 400_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group of lang and source, how far each other source of the
    lang is (part ``pair``), and the ``top`` terms that it uses more than its lang does (part ``term``).

    ``least_docs`` documents of a lang must hold a term. A task holds ``block`` sources by ``block`` others, and about
    ``postings`` sums of its own documents; a chunk of terms has about ``chunk_rows`` counts. None changes the result.
    """
    scratch = Scratch(docs.sparkSession, "source-divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("text"), text("lang"), text("source"))
    found = rows.mapInArrow(_postings(postings), POSTINGS)
    found = found.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    runs = scratch.table(found.mapInArrow(_kept_runs(least_docs), RUNS), "runs")

    groups = rows.select("lang", "source").distinct()
    sums = runs.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    terms = runs.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("count").alias("n_lang"))
    groups = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = scratch.table(groups.na.fill(0, ["n", "v", "n_lang"]), "groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, chunks = -(-widest // block) or 1, -(-runs.count() // chunk_rows) or 1

    side = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("side")
    paired = [F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right")]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    prior = F.greatest(F.lit(1), PRIOR * F.col("v"))  # without any term nothing is divided by it
    nothing = [F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("lang_count")]
    heads = groups.select("lang", "source", side, (F.col("n") + prior).alias("total")).select("*", every).select("*", *paired, chunk)
    heads = heads.select(*KEYS, F.lit(0).alias("kind"), "source", "side", "total", *nothing)
    langs = groups.groupBy("lang").agg(F.first("n_lang").alias("n_lang"), F.first("v").alias("v"))
    pairs = F.explode(F.sequence(F.col("left"), F.lit(blocks - 1).cast("long"))).alias("right")
    langs = langs.select("lang", (F.col("n_lang") + prior).alias("total"), every).withColumnRenamed("other", "left").select("*", pairs).select("*", chunk)
    langs = langs.select(*KEYS, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(-1).cast("long").alias("side"), "total", *nothing)
    counts = runs.select("lang", "term", "source", "count", "lang_count", side).select("*", every)
    counts = counts.select("lang", *paired, F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), F.lit(1).alias("kind"), "source", "side", F.lit(0).cast("long").alias("total"), "term", "count", "lang_count")
    dealt = heads.unionByName(langs).unionByName(counts).repartition(*KEYS).sortWithinPartitions(*KEYS, "kind", "term")
    partial = scratch.table(dealt.mapInArrow(_partials(top), "lang string, source string, part string, item binary, value long"), "partial")
    scratch.drop("runs", "groups")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    term = partial.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    ranked = pair.withColumn("rank", F.row_number().over(best)).unionByName(term)
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
