"""Token ids of whole texts, and the exact histogram of encoded lengths (operator 3).

``Encoder`` gives the ids of the ``tokenizers`` file. Most chunks between single spaces occur again and
again, and a space before a visible character always starts a new pre-token, so ids are held by chunk
in a bounded cache. Chunks of plain Latin text are encoded with the same vocabulary as byte-pair ranks;
every other text (special tokens, other scripts, runs of spaces) goes whole to ``tokenizers``.

``length_histogram`` aggregates documents by encoded length. Suffix sums over the lengths answer, for
every context limit, how many documents reach it and how many tokens are left after truncation; prefix
sums give the quantiles. Lengths are summed in ranges of ``span`` first, so no window runs over all.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import Scratch

_PLAIN = re.compile("[\n!-~¡-¬®-ɏ]*")  # fixed: characters that both encoders split alike
_MOST = 400_000


class Encoder:
    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(tokenizer_path)
        self.chunk = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _missed(self, chunk: str) -> bytes:
        """KeyError if the text has to be encoded whole."""
        if not chunk or chunk[0] == "\n" or not _PLAIN.fullmatch(chunk):
            raise KeyError(chunk)
        ids = array("I", self.chunk.encode_ordinary(" " + chunk)).tobytes()
        if len(self.cache) < _MOST and len(chunk) < 64:
            self.cache[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.split(" ")
        try:
            if not _PLAIN.fullmatch(chunks[0]) or any(s in text for s in self.special):
                raise KeyError
            out = [array("I", self.chunk.encode_ordinary(chunks[0])).tobytes()]
            held, missed = self.cache.get, self._missed
            out += [held(c) or missed(c) for c in chunks[1:]]
            return b"".join(out)
        except KeyError:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, pattern)


def public_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded_lengths(docs: DataFrame, vocabulary: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: the encoded length of every whole text; null and empty texts have 0."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(*vocabulary)
        for batch in batches:
            n = [len(encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", span: int = 1024) -> DataFrame:
    """A row for each length that occurs: ``context_limit, n_docs, docs_at_most, docs_at_least, truncated_docs,
    tokens_at_least, truncated_tokens, total_docs, total_tokens, quantile``.

    With L = ``context_limit``: ``truncated_tokens`` is the sum of min(length, L), ``truncated_docs`` counts
    lengths above L, ``quantile`` is the share of documents of at most L tokens, so the q-quantile is the
    first row whose ``quantile`` is q or more. Null lengths are left out. No rows give no rows.
    """
    scratch = Scratch(lengths.sparkSession, "lengths")
    per = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("l")).agg(F.count("*").alias("n"))
    hist = scratch.table(per.select("l", "n", F.expr(f"l div {span}").alias("range")), "histogram")
    ranges = hist.groupBy("range").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("l")).alias("t"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in "nt"), *(F.sum(c).over(every.orderBy("range")).alias(f"all_{c}") for c in "nt"))
    own = Window.partitionBy("range").orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(ranges, "range").select("*", (F.sum("n").over(own) + F.col("later_n")).alias("from_n"), (F.sum(F.col("n") * F.col("l")).over(own) + F.col("later_t")).alias("from_t"))
    at_most = F.col("all_n") - F.col("from_n") + F.col("n")
    return rows.select(
        F.col("l").alias("context_limit"), F.col("n").alias("n_docs"), at_most.alias("docs_at_most"), F.col("from_n").alias("docs_at_least"),
        (F.col("from_n") - F.col("n")).alias("truncated_docs"), F.col("from_t").alias("tokens_at_least"),
        (F.col("all_t") - F.col("from_t") + F.col("l") * F.col("from_n")).alias("truncated_tokens"),
        F.col("all_n").alias("total_docs"), F.col("all_t").alias("total_tokens"), (at_most / F.col("all_n")).alias("quantile"),
    )
