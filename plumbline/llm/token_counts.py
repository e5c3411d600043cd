"""Token counts through an exact length histogram."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table, written

#: Lengths of one block of the histogram: its suffix sums are taken block by block, then inside each block.
BLOCK = 512
_encodings: dict = {}


def encoding(path: str, pattern: str | None = None):
    """The byte BPE in a .tiktoken file, once in each Python worker."""
    if path not in _encodings:
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_lengths(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The columns `keep` and n_tokens: ids of the whole text, specials read as ordinary text; 0 for a null text."""

    def lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for frame in batches(frames, "text"):
            yield frame[list(keep)].assign(n_tokens=[len(encode(t)) if t else 0 for t in frame["text"]])

    kinds = dict(docs.select(*keep).dtypes)
    return docs.select(*keep, "text").mapInPandas(lengths, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long"]))


def length_histogram(lengths: DataFrame, by: str) -> DataFrame:
    """(by, n_tokens, n_docs) with sums over each group's distinct lengths, the exact answer for every context limit L:

    - docs_ge, tokens_ge: documents of at least this length and their tokens (suffix sums);
    - truncated_tokens: the sum of min(length, n_tokens) over the group's documents, its total under the limit n_tokens;
    - docs_le: documents of at most this length; the q-quantile is the first length whose docs_le >= q * docs;
    - docs, tokens: the group's totals.

    Between two lengths a < L < b that follow each other, docs_ge is that of b and the truncated total grows by
    docs_ge(b) for each token from a on, so `at_limit` answers any L. A null group is a group; other columns are not
    read; an empty table gives an empty one. Rows are as many as
    distinct lengths; no window holds more than BLOCK of them, or a group's blocks: a task never gets a whole group.
    """
    counts = lengths.groupBy(by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("__b", F.floor(F.col("n_tokens") / BLOCK))
    counts = written(counts, "histogram")
    blocks = counts.groupBy(by, "__b").agg(F.sum("n_docs").alias("__d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("__t"))
    after = Window.partitionBy(by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    sums = blocks.select(
        F.col(by).alias("__by"), F.col("__b").alias("__c"),
        F.coalesce(F.sum("__d").over(after), F.lit(0)).alias("__d"), F.coalesce(F.sum("__t").over(after), F.lit(0)).alias("__t"),
        F.sum("__d").over(whole).alias("docs"), F.sum("__t").over(whole).alias("tokens"),
    )
    here = Window.partitionBy(by, "__b").orderBy(F.desc("n_tokens"))
    joined = counts.join(sums, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__c")))
    ge, tokens_ge = F.sum("n_docs").over(here) + F.col("__d"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(here) + F.col("__t")
    return joined.select(
        by, "n_tokens", "n_docs", ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        (F.col("tokens") - tokens_ge + F.col("n_tokens") * ge).alias("truncated_tokens"),
        (F.col("docs") - ge + F.col("n_docs")).alias("docs_le"), "docs", "tokens",
    )


def at_limit(histogram: DataFrame, by: str, limit: int) -> DataFrame:
    """By group: docs, tokens, docs_over (longer than limit), truncated_tokens (total if each is cut at limit)."""
    short = F.col("n_tokens") <= limit
    kept = F.sum(F.when(short, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * limit))
    return histogram.groupBy(by).agg(F.first("docs").alias("docs"), F.first("tokens").alias("tokens"), F.sum(F.when(short, 0).otherwise(F.col("n_docs"))).alias("docs_over"), kept.alias("truncated_tokens"))


def quantile(histogram: DataFrame, by: str, q: float) -> DataFrame:
    """By group: the smallest length that at least q of the documents don't exceed."""
    return histogram.where(F.col("docs_le") >= F.lit(q) * F.col("docs")).groupBy(by).agg(F.min("n_tokens").alias("length"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents by source, a null one too; null and empty texts have length 0."""
    docs = table(spark, sf_dir, "documents")
    return length_histogram(encoded_lengths(docs, tokenizer_path("byte_bpe_50k.tiktoken"), "source"), "source")
