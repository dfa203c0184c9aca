"""Exact token counts for every context limit, from a histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram then answer, for any limit, how many
documents reach it, the tokens they hold, and the total when every document is cut there. The histogram has a row for
each length that occurs, however many documents there are. Null text counts as empty (length 0); an empty table has
an empty histogram; repeated rows count each time. Lengths that tie share a row. Very long texts are whole, encoded in
pieces. Only the column text is read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm.bpe import DEFAULT_TOKENIZER, encoded_groups
from strideway.llm.common import text_of, written

#: Lengths are summed in blocks of this width first, so that no task sees more of the histogram than a block.
BLOCK = 4096


def document_lengths(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(n_tokens) of each document. Map only."""

    def run(batches):
        for _, _, counts in encoded_groups(batches, path):
            yield pa.RecordBatch.from_arrays([pa.array(counts)], names=["n_tokens"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)"""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, shares: list[float] | None = None) -> DataFrame:
    """(context_limit, n_docs, docs_at_least, tokens_at_least, total_tokens, truncated_tokens, share_at_most).

    A row for each length that occurs, taken as a context limit: documents of exactly that length, those at least as
    long with their tokens, the total of all tokens, the total if documents are cut at the limit, and the share of
    documents that fit. With ``shares`` also ``quantiles``: those of them whose quantile this length is, the least one
    that so large a share of documents doesn't exceed.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(whole).alias("total_docs"),
        F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    docs = F.sum("n_docs").over(own) + F.col("later_docs")
    held = F.sum(tokens).over(own) + F.col("later_tokens")
    fit = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    rank = lambda q: F.greatest(F.ceil(q * F.col("total_docs")), F.lit(1))
    at = F.filter(F.array(*map(F.lit, shares)), lambda q: (fit >= rank(q)) & (fit - F.col("n_docs") < rank(q))) if shares else None
    return (
        rows.join(blocks, "block")
        .select("n_tokens", "n_docs", docs.alias("docs_at_least"), held.alias("tokens_at_least"), "total_docs", "total_tokens")
        .select(
            F.col("n_tokens").alias("context_limit"), "n_docs", "docs_at_least", "tokens_at_least", "total_tokens",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
            (fit / F.col("total_docs")).alias("share_at_most"), *([at.alias("quantiles")] if shares else []),
        )
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens) for any limits, from :func:`length_histogram`."""
    rows = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
    over = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    return rows.groupBy("context_limit").agg(F.sum(over).alias("docs_over"), F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"))


def token_counts(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """:func:`suffix_sums` of all documents. The histogram is written once, as it is read twice: each text is encoded once."""
    return suffix_sums(written(length_histogram(document_lengths(docs, path)), "lengths"))


#: Context limits that a report has besides all lengths that occur, and the shares whose quantiles it marks.
LIMITS = [2**k for k in range(7, 21)]
SHARES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def token_report(docs: DataFrame, path: str = DEFAULT_TOKENIZER, limits: list[int] = LIMITS, shares: list[float] = SHARES) -> DataFrame:
    """:func:`suffix_sums` for all lengths that occur and for ``limits``, which no document need have, with quantiles.

    A limit is a row of the histogram without documents, so the same sums answer for it. An empty table has no rows.
    """
    histogram = written(length_histogram(document_lengths(docs, path)), "lengths")
    asked = docs.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    some = histogram.limit(1).select(F.lit(True).alias("some"))
    rows = histogram.union(asked.join(F.broadcast(some)).drop("some"))
    return suffix_sums(rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), shares)
