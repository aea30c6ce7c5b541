"""Token counts by a map-side two-tier lookup (operator 3).

A compact table of the most frequent pre-tokens and their lengths is broadcast; its size is bounded by
`table_rows` rows of at most `tokens.LONGEST` characters. What it misses is encoded once per worker and kept in
a bounded cache. No pre-token is shuffled. Which pre-tokens are in the table is fitted on a bounded sample and
changes only the speed: every count is the library's for the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treequarry.llm import tokens
from treequarry.llm.common import heads, small_batches, with_text

TOKENIZER = "byte_bpe_50k.json"


def frequent_lengths(documents: DataFrame, tokenizer: str = TOKENIZER, table_rows: int = 20_000, sample_rows: int = 4000) -> dict[str, int]:
    """Lengths of up to `table_rows` frequent pre-tokens, from the first of about `sample_rows` documents in a few partitions.

    Each of these tasks sends its most frequent pre-tokens alone, so what the driver gets and encodes has a fixed
    bound. An empty table gives an empty dictionary.
    """
    small_batches(documents.sparkSession)
    head = heads(documents, sample_rows)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times: Counter[str] = Counter()
        for batch in head(batches):
            for text in batch["text"].dropna():
                times.update(c for line in text.split("\n") for c in line.split(" ")[1:] if len(c) <= tokens.LONGEST)
        yield pd.DataFrame([(c, n) for c, n in times.most_common(table_rows) if tokens.splits(c)], columns=["chunk", "n"])

    found = documents.select("text").mapInPandas(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    common = [r["chunk"] for r in found.orderBy(F.desc("n"), "chunk").limit(table_rows).collect()]
    encoder = tokens.PreTokens(tokenizer, len, sum)
    return encoder.learn(c for c in common if not any(s in c for s in encoder.special)) if encoder.exact else {}


def counter(documents: DataFrame, tokenizer: str = TOKENIZER, table_rows: int = 20_000) -> Column:
    """A Pandas UDF of a text: its number of tokens."""
    first = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, tokenizer, table_rows))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokens.PreTokens(tokenizer, len, sum, first.value)
        for texts in batches:
            yield pd.Series(count.many(list(texts)), dtype="int64")

    return n_tokens


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, limit: int = 1024, table_rows: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. Repeated rows each get their row, an empty table gives an
    empty result, and columns beside doc_id and text play no part.
    """
    with_text(documents)
    small_batches(documents.sparkSession)
    n_tokens = counter(documents, tokenizer, table_rows)
    counted = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
