"""Token accounting and cost estimates."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat format: tokens around a message, of a name, and before the answer.
PER_MESSAGE, PER_NAME, PRIMING, DEFAULT_ANSWER = 4, -1, 2, 15

#: USD per 1,000 tokens: (prompt, completion). A parameter; these are example prices.
PRICES = {"small": (0.0005, 0.0015), "medium": (0.003, 0.015), "large": (0.01, 0.03)}


# Fixed value: where a byte-level BPE of the GPT-2 kind cuts a text before it merges.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    place = ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks))
    with open(place, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={})


def bpe_counter(ranks: str, pattern: str = WORDS) -> Callable[[Column], Column]:
    """A counter of BPE tokens, for `token_band` and `prompt_set` (not inside lambdas): Column -> bigint; null stays null.

    `ranks` is a file of base64 tokens and their ranks, at that path on every executor or sent there by SparkContext.addFile. A
    worker reads it once. Marks of special tokens in a text count as ordinary text.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks, pattern).encode_ordinary
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count


def chat_tokens(messages: Column, count, answers: int = 1, max_tokens: int = DEFAULT_ANSWER) -> Column:
    """Tokens that a chat request takes. messages: array<struct<role, content[, name]>>; count: Column -> Column."""

    def one(m: Column) -> Column:
        return F.lit(PER_MESSAGE) + count(m["role"]) + count(m["content"])

    return F.aggregate(messages, F.lit(0).cast("double"), lambda acc, m: acc + one(m).cast("double")) + F.lit(PRIMING + answers * max_tokens)


def cost_estimate(prompts: DataFrame, tokens: str, model: str, max_tokens: int = 16, prices: dict | None = None, tokens_per_minute: int = 80_000, most: float | None = None) -> DataFrame:
    """One row: totals of prompt tokens, expected completion tokens, cost, and the request rate that fits a token limit."""
    prices = prices or PRICES
    if model not in prices:
        raise ValueError(f"no price for {model}")
    a, b = prices[model]
    t = F.col(tokens).cast("double")
    sums = prompts.agg(F.count(t).alias("n"), F.sum(t).alias("total"), F.min(t).alias("least"), F.max(t).alias("most"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("spread"))
    answer = F.lit(float(max_tokens)) + F.col("mean") + 2.0 * (F.col("most") - F.col("least")) / 4.0
    cost = F.col("total") / 1000.0 * a + F.col("n") * max_tokens / 1000.0 * b
    out = sums.select(
        "n", "total", "least", "most", "mean", "spread", answer.alias("tokens_per_request"), cost.alias("worst_cost"),
        F.floor(F.lit(float(tokens_per_minute)) / answer).cast("bigint").alias("requests_per_minute"),
    )
    if most is not None:
        out = out.where(F.when(F.col("worst_cost") > most, F.raise_error(F.lit("the cost is above the limit")).cast("boolean")).otherwise(True))
    return out
