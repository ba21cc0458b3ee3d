"""Counting and cutting in tokens of a public byte-level BPE tokenizer. The vocabulary file is a
parameter and is read on each worker; nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary of ranks, one "base64 rank" per line.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's tokenizer parts a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_column(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text; NULL and '' have none."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def with_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    return df.withColumn(out, count_column(F.col(text).cast("string"), vocabulary))
