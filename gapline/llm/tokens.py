"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files, if the caller names none.
TOKENIZERS = os.environ.get("GAPLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(folder: str):
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the number of tokens of each whole text: 0 for null and empty ones.

    Texts of any length are encoded whole; special-token strings are ordinary text.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(folder).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if isinstance(t, str) and t else 0).astype("int64")

    return df.withColumn(out, F.pandas_udf(count, "bigint")(F.col(text)))
