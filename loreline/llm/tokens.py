"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level tokenizers cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a ``.tiktoken`` rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column, path: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of a text; null counts 0. Names of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        read = encoding(path, pattern).encode_ordinary
        return pd.Series(np.fromiter((len(read(t)) if t else 0 for t in texts), "int64", len(texts)))

    return count(text)


def document_sizes(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), one row per doc_id, documents without tokens left out.

    Repeated rows count once; of differing rows for one id the one with the most tokens.
    """
    sized = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", "source", token_count(F.col("text"), path).alias("tokens"))
    return sized.groupBy("doc_id").agg(F.max_by("source", "tokens").alias("source"), F.max("tokens").alias("tokens")).where("tokens > 0")
