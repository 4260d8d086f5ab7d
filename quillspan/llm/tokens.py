"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary; a parameter everywhere, never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before the merges of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """df with the column text replaced by n_tokens, its size in tokens; rows with a null text are left out.

    A column n_tokens that df has is replaced; all others stay. An empty text has 0 tokens. Special tokens' strings count as ordinary text. No shuffle.
    """
    others = [c for c in df.columns if c not in (text, "n_tokens")]
    fields = [f"`{c}` {t}" for c, t in df.dtypes if c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            sizes = [len(e.encode_ordinary(t)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(sizes, pa.int64())], names=[*others, "n_tokens"])

    return df.where(F.col(text).isNotNull()).select(*others, text).mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))
