"""Token ids of texts by a public byte-level vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.tiktoken")


@cache
def encoding(path: str):
    """The tokenizer of a vocabulary file, once a worker."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for batch in batches:
            ids = [e.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "tokens"])

    return run


def tokenized(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, tokens) of every row; null and empty texts have no token."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_ids(vocabulary or default_vocabulary()), "key long, tokens array<int>").withColumnRenamed("key", key)
