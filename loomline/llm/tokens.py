"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter everywhere, never copied into this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits text before merging (the pattern published with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Loaded(dict):
    """Encoders of this process; arrives empty elsewhere."""

    def __reduce__(self):
        return (_Loaded, ())


_ENCODERS = _Loaded()


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file of the driver, of a few megabytes, for executors that don't have it."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(path: str, held: Broadcast[bytes] | None = None):
    """The tokenizer of a vocabulary file, loaded once a process; from ``held`` if it is given."""
    import tiktoken

    if path in _ENCODERS:
        return _ENCODERS[path]
    lines = held.value if held is not None else open(path, "rb").read()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    _ENCODERS[path] = made = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return made


def with_token_counts(df: DataFrame, text_col: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of the whole text; 0 for null and empty texts."""

    held = shipped(df.sparkSession, path)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, held).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return df.withColumn(out, count(F.col(text_col)))


def sample_texts(df: DataFrame, id_col: str, n: int, max_bytes: int, text_col: str = "text") -> list[Row]:
    """At most ``n`` rows with a text and at most ``max_bytes`` of texts together, chosen by a hash of the id: the same
    on every run. Texts that don't fit in what is left are passed over, whole. Only ids and sizes are gathered to choose."""
    from loomline.plans.lineage import bounded_sample

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = bounded_sample(rows.select(id_col, F.octet_length(text_col).alias("_size")), id_col, n).collect()
    chosen, left = [], max_bytes
    for r in sizes:
        if r._size <= left:
            chosen.append(r[id_col])
            left -= r._size
    if not chosen:
        return []
    picked = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(chosen)], f"{id_col} {dict(df.dtypes)[id_col]}")
    return rows.join(F.broadcast(picked), id_col, "left_semi").collect()
