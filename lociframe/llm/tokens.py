"""Token counts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    encode = _encoder(path)._core_bpe.encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of ``text``, without a shuffle and without the text."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(token_counts(batch.column(len(keep)).to_pylist(), path), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", n_tokens bigint"
    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(count, schema)
