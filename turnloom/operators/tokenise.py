"""Corpus tokenisation, token lengths and truncation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.slices import sliced, text_bytes
from turnloom.functions.tokens import truncate, whitespace_tokens

TokenizerFactory = Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]

# Fixed value: the sequence length when nothing else is asked for.
MAX_SEQ_LENGTH = 2048


def tokenise(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    tokenizer: TokenizerFactory | None = None,
    batch_size: int = 256,
) -> DataFrame:
    """``key..., tokens``. Whitespace tokens, or the ids of a user's batch tokenizer.

    A tokenizer is a factory, called once per task, that returns a function from a
    list of texts to a list of id lists or NumPy arrays.
    """
    if tokenizer is None:
        return df.select(*key, whitespace_tokens(F.col(text)).alias("tokens"))

    rows = df.select(*key, F.col(text).alias("__text"))
    carried = rows.drop("__text")
    names = carried.columns
    tokens = T.StructField("tokens", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            # Only the texts and tokens of a slice are Python objects at a time.
            for some in sliced(batch, text_bytes(batch["__text"]), batch_size):
                texts = some["__text"].to_pylist()
                ids: list[Sequence[int]] = []
                for at in range(0, len(texts), batch_size):
                    asked = texts[at : at + batch_size]
                    found = list(encode(asked))
                    if len(found) != len(asked):
                        raise ValueError(f"{len(asked)} texts gave {len(found)} token lists")
                    ids += found
                out = {name: some[name] for name in names}
                out["tokens"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, T.StructType([*carried.schema.fields, tokens]))


def truncate_tokens(df: DataFrame, max_length: int = MAX_SEQ_LENGTH) -> DataFrame:
    """Add the full ``n_tokens`` and cut ``tokens`` to ``max_length``."""
    return df.withColumns(
        {
            "n_tokens": F.size("tokens").cast("long"),
            "tokens": truncate(F.col("tokens"), max_length),
        }
    )


def length_statistics(df: DataFrame, max_length: int = MAX_SEQ_LENGTH) -> DataFrame:
    """One row: sequences, their token counts, and what truncation cuts off."""
    n = F.size("tokens").cast("long")
    return df.agg(
        F.count("*").alias("n_sequences"),
        F.sum(n).alias("n_tokens"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
        F.count_if(n > max_length).alias("n_truncated"),
        F.sum(F.least(n, F.lit(max_length))).alias("kept_tokens"),
    )
