"""Operator 9, token counts: a byte-level BPE tokenizer compiled to finite-state transducers.

``count_tokens`` gives every text's number of tokens without building the tokens:
the pre-token automaton runs over chunks whose state maps are composed by a
parallel prefix scan, and the BPE transducer adds up the counts on its transitions
(see ``bpe``).  Rows are independent: no shuffle, memory bounded by one batch.

Null texts count as empty (0 bytes, 0 tokens); null or repeated ids and extra
columns pass without effect, one output row for each input row; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Counter, Encoder
from .vectext import slices, string_parts


def tokenizer_path(name: str) -> str:
    """A vocabulary file by its path, or by its name in the installed collection."""
    import os

    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(tokenizer_path(name))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer_path(name))


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                _, offsets = string_parts(part.column("text"))
                n = tokens(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = slim.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_column)
