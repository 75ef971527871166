"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from .tables import slices

#: Rank file of a byte-level BPE and the folder it lies in; both are parameters.
VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDER = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
# fixed value: the pre-tokenisation pattern of that public vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; null and empty texts have none.  Unpaired surrogates
    count as replacement signs."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens) and the columns `keep` of each row of `documents`."""
    path = path or os.path.join(FOLDER, VOCABULARY)
    columns = documents.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text_"))
    kept = columns.drop("text_")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            sizes = pa.array(count_tokens(batch.column(batch.num_columns - 1).to_pylist(), path), pa.int64())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*names, "n_tokens"])

    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType())])
    return columns.mapInArrow(compute, schema)
