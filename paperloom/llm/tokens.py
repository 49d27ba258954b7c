"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Ranks of a byte-level vocabulary for many languages. The default of a parameter; only
#: the driver reads the file, executors get its bytes (below 1 MB) with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(key, text, ...) with ``tokens`` for ``text``; null and empty texts have 0."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", tokens long"
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(content.value)
        for rb in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in rb.column(rb.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64())], [*keep, "tokens"])

    rows = spread(docs).mapInArrow(run, schema).where(F.col(key).isNotNull())
    # a document delivered twice has one size
    return rows.groupBy(key).agg(*[F.min(c).alias(c) for c in [*keep, "tokens"] if c != key])
