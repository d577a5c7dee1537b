"""Public tokenizers by path, loaded once a worker."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Where the vocabulary files are unless a caller says otherwise.
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of byte-level vocabularies; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def find(path: str) -> str:
    """``path``, or the file of that name in the installed tokenizer package."""
    if os.path.exists(path):
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    if spec and spec.origin:
        other = os.path.join(os.path.dirname(spec.origin), os.path.basename(path))
        if os.path.exists(other):
            return other
    raise FileNotFoundError(path)


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT):
    """A byte-level encoder from a file of ranks."""
    import tiktoken

    with open(find(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, keep: list[str], path: str = DEFAULT) -> DataFrame:
    """``keep`` columns and ``n_tokens`` BIGINT of each row's ``text``; null and empty texts have 0.

    Texts cross to Python once and only counts come back.
    """
    schema = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            # one text at a time is decoded, so that long ones never pile up
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return spread(texts.select(*keep, F.col("text"))).mapInArrow(scan, schema)
