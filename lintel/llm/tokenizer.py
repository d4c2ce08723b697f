"""A public byte-level BPE vocabulary, read on the driver and sent to the tasks."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from typing import Protocol

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Where public vocabularies lie; LINTEL_TOKENIZER or a parameter names another file.
VOCABULARY = os.environ.get("LINTEL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest vocabulary file that is sent to the tasks.
MOST_BYTES = 64 << 20


class Encoder(Protocol):
    def encode_ordinary(self, text: str) -> list[int]: ...


def send(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's bytes, for encoder() in tasks; too large a file is refused."""
    with open(path or VOCABULARY, "rb") as file:
        raw = file.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str = PATTERN) -> Encoder:
    """The encoder of a vocabulary with a base64 token and its rank in each line."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
