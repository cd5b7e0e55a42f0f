"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies on every machine; never copied into this repository.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the byte-level vocabularies (public, fixed).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """``count`` for any kind of file; ``lengths`` (bytes of each token) for byte-level vocabularies."""

    def __init__(self, path: str):
        self.widths = None
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.widths = np.zeros(max(ranks.values()) + 1, np.int32)
            for token, rank in ranks.items():
                self.widths[rank] = len(token)
            encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = encoding.encode_ordinary
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer as Json

            model = Json.from_file(path)
            model.encode_special_tokens = True
            self._encode = lambda text: model.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self._encode(text))

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of each token of ``text``, in order."""
        if self.widths is None:
            raise ValueError("token offsets need a byte-level vocabulary (.tiktoken)")
        return self.widths[np.array(self._encode(text), np.int64)]


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_TOKENIZER) -> Tokenizer:
    """One per worker process."""
    return Tokenizer(path)


def token_count(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Tokens of each text; null has none."""

    def counts(s: pd.Series) -> pd.Series:
        tok = load(path)
        return s.map(lambda x: 0 if x is None else tok.count(x)).astype("int64")

    return F.pandas_udf(counts, T.LongType())(text)
