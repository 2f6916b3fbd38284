"""Token ids of whole texts with a public tokenizer, whose file is a parameter and is read once per Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywell.llm.common import per_batch
from tallywell.llm.words import as_bytes

#: Ranks of a byte-level vocabulary of 50,256 ids; the id after the last ends a document.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
# Fixed value: the pattern that cuts texts into pre-tokens for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Ids of a text. Special tokens' strings are ordinary text."""
    return np.array(encoding(path).encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)


def decode(ids: np.ndarray, path: str = TOKENIZER) -> str:
    return encoding(path).decode_bytes(ids.tolist()).decode()


def pieces_of(docs: DataFrame, longest: int, path: str = TOKENIZER, ids: bool = True) -> DataFrame:
    """Per piece of a document: doc_id, piece (from 0), start, n, and, if wanted, its ids (binary, little-endian uint16).

    A document is its ids and END_ID. What is longer than `longest` is cut every `longest` ids, so its pieces in order
    are the whole document. A null or empty text has no piece.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owners, numbers, starts, sizes, contents = [], [], [], [], []
        for i, text in enumerate(as_bytes(batch.column("text"))):
            if not text:
                continue
            own = np.append(encode(text.decode(), path), END_ID)
            for number, start in enumerate(range(0, len(own), longest)):
                owners.append(i)
                numbers.append(number)
                starts.append(start)
                sizes.append(min(longest, len(own) - start))
                if ids:
                    contents.append(own[start : start + longest].astype("<u2").tobytes())
        columns = [batch.column("doc_id").take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()),
                   pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())]
        names = ["doc_id", "piece", "start", "n"]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(contents, pa.binary())] * ids, names + ["ids"] * ids)

    return per_batch(docs.select("doc_id", "text"), work, "doc_id long, piece int, start long, n int" + ", ids binary" * ids)
