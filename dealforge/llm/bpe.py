"""Byte-level BPE encoding and decoding over Arrow batches.

``encode`` adds packed ids (little-endian unsigned 32-bit integers), ``decode`` turns packed ids
back into bytes, ``offsets`` gives each token's byte and character span.

Whole texts go through the tiktoken library with the ranks and the split pattern of the vocabulary,
without special tokens: their strings in a text are ordinary text. A worker remembers nothing but
the vocabulary. The library's pattern overflows on millions of blanks in a row, so what the pattern
makes one piece of them by rule is given to it as one piece.

Cases: a null text counts as empty and has no ids; an empty table gives an empty result; a text is
encoded whole whatever its length; repeated rows stay; a column that has the name
of a new one is replaced; decoding null gives empty bytes; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, map_batches, texts

#: Texts that a worker turns into ids and back at once.
ROWS = 200
#: Runs of so many blanks, Unicode's White_Space spelled out, are split off by hand.
LONG = 10_000
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Coder:
    """A vocabulary: ``path`` holds a token in base64 and its rank on each line."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table: list[bytes | None] = [None] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.table[i] = token
        self.lengths = np.array([len(t or b"") for t in self.table], dtype=np.int64)
        del ranks
        give_back()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return [np.array(self._ids(t), dtype="<u4").tobytes() for t in batch]

    def _ids(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in BLANKS.finditer(text) if len(text) >= LONG else ():
            end = run.end() - (run.end() < len(text))  # the last blank belongs to what follows
            ids += self.lib.encode_ordinary(text[at : run.start()])
            ids += self.lib._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.lib.encode_ordinary(text[at:]) if at else self.lib.encode_ordinary(text)

    def decode(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for; a character may be split between tokens."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def spans(self, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte start, byte end, character start and character end of each token.

        A token that holds a part of a character spans that whole character.
        """
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        raw = np.frombuffer(self.decode(packed), np.uint8)
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        first = begun[np.minimum(start + 1, len(raw))] - 1
        return start, end, first, begun[end]


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None, keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """Add ``ids_col`` (binary: packed ids) and ``n_tokens``; ``keep`` limits the columns carried on.

    ``decoded_col`` asks for the bytes that the ids decode to, made by the same worker.
    """
    path = vocabulary or default_vocabulary()
    new = [(ids_col, "binary"), ("n_tokens", "bigint")] + ([(decoded_col, "binary")] if decoded_col else [])

    def make(b):
        packed = coder(path).encode(texts(b, text_col))
        out = {ids_col: pa.array(packed, pa.binary()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}
        if decoded_col:
            out[decoded_col] = pa.array([coder(path).decode(p) for p in packed], pa.binary())
        return out

    return map_batches(df, make, new, keep, ROWS)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``out_col``: the bytes that the packed ids of ``ids_col`` stand for."""
    path = vocabulary or default_vocabulary()

    def make(b):
        return {out_col: pa.array([coder(path).decode(p or b"") for p in b.column(ids_col).to_pylist()], pa.binary())}

    return map_batches(df, make, [(out_col, "binary")], keep, ROWS)


def offsets(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add ``token_spans``: for each token its byte start and end, then its character start and end."""
    path = vocabulary or default_vocabulary()

    def make(b):
        rows = []
        for p in b.column(ids_col).to_pylist():
            rows.append([[int(x) for x in t] for t in zip(*coder(path).spans(p or b""), strict=True)])
        return {"token_spans": pa.array(rows, pa.list_(pa.list_(pa.int64())))}

    return map_batches(df, make, [("token_spans", "array<array<bigint>>")])
