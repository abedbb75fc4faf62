"""Ways through whole texts in bounded memory, for operators that run in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Longer texts are split into pieces of about so many bytes, between words.
PIECE = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
            end = m.start() + 1
        yield text[at:end]
        at = end


def raw(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, none for null."""
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size numbers."""
    w = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        w = (w ^ h[k : len(h) - size + 1 + k]) * _ODD
        w ^= w >> np.uint64(29)
    return w


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Is a document in the fold that nothing is learned from: crc32 of its id as text; a null id as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
