"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel works on at once.
CHUNK_BYTES = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_split(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of anything but space and 0x09-0x0D."""
    return text.lower().split() if text else []


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` units; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """All elements in order, and where each list ends."""
    out: list = []
    for x in lists:
        out += x
    return out, np.cumsum([len(x) for x in lists], dtype=np.int64)


def segment_sum(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` that end at ``ends``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else total[:0]
