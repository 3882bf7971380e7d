"""What the training-data operators share: batch mapping and word boundaries in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import importable

#: Bytes of `[\x20\x09-\x0D]`; every UTF-8 byte of another character is outside this set.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run `fn` over Arrow batches given as columns of Python values; it returns columns."""
    arrow = to_arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, fn: Callable[[list], list]) -> DataFrame:
    """Keep the rows whose `column` value passes `fn`, with every column as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(fn(batch.column(batch.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    importable(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def to_arrow(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of a schema; called on the driver by every operator, it also readies the workers' path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(df.sparkSession)
    return to_arrow_schema(T._parse_datatype_string(schema))


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words of one text."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.concatenate(([False], ~SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for texts up to a megabyte."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        kept = np.cumprod(full, dtype=np.uint64)
        if n <= 1 << 20:
            _powers[str(base)] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one polynomial prefix sum over the text."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of `n` word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : k + m]
    return mix(total)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
