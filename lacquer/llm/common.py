"""What the operators of this subpackage share: table access, staging, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, stage  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
#: bytes.split() without arguments splits at exactly these six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with as many leading underscores as none of the columns has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return [prefix + n for n in names]


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows; sizes partitions and groups, never results."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def groups_for(n_bytes: int, per_group: int, least: int = 12) -> int:
    return max(least, -(-n_bytes // per_group))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    col = batch.column(column)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects of few texts live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of width words: a polynomial in an odd base modulo 2**64, then mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    odd = np.uint64(base)
    for k in range(1, width):
        out *= odd
        out += hashes[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class BitFilter:
    """A set of 64-bit hashes in a bounded number of bits, two for each: tells all that it holds, and few that it does not."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, hashes: DataFrame, column: str, n: int, most_bits: int) -> BitFilter:
        """Of n hashes in a column, with 64 bits for each up to 2 ** most_bits, 26 at most; only words with bits reach the driver."""
        bits = min(most_bits, 26, max(13, (64 * n).bit_length()))
        low = F.lit((1 << bits) - 1)
        places = F.array(F.shiftrightunsigned(F.col(column), 64 - bits), F.shiftrightunsigned(F.col(column), 64 - 2 * bits).bitwiseAND(low))
        found = hashes.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).toArrow()
        words = np.zeros(1 << bits - 6, np.int64)
        words[found.column("word").to_numpy()] = found.column("v").to_numpy()
        return cls(bits, words.view(np.uint64))

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        h, low = hashes.view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = np.ones(len(h), bool)
        for at in (h >> np.uint64(64 - self.bits), (h >> np.uint64(64 - 2 * self.bits)) & low):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def training_row(id_column) -> object:
    """crc32 of the id as text, modulo 3, is not 1: the rows that models may learn from. A null id may not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(id_column) -> object:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
