"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.session import ensure_checkpoint_dir

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()`` uses the same.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

def keep(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """A written table in the shared folder: lost executors cost no more than the stage that wrote it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete a table that ``keep`` wrote, once nothing reads it any more."""
    jvm, files = table.sparkSession._jvm, table.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def signature_rows(signatures: DataFrame, *more: str) -> DataFrame:
    """``lineage`` and ``genes`` (null: empty) with the named columns; all others are left behind, so no name can clash."""
    return signatures.select("lineage", F.coalesce(F.col("genes"), F.lit("")).alias("genes"), *more)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: what a task makes of a batch may be many times its size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fraction(parts: Sequence[Column | str], digits: int = 13) -> Column:
    """A reproducible number in (0, 1] from the md5 of the parts joined by ``:``; ``digits`` hexadecimal digits of it."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    whole = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
    return (whole + 1) / F.lit(float(16 ** digits))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), _powers(base, 2), _powers(base, 2)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTE_POWERS = _Powers(0x100000001B3)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of ``(byte + 1) * base**i``: with them, ``span_hash`` gives the hash of any span in constant time."""
    up, _ = _BYTE_POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``; equal spans have equal hashes wherever they stand."""
    _, down = _BYTE_POWERS.get(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """``span_hash`` of every span of ``n`` bytes, in order."""
    _, down = _BYTE_POWERS.get(len(sums))
    if len(sums) <= n:
        return np.zeros(0, dtype=np.uint64)
    return mix64((sums[n:] - sums[:-n]) * down[:len(sums) - n] + np.uint64(n * int(_ODD) % (1 << 64)))


def word_bounds(text: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where words start and end; ``gap`` marks the 256 byte values between words."""
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~gap[data]
    edge = np.diff(inside)
    return data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, gap: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of an already lower-cased text."""
    data, start, end = word_bounds(text, gap)
    return span_hash(prefix_sums(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)


def sliding_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * _ODD + words[i:i + len(out)])
    return out


def gaps(word: str) -> np.ndarray:
    """Which of the 256 byte values stand between words: white space, or all ASCII but letters and digits."""
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    if word == "alnum":
        table[:128] = [not (48 <= b <= 57 or 97 <= b <= 122) for b in range(128)]
    return table
