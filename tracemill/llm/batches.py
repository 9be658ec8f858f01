"""Arrow batches in slices, so that a worker holds few Python objects at a time, and freed memory is given back after a partition."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS, BYTES = 512, 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = BYTES) -> None:
    """Batches to Python of about `size` bytes at most, unless the session asks for less: both sides hold a batch at once, and long texts fill the default's 64 MB."""
    now = spark.conf.get(SETTING, "67108864b").lower()
    number = int(now.rstrip("b")) if now.rstrip("b").isdigit() else None
    if number is None or number <= 0 or number > size:
        spark.conf.set(SETTING, str(size))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def relax() -> None:
    """Workers are kept between stages; what they have freed is returned to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc here
        return


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and, if size is given, about so many bytes; a row by itself is never divided."""
    for b in batches:
        step = rows if not size else max(1, min(rows, len(b) * size // max(1, b.nbytes)))
        for lo in range(0, len(b), step):
            yield b.slice(lo, step)
        del b
    relax()


def word_pieces(raw: bytes | None, fold: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists, cut between words about every `size` bytes. fold: a table of 256 bytes that has a blank for every byte between words."""
    folded, at = (raw or b"").translate(fold), 0
    while len(folded) - at > size and (cut := folded.find(b" ", at + size)) >= 0:
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()
