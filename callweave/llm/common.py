"""Helpers shared by the training-data operators: reading, checkpoints, text and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts count it: blank and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without one (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='callweave-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return folder.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared checkpoint folder and read from there."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/callweave-{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made within are removed at the end: for results that are written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, *_SCOPES.pop())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), as compressed Parquet: smaller for wide or long-lived rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- vectorised word hashing

_MULT = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; B is odd, so it has an inverse."""
    inverse = pow(_MULT, -1, 1 << 64)
    up, down = np.full(n, _MULT, np.uint64), np.full(n, inverse, np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(size)
    return _CACHE[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Bytes that separate words, and those that are left out of words (ASCII punctuation).
SEPARATES = np.zeros(256, bool)
SEPARATES[[ord(c) for c in SPACES]] = True
SEPARATES[0] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def text_blocks(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of whole texts of about `limit` characters, to bound the arrays of one step."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def hashed_words(texts: list[str], drop_punctuation: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of some texts, with the number of words of each text.

    Words are runs of non-space bytes; ASCII punctuation inside and around them does not count when it is
    dropped, and words of punctuation only vanish then. For each length in `prefixes` a further array holds the
    hash of the word's first bytes.
    """
    blob = "\0".join(texts).encode("utf-8", "surrogatepass") + b"\0"
    raw = np.frombuffer(blob, np.uint8)
    ends_of_texts = np.flatnonzero(raw == 0)
    if len(ends_of_texts) != len(texts):  # a text holds NUL itself: it separates words as a blank does
        return hashed_words([t.replace("\0", " ") for t in texts], drop_punctuation, prefixes)
    kept = raw[~PUNCTUATION[raw]] if drop_punctuation else raw
    text_end = np.flatnonzero(kept == 0)
    blank = SEPARATES[kept]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(kept) and not blank[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(kept))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((kept.astype(np.uint64) + np.uint64(1)) * up[: len(kept)], dtype=np.uint64)))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_end))))
    out = [mix((sums[ends] - sums[starts]) * down[starts])]
    out += [mix((sums[np.minimum(ends, starts + n)] - sums[starts]) * down[starts] + np.uint64(n)) for n in prefixes]
    return (counts, *out)
