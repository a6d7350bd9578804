"""What the operators of this subpackage share: materialising, word scanning, sizes."""

from __future__ import annotations

import atexit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.parallel import spread
from quern.plans.scratch import fresh, remove

#: ASCII white space that separates words: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


_STORED: dict[str, SparkSession] = {}


def store(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, deleted by `drop` or else as Python exits."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    _STORED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_quern_path", path)
    return out


def drop(*stored: DataFrame) -> None:
    """Deletes tables made by `store` that no later plan reads; others are left alone."""
    for df in stored:
        if path := getattr(df, "_quern_path", None):
            _delete(path)


def settled(make, name: str = "t") -> DataFrame:
    """Stores what make() returns and drops the tables stored on its way (by this process: not for calls in parallel)."""
    before = set(_STORED)
    out = store(make(), name)
    for path in set(_STORED) - before - {out._quern_path}:
        _delete(path)
    return out


def _delete(path: str) -> None:
    try:
        spark = _STORED.pop(path, None)
        if spark is not None:
            remove(spark, path)
    except Exception:  # the session has ended; the owner of the shared folder clears it
        pass


@atexit.register
def _clear() -> None:
    for path in list(_STORED):
        _delete(path)


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name).rstrip("b")
    if not have.isdigit() or int(have) > mb << 20:
        spark.conf.set(name, str(mb << 20))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns, dealt out over the cores if it has fewer row groups than these."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns) if columns else rows)


def tucked(docs: DataFrame, **columns) -> DataFrame:
    """The rows of a table as one column `row`, and the given columns: names of the caller's can't clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


#: Stands for a null id on its way through pandas, which would turn the ids of the batch into floats.
MISSING = -(2**63)


def held_id(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(MISSING))


def real_id(name: str):
    return F.nullif(F.col(name), F.lit(MISSING))


def crc_mod(col: str, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


# --- words of whole texts, vectorised -----------------------------------------------------

_RNG = np.random.default_rng(20240607)
#: A random odd 64-bit value for each byte, 0 for white space; the multiplier is 5 modulo 8.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACES] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply, xor, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3AAACABF0E5C9A5)
    return x ^ (x >> np.uint64(32))


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_IS_SPACE = SPACES.astype(np.uint8).tobytes()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the multiplier and of its inverse, kept for the next call."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + n // 8, base)]), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a list of texts: `start`, `end` (bytes of `buf`), `hash`, and each text's `count` and `first` word.

    A-Z are lower-cased unless told otherwise; words are runs of bytes other than space and 0x09-0x0D; None is an empty text. A
    hash is a polynomial of the word's bytes modulo 2**64, mixed with its length.
    """

    def __init__(self, texts: list[str | None], lower: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = b" ".join([*raw, b""])
        whole = whole.lower() if lower else whole
        self.buf = buf = np.frombuffer(whole, np.uint8)
        space = np.frombuffer(whole.translate(_IS_SPACE), np.bool_)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        begins = np.concatenate([[0], np.cumsum(self.bytes + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.count = np.diff(self.first)
        up, down = _powers(len(buf))
        total = np.cumsum(np.take(_BYTE, buf) * up[: len(buf)], dtype=np.uint64)
        before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
        self.hash = mix64((total[self.end - 1] - before) * down[self.start] + (self.end - self.start).astype(np.uint64))


def pieces(texts, most: int = 1 << 20):
    """(from, to) runs of texts of about `most` characters; one longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
