"""What the operators share: words of a text, shared folders, task-side helpers."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urna.session import discard, shared_folder, ship, stage, tidy

__all__ = [
    "as_bytes", "components", "crc_mod", "discard", "file_system", "kept", "let_go", "mix", "new_folder", "only", "read", "reading", "ship", "split_words", "stage", "tidy", "words",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name nobody has used yet, in the folder all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reading(df: DataFrame, *stages: DataFrame) -> DataFrame:
    """``df``, which names the written tables it reads: who has written it may discard them."""
    df.stages = stages
    return df


def file_system(uri: str):
    """A file system and path for an address in shared storage; s3a is s3 here."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri) if ":" in uri else f"file://{uri}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table brings."""
    return df.select(*[F.col(n) for n in names])


def crc_mod(column: str, modulus: int):
    """Remainder of the CRC-32 of a number written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null has none. Lone surrogates cannot reach here from Spark strings."""
    return text.encode("utf-8") if isinstance(text, str) else b""


#: What a worker process keeps for its next tasks: of one operator at a time, as workers outlive the operators that filled them.
_KEPT: dict = {}


def kept(key, make):
    """What ``make`` makes, built once a worker process."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what earlier operators' tasks have kept in this worker process, and buffers that Arrow holds for later."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


def words(text) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: what ``bytes.split`` yields."""
    return as_bytes(text).split()


def split_words(text) -> list[bytes]:
    """The same words with A-Z, and nothing else, in lower case."""
    return as_bytes(text).lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    return label
