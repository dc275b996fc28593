"""What the operators of this subpackage share: tables, scratch tables, sizes of Arrow batches."""

from __future__ import annotations

import functools
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gramlode.session import ARROW_BYTES, ARROW_ROWS, fresh_folder, small_batches  # noqa: F401
from gramlode.sources.folder import Folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts the lineage, survives lost executors."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def keep_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``keep`` as a table of buckets by ``key``, one for each shuffle partition: a join on the key does not move its rows."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    name = "gramlode_" + folder.rsplit("-", 1)[-1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", folder).saveAsTable(name)
    out = spark.table(name)
    _FOLDERS[out] = folder
    _TABLES[out] = name
    return out


_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(kept: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``keep`` returned, once nothing reads it any more."""
    if kept in _TABLES:
        kept.sparkSession.sql(f"DROP TABLE {_TABLES.pop(kept)}")
    Folder(kept.sparkSession, _FOLDERS.pop(kept)).remove("")


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str):
    """The tiktoken encoding of a rank file, loaded once in each worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_sizes(path: str) -> np.ndarray:
    """The bytes of each id of a rank file, loaded once in each worker."""
    ranks = _ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    return sizes


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file; each worker has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)
