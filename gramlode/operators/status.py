"""What is in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.operators.index import Commit, Index, current_commit
from gramlode.sources.folder import Folder


def document_count(index: Index) -> DataFrame:
    """One row: the number of live documents."""
    return index.docs().agg(F.count("*").alias("file_count"))


def build_totals(index: Index) -> DataFrame:
    """Files per root."""
    return index.files().groupBy("root").agg(F.count("*").alias("n_files"))


def build_report(index: Index, corpus) -> DataFrame:
    """Per root: listed, indexed, too_large, and other, which are binary or vanished before they were read."""
    listing = corpus.listing()
    fit = corpus.indexable(listing).groupBy("root").agg(F.count("*").alias("fit"))
    listed = listing.groupBy("root").agg(F.count("*").alias("listed"))
    joined = listed.join(fit, "root", "left").join(build_totals(index), "root", "left").na.fill(0, ["fit", "n_files"])
    return joined.select(
        "root", "listed", F.col("n_files").alias("indexed"), (F.col("listed") - F.col("fit")).alias("too_large"),
        (F.col("fit") - F.col("n_files")).alias("other"),
    )


def index_size(spark: SparkSession, path: str) -> int:
    """Bytes below the index folder."""
    return Folder(spark, path).size()


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: built, index_dir, file_count, size_bytes, last_build, last_sync, roots."""
    commit = current_commit(spark, path)
    state = commit or Commit()
    counted = (
        document_count(Index(spark, path, commit)) if commit
        else spark.createDataFrame([(0,)], "file_count bigint")
    )
    roots = [F.struct(F.lit(r["path"]).alias("path"), F.lit(r["encoding"]).alias("encoding")) for r in state.roots]
    return counted.select(
        F.lit(commit is not None).alias("built"),
        F.lit(Folder(spark, path).resolve()).alias("index_dir"),
        "file_count",
        F.lit(index_size(spark, path)).cast("bigint").alias("size_bytes"),
        F.to_timestamp(F.lit(state.last_build)).alias("last_build"),
        F.to_timestamp(F.lit(state.last_sync)).alias("last_sync"),
        (F.array(*roots) if roots else F.array().cast("array<struct<path:string,encoding:string>>")).alias("roots"),
    )
