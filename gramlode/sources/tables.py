"""Corpora that are tables: any DataFrame with a path and a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.constants import BROADCAST_ROWS, UTF8


Verify = Callable[[DataFrame], DataFrame]   # from (path, text) to hits


class TableCorpus:
    """A table of texts. ``path`` must identify a row; rows whose path is null are replaced together."""

    def __init__(
        self,
        df: DataFrame,
        path: Column | str = "path",
        text: Column | str = "text",
        root: Column | str | None = None,
        mtime: Column | str | None = None,
        max_bytes: int | None = None,
        size: Column | str | None = None,
    ):
        """``size`` gives the bytes of the text where the table has them; listings then read no text."""
        def col(c, default):
            return default if c is None else (F.col(c) if isinstance(c, str) else c)

        known = (
            col(path, None).cast("string").alias("path"),
            col(root, F.lit("")).cast("string").alias("root"),
            F.lit(UTF8).alias("enc"),
            col(mtime, F.lit(0)).cast("bigint").alias("mtime"),
        )
        given = (F.lit(None) if size is None else col(size, None)).cast("bigint").alias("size")
        # A text that is worked out is so once for a row: what asks for it stays above the explode, so none of it is spelled out again there.
        body = col(text, None) if isinstance(text, str) else F.explode(F.array(text))
        rows = df.select(*known, given, body.alias("text"))
        if size is None:
            rows = rows.withColumn("size", F.octet_length("text").cast("bigint"))
        listed = rows if size is None else df.select(*known, given)
        self.max_bytes = max_bytes
        # a row without text is no document, and has no size
        self._listed = listed.where(F.col("size").isNotNull()).drop("text")
        self._rows = rows.where(F.col("text").isNotNull())

    def listing(self) -> DataFrame:
        """(path, root, enc, mtime, size) of everything there is."""
        return self._listed

    def indexable(self, listing: DataFrame) -> DataFrame:
        """Listed rows that may be indexed, as far as their metadata tells."""
        return listing if self.max_bytes is None else listing.where(F.col("size") <= self.max_bytes)

    def texts(self, keys: DataFrame | None = None, bound: int | None = None) -> DataFrame:
        """(path, root, enc, mtime, size, text) of all rows or of the paths in ``keys``.

        ``bound`` is a proven upper bound on the number of keys.
        """
        rows = self.indexable(self._rows)
        if keys is None:
            return rows
        asked = _sized(keys.select(F.col("path").alias("_path")), bound)
        found = rows.join(asked, F.col("path").eqNullSafe(F.col("_path")), "left_semi")
        if bound is None or bound > BROADCAST_ROWS:
            return found
        # The few rows found are gathered, or every split of the table would make a tiny file.
        return found.repartition(min(1 + bound // 1000, 2 * df_cores(found)))

    def texts_now(self, paths: DataFrame, bound: int | None = None) -> DataFrame:
        """``texts`` of the given paths; a table is always in its present state."""
        return self.texts(paths, bound)

    def covers(self, paths: DataFrame) -> DataFrame:
        """The paths that belong to the corpus: a table has no bounds."""
        return paths

    def reread(self, found: DataFrame, bound: int | None, verify: Verify) -> DataFrame:
        """``verify``'s hits (file, ...) in the candidates as they are now, with their n_grams.

        Few candidates are broadcast to the scan. Where they are many, the scan verifies every text and only the hits
        meet the candidates: no text is shuffled.
        """
        rows = self._rows.select("path", "text")
        if bound is not None and bound <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(found.select("path")), "path", "left_semi")
        return verify(rows).join(_sized(found.select(F.col("path").alias("file"), "n_grams"), bound), "file")


def _sized(df: DataFrame, bound: int | None) -> DataFrame:
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_ROWS else df


def df_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism
