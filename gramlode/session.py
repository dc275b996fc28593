"""Session helper: the settings that results and plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Needed for results: UTC timestamps, and Java charsets that replace malformed bytes by U+FFFD.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}
# Good for plans: lets a lookup by document number reach the Parquet page index.
ADVISED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.pushdown.inFilterThreshold": "100",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in {**REQUIRED, **ADVISED}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


ARROW_ROWS = 1024
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Hand at most ``rows`` rows and about ``size`` bytes at once to Python: whole texts of a batch must fit in a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def local_session(cpus: int | str = 8, app: str = "gramlode", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**REQUIRED, **ADVISED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, for tables that outlive one job.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is made for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gramlode-")
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_folder(spark)}/gramlode/{label}-{uuid.uuid4().hex[:12]}"
