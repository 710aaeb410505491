"""Session, table and scratch-folder helpers shared by all operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
#: Bytes of freed memory that a Python worker keeps.
KEPT_BYTES = 32 << 20

_scratch: dict[str, str] = {}


def get_session(app: str = "nichelens", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_day(df: DataFrame, name: str) -> Column:
    """The UTC day of a timestamp column, whatever the session's time zone is."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.date_from_unix_date(F.floor(F.unix_micros(name) / F.lit(MICROS_PER_DAY)).cast("int"))
    return F.to_date(F.col(name))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application for intermediate tables.

    It lies in ``spark.checkpoint.dir``. Only a local session may go without
    that setting; it then gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="nichelens-")
        _scratch[app] = f"{base.rstrip('/')}/nichelens-{app}"
        atexit.register(_drop, spark, _scratch[app])
    return _scratch[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        if getattr(df, "_scratch", None):
            _drop(df.sparkSession, df._scratch)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds files. Any other trouble with it is raised, so that a table that can't be read is never taken for an empty one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def quoted(name: str) -> str:
    """A column name that may hold dots, for use in F.col."""
    return f"`{name.replace('`', '``')}`"


def keep_freed() -> None:
    """Let a worker that makes the same arrays again and again reuse freed memory, as new pages cost more than the work. Where the C library isn't glibc nothing changes."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(-1, KEPT_BYTES)  # M_TRIM_THRESHOLD
    mallopt(-3, KEPT_BYTES)  # M_MMAP_THRESHOLD
