"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours relies on: UTC so day arithmetic on wall-clock
# timestamps is stable, AQE for runtime coalescing and skew-join splitting.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "clvforge",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one
    gets a private folder under the system temp dir (tests, laptops).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a folder on a shared file system is "
            "required to cut lineage on a cluster")
    path = os.path.join(tempfile.gettempdir(), f"clvforge-ckpt-{uuid.uuid4().hex[:12]}")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_TABLES: list[str] = []


def durable_cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Writes a parquet table under ``<checkpoint dir>/tables`` and reads it
    back: one computation, columnar and compressed, and the read-back carries
    real size statistics for AQE's join choices. It survives executor loss,
    unlike ``localCheckpoint``. ``release_tables`` deletes what is no longer
    needed.
    """
    return df.sparkSession.read.parquet(write_table(df))


def write_table(df: DataFrame) -> str:
    """The first half of ``durable_cut``: the path of the written table."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _TABLES.append(path)
    return path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    delete_path(spark, path)
    _TABLES.remove(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``durable_cut`` has written since a mark
    (``table_mark()``), once the results that read them are consumed."""
    for path in _TABLES[since:]:
        delete_path(spark, path)
    del _TABLES[since:]


def table_mark() -> int:
    return len(_TABLES)


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``clvforge`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` unpickle functions from it): zip the package once per
    process and register it with ``addPyFile``, once per SparkContext."""
    import hashlib
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    files = []
    for root, _dirs, names in os.walk(pkg_dir):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(root, n))
    h = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            h.update(f.encode())
            h.update(fh.read())
    path = os.path.join(tempfile.gettempdir(), f"clvforge-{h.hexdigest()[:16]}.zip")
    if not os.path.exists(path):
        tmp = f"{path}.{uuid.uuid4().hex}"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            base = os.path.dirname(pkg_dir)
            for f in sorted(files):
                z.write(f, os.path.relpath(f, base))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED[key] = path
