"""File sources and sinks: raw transaction files, saved output tables, model
parameters and run metadata (A1, A4–A7)."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clvforge import schemas as S


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      encoding: str = "ISO-8859-1", bad_rows: str = "raise") -> DataFrame:
    """A1: scan raw invoice lines, by header name and with declared types (no
    inference pass).

    CSV is read as latin-1 with a header, whatever the order of its columns;
    parquet is read as is. Columns are renamed to our snake_case names; the
    timestamp stays text until A2. A missing column raises at once. A row with
    a value that is not of its declared type, or with too many or too few
    fields, raises when it is read; with ``bad_rows="flag"`` such rows stay,
    with null for the value and true in the column ``bad_row``.
    """
    if bad_rows not in ("raise", "flag"):
        raise ValueError(f"bad_rows must be 'raise' or 'flag', not {bad_rows!r}")
    if fmt == "csv":
        scan = spark.read.option("header", True).option("encoding", encoding)
        header = scan.csv(path).columns
        missing = [f.name for f in S.RAW_CSV_SCHEMA if f.name not in header]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        text = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField("_corrupt", T.StringType())])
        raw = (scan.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
               .option("enforceSchema", False).csv(path))
        typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in S.RAW_CSV_SCHEMA}
        bad = F.col("_corrupt").isNotNull()
        for name, value in typed.items():
            bad = bad | (F.col(f"`{name}`").isNotNull() & value.isNull())
        df = raw.select(*[v.alias(n) for n, v in typed.items()], bad.alias("bad_row"))
        if bad_rows == "raise":
            stop = F.raise_error(F.lit(f"a row of {path} does not fit the declared columns")).cast("boolean")
            df = df.where(F.when(F.col("bad_row"), stop).otherwise(True)).drop("bad_row")
    else:
        df = spark.read.format(fmt).load(path)
    for src, dst in S.RAW_TO_OURS.items():
        if src in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


OUTPUT_TABLES = ("customers", "rfm", "segment_stats", "feature_importance")


POINTER = "current_run"


def _hadoop(spark: SparkSession, path: str):
    """(file context, Hadoop path) of a path, in whichever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), p


def _point_to(spark: SparkSession, out_dir: str, run: str) -> None:
    """Writes the pointer beside its place and renames it over the old one, which is one step of the file system."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    context, aside = _hadoop(spark, f"{out_dir}/{POINTER}.{run}")
    flags = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE, fs.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(fs.Options.CreateOpts, 0)
    stream = context.create(aside, flags, none)
    try:
        stream.write(bytearray(run.encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    context.rename(aside, _hadoop(spark, f"{out_dir}/{POINTER}")[1], over)


def current_run(spark: SparkSession, out_dir: str) -> str:
    """The folder that the pointer names; ``out_dir`` itself where nothing was published."""
    context, pointer = _hadoop(spark, f"{out_dir}/{POINTER}")
    if not context.util().exists(pointer):
        return out_dir
    return f"{out_dir}/runs/{spark.read.text(f'{out_dir}/{POINTER}').first()[0]}"


@contextmanager
def publication(spark: SparkSession, out_dir: str, keep: int = 2):
    """A new run folder to write to; when the block ends without error, readers see all of it at once.

    Until then, and if the block fails, ``current_run`` gives the run before. Of published runs the last
    ``keep`` stay; a failed run's folder is deleted."""
    before = current_run(spark, out_dir)
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{out_dir}/runs/{run}"
    try:
        yield folder
        _point_to(spark, out_dir, run)
    except BaseException:
        context, path = _hadoop(spark, folder)
        context.delete(path, True)
        raise
    context, path = _hadoop(spark, f"{out_dir}/runs")
    found = context.util().listStatus(path)
    runs = sorted(f.getPath().getName() for f in found)
    stay = {run, before.rsplit("/", 1)[-1], *runs[-keep:]}
    for name in runs:
        if name not in stay and name < run:
            context.delete(_hadoop(spark, f"{out_dir}/runs/{name}")[1], True)


def write_tables(dfs: dict[str, DataFrame], folder: str, fmt: str = "parquet", partition_segments: bool = False) -> None:
    """Each named table under ``folder/<name>``; customer-level tables may be partitioned by segment so
    that target lists read one segment only (partition pruning)."""
    for name, df in dfs.items():
        w = df.write.mode("overwrite")
        if partition_segments and "segment" in df.columns and name in ("customers", "rfm"):
            w = w.partitionBy("segment")
        if fmt == "csv":
            w.option("header", True).csv(f"{folder}/{name}")
        else:
            w.format(fmt).save(f"{folder}/{name}")


def write_outputs(dfs: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", partition_segments: bool = False) -> None:
    """A5: write all named tables as one publication: readers see the old set or the new one, never parts of both."""
    spark = next(iter(dfs.values())).sparkSession
    with publication(spark, out_dir) as folder:
        write_tables(dfs, folder, fmt, partition_segments)


def read_customer_outputs(spark: SparkSession, out_dir: str, fmt: str = "parquet",
                          names=OUTPUT_TABLES) -> dict[str, DataFrame]:
    """A4: read the published tables back; absent ones are skipped, anything else that
    keeps a table from being read is an error."""
    out = {}
    folder = current_run(spark, out_dir)
    for name in names:
        try:
            r = spark.read
            if fmt == "csv":
                r = r.option("header", True).option("inferSchema", True)
            out[name] = r.format(fmt).load(f"{folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


PARAM_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
])


def params_frame(spark: SparkSession, model: str, params: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(
        [(model, k, float(v)) for k, v in params.items()], PARAM_SCHEMA)


def save_params(spark: SparkSession, model: str, params: dict[str, float], path: str) -> None:
    """Persist fitted parameters as a (model, name, value) table."""
    params_frame(spark, model, params).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str, model: str | None = None) -> dict[str, float]:
    df = spark.read.parquet(path)
    if model:
        df = df.where(F.col("model") == model)
    return {r["name"]: r["value"] for r in df.collect()}  # a handful of rows


def run_metadata(spark: SparkSession, n_customers: int, feature_names: list[str],
                 metrics: dict[str, dict[str, float]], best_model: str) -> DataFrame:
    """One-row summary of a training run (date, size, features, metrics)."""
    schema = T.StructType([
        T.StructField("training_date", T.StringType()),
        T.StructField("n_customers", T.LongType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("metrics_json", T.StringType()),
        T.StructField("best_model", T.StringType()),
    ])
    row = (datetime.now(timezone.utc).isoformat(), int(n_customers), list(feature_names),
           json.dumps(metrics, sort_keys=True), best_model)
    return spark.createDataFrame([row], schema)
