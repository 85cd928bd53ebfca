"""Score scoring requests as they arrive (the reference serves them over HTTP).

A Structured Streaming file source with the declared request schema feeds
``foreachBatch``: each micro-batch is validated (B11), scored (H5) with a
fixed parameter set and written to a folder of its own in a parquet sink;
rejected rows go to a separate sink. The checkpoint location makes the query
restartable after a driver or executor failure; a batch that is run again
overwrites its own folders, so no request is answered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clvforge import schemas as S
from clvforge.operators.value import score_requests, validate_requests


def request_stream(spark: SparkSession, src_dir: str, fmt: str = "json",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(S.REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(src_dir)


def start_scoring(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
                  bg: dict | None = None, fmt: str = "json", once: bool = False,
                  processing_time: str | None = "10 seconds") -> StreamingQuery:
    """Start the scoring stream; ``once`` processes what is there and stops."""

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        ok, bad = validate_requests(batch)
        score_requests(ok, bg).write.mode("overwrite").parquet(f"{out_dir}/scores/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out_dir}/rejected/batch_id={batch_id}")

    w = (request_stream(spark, src_dir, fmt).writeStream
         .foreachBatch(score_batch).option("checkpointLocation", checkpoint))
    if once:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
