"""The roll-up of events as a Structured Streaming job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import rollup


#: How far an event may lag behind the newest one; windows older than that leave the state.
LATE = "31 days"


def run_rollup(spark: SparkSession, events: DataFrame, to: str, width: str = "1 hour", late: str = LATE, closed: bool = False) -> DataFrame:
    """Run the stream over all files there are and return what it wrote.

    Each batch writes the state of the windows it touched, and the newest state
    of a window holds. With ``closed``, a window is written once, when the
    watermark has passed it, so the newest windows are still open at the end.

    Cases: a null type is a type like any other; an event whose window ended
    ``late`` or more before the newest event of earlier batches (without the one
    just before) is left out; a null time belongs to no window; no events give
    no rows.
    """
    here = f"{to}/{uuid.uuid4().hex}"
    path, state = f"{here}/out", f"{here}/state"
    rolled = rollup(events, width, late)
    if closed:
        query = rolled.writeStream.outputMode("append").format("parquet").option("path", path)
        query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rolled.schema).parquet(path)

    written = []  # on the driver: the batches there are

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    # in this mode a batch without new events would only clear state that ends with the run
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        query = rolled.writeStream.outputMode("update").foreachBatch(keep)
        query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    if not written:
        return spark.createDataFrame([], rolled.schema)
    if len(set(written)) == 1:
        return spark.read.schema(rolled.schema).parquet(f"{path}/batch={written[0]}")
    values = [c for c in rolled.columns if c not in ("start", "event_type")]
    found = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rolled.schema)}, batch int").parquet(path)
    newest = found.groupBy("start", "event_type").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select("start", "event_type", "v.*")
