"""Event streams: windowed counts with late data, and the recent turns of each user as state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dialogue import TURNS
from ..plans.staging import stage_dir, staged

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", schema: str = EVENTS) -> DataFrame:
    """The files of a table, one file or a folder of part files, as a stream."""
    reader = spark.readStream.schema(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{files}")
    if "*" not in files and at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.option("recursiveFileLookup", "true").parquet(f"{folder}/{files}")
    return reader.option("pathGlobFilter", files).parquet(folder)


def arriving(df: DataFrame, batch: str, batches: int, files: int = 4) -> DataFrame:
    """The rows as a stream that brings them in the order of `batch` (0 up to batches - 1), a trigger for each."""
    spark = df.sparkSession
    base = f"{stage_dir(spark)}/arriving-{uuid.uuid4().hex}"
    df = staged(df, "arrivals")
    for k in range(batches):
        df.where(F.col(batch) == k).repartition(files).write.mode("append").option("compression", "zstd").parquet(f"{base}/{k:04d}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(base)


def windowed(events: DataFrame, ts: str, by: list[str], value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by..., n, total): tumbling windows; rows later than `late` behind the newest are left out."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, length), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def recent_by_user(events: DataFrame, key: str, ts: str, value: str, n: int = TURNS) -> DataFrame:
    """(key, turns, recent): per trigger, how many rows a key has had and its last n values by time, as an array.

    A key's rows come in several chunks in no order of time, so the n latest of held and new rows are kept chunk by chunk, with
    their times. Rows of the same time stand in the order of their values, rows without a time come last; null values don't count.
    """
    def update(name: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, "[]")
        held = [tuple(x) for x in json.loads(kept)]
        for pdf in pdfs:
            rows = pdf.dropna(subset=["value"]).sort_values(["at", "value"]).tail(n)
            seen, held = seen + len(pdf), sorted([*held, *zip(rows["at"].tolist(), rows["value"].tolist(), strict=True)])[-n:]
        state.update((seen, json.dumps(held)))
        yield pd.DataFrame({key: [name[0]], "turns": [seen], "recent": [[x for _, x in held]]})

    kind = events.schema[key].dataType.simpleString()
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(2**63 - 1)).alias("at")
    rows = events.select(F.col(key).alias("key"), at, F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, f"{key} {kind}, turns bigint, recent array<string>", "turns bigint, kept string", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """The result after all that is there now has run through the stream; written to the shared folder, batch by batch.

    append: all rows; complete: those of the last batch; update: the last version of each `key`.
    """
    spark = stream.sparkSession
    base = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch")
    if mode == "complete":
        last = out.agg(F.max("_batch").alias("_batch"))
        out = out.join(F.broadcast(last), "_batch", "left_semi")
    if mode == "update":
        out = out.groupBy(key).agg(F.max_by(F.struct(*(c for c in out.columns if c not in (key, "_batch"))), "_batch").alias("_last")).select(key, "_last.*")
        return out
    return out.drop("_batch")
