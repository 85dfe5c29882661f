"""Watching files: polls as a stream, state by path, renders as the result.

A change counts when two polls in a row see the same new time and size, and renders only if the content differs from what was last rendered. A
file that goes missing is told once, with a null digest, until it is back. `settled_changes` says the same over a finished table of polls with windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POLLS = "path string, poll long, mtime long, size long, digest string"
RENDERS = "path string, poll long, digest string, revision long"
STATE = "mtime long, size long, digest string, revision long, missing boolean"


def settled_changes(polls: DataFrame) -> DataFrame:
    """(path, poll, digest, revision) from a table of polls (path, poll, mtime, size, digest); null mtime means that the file is missing."""
    at = Window.partitionBy("path").orderBy("poll")
    twice = (F.col("mtime") == F.lag("mtime").over(at)) & (F.col("size") == F.lag("size").over(at))
    seen = polls.filter("mtime IS NOT NULL").withColumn("_twice", twice).filter("_twice")
    fresh = seen.withColumn("_before", F.lag("digest").over(at)).filter("_before IS NULL OR _before <> digest").select("path", "poll", "digest")
    left = polls.withColumn("_there", F.coalesce(F.lag("mtime").over(at).isNotNull() | F.lag("poll").over(at).isNull(), F.lit(True))).filter("mtime IS NULL AND _there").select("path", "poll", F.lit(None).cast("string").alias("digest"))
    return fresh.unionByName(left).select("path", "poll", "digest", F.count("digest").over(at).alias("revision"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mtime, size, digest, revision, missing = state.get if state.exists else (-1, -1, "", 0, False)
    out = []
    for p in pd.concat(list(batches)).sort_values("poll").itertuples(index=False):
        if pd.isna(p.mtime):
            if not missing:
                out.append((key[0], p.poll, None, revision))
            missing = True
            continue
        if (p.mtime, p.size) == (mtime, size) and p.digest != digest:
            digest, revision = p.digest, revision + 1
            out.append((key[0], p.poll, digest, revision))
        mtime, size, missing = int(p.mtime), int(p.size), False
    state.update((mtime, size, digest, revision, missing))
    yield pd.DataFrame(out, columns=["path", "poll", "digest", "revision"])


def watch(polls: DataFrame) -> DataFrame:
    """The same over a stream of polls. A batch holds a poll's rows whole, so order within it is that of the polls."""
    return polls.groupBy("path").applyInPandasWithState(_step, RENDERS, STATE, "append", GroupStateTimeout.NoTimeout)


def distinct_contents(files: DataFrame) -> DataFrame:
    """One file for each content, line ends aside: the first by path."""
    key = F.sha1(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")).cast("binary"))
    return files.withColumn("digest", key).groupBy("digest").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows, with a watermark for late ones; batch and stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_to_end(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what it wrote; checkpoint and result lie under `folder`."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
