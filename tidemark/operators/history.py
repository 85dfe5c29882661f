"""What was there when: path histories as event tables (path, epoch, commit, kind of A, M, D).

The larger (epoch, commit), the later. As-of reads are one window over events and questions together, so a path with a long
history costs one sort and no join that multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order() -> list:
    return [F.col("epoch"), F.col("commit")]


def state_as_of(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Questions (doc, line, path, written) with `state`: the kind of the last event of the path at or before `written`, null before all."""
    e = events.select("path", F.col("epoch").alias("_at"), F.lit(0).alias("_ask"), F.col("commit").alias("_c"), "kind", *(F.lit(None).cast(t).alias(c) for c, t in questions.dtypes if c != "path"))
    q = questions.select("path", F.col("written").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("_c"), F.lit(None).cast("string").alias("kind"), *(c for c in questions.columns if c != "path"))
    at = Window.partitionBy("path").orderBy("_at", "_ask", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.unionByName(q).withColumn("state", F.last("kind", ignorenulls=True).over(at)).filter("_ask = 1").select(*questions.columns, "state")


def last_seen(events: DataFrame) -> DataFrame:
    """The newest event of each path that is no deletion."""
    return events.filter("kind <> 'D'").groupBy("path").agg(F.max(F.struct("epoch", "commit")).alias("m")).select("path", F.col("m.epoch").alias("epoch"), F.col("m.commit").alias("commit"))


def gone_by(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Questions (doc, line, path, written) with the first deletion of the path after `written`; those without one go. One window, as in `state_as_of`, from the latest to the first: a frame that grows is read once, one that shrinks anew for each row."""
    others = [c for c in questions.columns if c != "path"]
    e = events.filter("kind = 'D'").select("path", F.col("epoch").alias("_at"), F.lit(1).alias("_event"), "epoch", "commit", *(F.lit(None).cast(t).alias(c) for c, t in questions.dtypes if c != "path"))
    q = questions.select("path", F.col("written").alias("_at"), F.lit(0).alias("_event"), *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("epoch", "commit")), *others)
    # a question comes before the events of its own second, so what stands above it is later
    later = Window.partitionBy("path").orderBy(F.desc("_at"), "_event", F.desc("commit")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.last(F.when(F.col("_event") == 1, F.struct("epoch", "commit")), ignorenulls=True).over(later)
    return e.unionByName(q).withColumn("m", first).filter("_event = 0 AND m IS NOT NULL").select(*questions.columns, F.col("m.epoch").alias("gone"), F.col("m.commit").alias("gone_commit"))


def current_state(events: DataFrame) -> DataFrame:
    """(path, alive): whether the newest event of a path leaves it there."""
    return events.groupBy("path").agg(F.max_by("kind", F.struct("epoch", "commit")).alias("k")).select("path", (F.col("k") != "D").alias("alive"))


def majority_renames(renames: DataFrame) -> DataFrame:
    """For each old folder (old, new) the folder that most of its files went to; ties go to the first by name."""
    n = renames.groupBy("old", "new").agg(F.count(F.lit(1)).alias("moves"))
    return n.groupBy("old").agg(F.min(F.struct((-F.col("moves")).alias("m"), "new")).alias("b")).select("old", F.col("b.new").alias("new"), (-F.col("b.m")).alias("moves"))


def work_queues(items: DataFrame, departures: int = 3, returns: int = 2) -> DataFrame:
    """Folders through which items pass. `items` (folder, path, epoch, kind): items arrive (A) and leave (D) in at least `departures` different times, and at least `returns` arrive after the first has left."""
    per = items.groupBy("folder", "path").agg(F.max(F.when(F.col("kind") == "A", F.col("epoch"))).alias("came"), F.min(F.when(F.col("kind") == "D", F.col("epoch"))).alias("left"))
    first = per.groupBy("folder").agg(F.min("left").alias("first"), F.countDistinct("left").alias("departures"))
    after = per.join(first, "folder").groupBy("folder", "departures").agg(F.count_if(F.col("came") > F.col("first")).alias("returns"))
    return after.filter((F.col("departures") >= departures) & (F.col("returns") >= returns))


def freshness(refs: DataFrame, touched: DataFrame, slack: int = 86_400, shown: int = 3) -> DataFrame:
    """Documents older than code they refer to: refs (doc, path), touched (path, epoch) for documents and code. (doc, refs, newer: count, examples: newest first)."""
    code = refs.distinct().join(touched, "path").join(touched.select(F.col("path").alias("doc"), F.col("epoch").alias("doc_time")), "doc")
    newer = F.col("epoch") > F.col("doc_time") + slack
    out = code.groupBy("doc").agg(F.count(F.lit(1)).alias("refs"), F.count_if(newer).alias("newer"), F.sort_array(F.collect_list(F.when(newer, F.struct((-F.col("epoch")).alias("t"), "path")))).alias("e"))
    return out.filter("newer > 0").select("doc", "refs", "newer", F.array_join(F.transform(F.slice("e", 1, shown), lambda x: x["path"]), ", ").alias("examples"))


def removals(versions: DataFrame) -> DataFrame:
    """(path, name, epoch): the latest version of a file that no longer has a name which the one before had. versions (path, epoch, names: array)."""
    before = F.lag("names").over(Window.partitionBy("path").orderBy("epoch"))
    lost = versions.withColumn("_before", before).select("path", "epoch", F.explode(F.array_except("_before", "names")).alias("name"))
    return lost.groupBy("path", "name").agg(F.max("epoch").alias("epoch"))


def last_times(events: DataFrame) -> DataFrame:
    return events.groupBy("path").agg(F.max("epoch").alias("epoch"))
