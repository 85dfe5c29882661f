"""Polls of a folder as a stream that starts again, and pages written whole or not at all."""

import ast
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import polls, rendered
from tidemark.streaming.watch import watch


def run(spark, folder, tmp_path, until):
    polls.register(spark)
    stream = spark.readStream.format("folder_polls").option("folder", str(folder)).option("log", str(tmp_path / "log")).option("polls", until).option("part", 2).load()
    q = watch(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        for _ in range(120):
            seen = q.lastProgress["sources"][0]["endOffset"] if q.lastProgress else None
            seen = ast.literal_eval(seen) if isinstance(seen, str) else seen
            if q.exception() or (seen and seen["poll"] == until):
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert q.exception() is None
    return sorted((r.path, r.digest is None, r.revision) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_stream_of_polls_tells_each_change_once(spark, tmp_path):
    folder = tmp_path / "tree"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("one")
    (folder / "sub" / "b.md").write_text("two")
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "c.md").write_text("skipped")
    first = [("a.md", False, 1), ("sub/b.md", False, 1)]
    assert run(spark, folder, tmp_path, 2) == first
    (folder / "a.md").write_text("other")
    os.remove(folder / "sub" / "b.md")
    # starts again from its checkpoint: the change and the loss are told, each once
    assert run(spark, folder, tmp_path, 5) == sorted([*first, ("a.md", False, 2), ("sub/b.md", True, 1)])


def docs(spark, texts):
    return spark.createDataFrame([(d, t, 1, len(t)) for d, t in texts.items()], "doc string, text string, mtime long, size long")


def test_pages_are_rendered_once(spark, tmp_path):
    folder = tmp_path / "site"
    (folder / "sub").mkdir(parents=True)
    (folder / "theirs.html").write_text("by hand")
    texts = {"a.md": "# A", "sub/b.md": "# B", "theirs.md": "# T"}
    states = lambda df: {r.doc: r.state for r in df.collect()}
    assert states(rendered.refresh(docs(spark, texts), str(folder))) == {"a.md": "missing", "sub/b.md": "missing", "theirs.md": "foreign"}
    assert (folder / "theirs.html").read_text() == "by hand" and "<h1" in (folder / "sub" / "b.html").read_text()
    written = (folder / "a.html").stat().st_mtime_ns
    assert states(rendered.refresh(docs(spark, texts), str(folder))) == {"a.md": "fresh", "sub/b.md": "fresh", "theirs.md": "foreign"}
    assert (folder / "a.html").stat().st_mtime_ns == written
    assert states(rendered.refresh(docs(spark, texts | {"a.md": "# Other"}), str(folder)))["a.md"] == "stale"
    assert "Other" in (folder / "a.html").read_text()
    assert sorted(os.listdir(folder)) == ["a.html", "sub", "theirs.html"]
    assert states(rendered.refresh(docs(spark, texts).limit(0), str(folder))) == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rendered.register(spark)
    rows = spark.createDataFrame([(f"p{i}.md" if i < 7 else "../out.md", "ab", "x") for i in range(8)], "doc string, key string, html string").repartition(4)
    with pytest.raises(Exception, match="lies outside"):
        rows.write.format("rendered_pages").option("folder", str(tmp_path / "site")).mode("append").save()
    assert [n for _, _, names in os.walk(tmp_path / "site") for n in names] == []
    rows.filter("doc LIKE 'p%'").withColumn("html", F.when(F.col("doc") != "p1.md", F.col("html"))).write.format("rendered_pages").option("folder", str(tmp_path / "site")).mode("append").save()
    assert sorted(os.listdir(tmp_path / "site")) == [f"p{i}.html" for i in (0, 2, 3, 4, 5, 6)]
