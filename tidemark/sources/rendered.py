"""Rendered pages as files, written by a data source: whole or not at all, and never over a file of another's making.

df.write.format("rendered_pages").option("folder", ...).mode("append").save() takes (doc, key, html): `doc` is the page's path below the folder, its ending replaced by .html; `key` names
what it was made with (see `render.settings_key`). Each task writes under names of its own; a job that ends well renames them, one that fails deletes them. Pages carry their key
in a comment of the first line; `outputs` reads the keys back for `render.cache_state`. The folder must be a path that driver and executors all see.
Null html (a page that failed) writes nothing; a doc that leaves the folder is refused; of rows with one doc the last renamed stands.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.render import cache_state, render, settings_key

MARK = re.compile(r"^<!-- tidemark ([0-9a-f]+) -->\n")
TEMPORARY = ".tidemark-tmp"


def target_of(folder: str, doc: str) -> str:
    """Where the page of `doc` lies; a path that leaves the folder is an error."""
    full = os.path.normpath(os.path.join(folder, re.sub(r"\.(?:md|mdx|markdown)$", "", doc) + ".html"))
    if not full.startswith(os.path.normpath(folder) + os.sep):
        raise ValueError(f"{doc} lies outside of {folder}")
    return full


def key_of(path: str) -> str | None:
    """The key of a page; empty for a file made by others, None where there is none."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            found = MARK.match(f.readline())
    except FileNotFoundError:
        return None
    return found[1] if found else ""


@dataclass
class Written(WriterCommitMessage):
    """Pages of one task: (temporary file, target)."""

    pages: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        pages: list[tuple[str, str]] = []
        for row in rows:
            if row["html"] is None or row["doc"] is None:
                continue
            target = target_of(self.folder, row["doc"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            held = f"{target}.{self.job}-{uuid.uuid4().hex}{TEMPORARY}"
            with open(held, "w", encoding="utf-8", newline="\n") as out:
                out.write(f"<!-- tidemark {row['key']} -->\n{row['html']}")
            pages.append((held, target))
        return Written(pages)

    def commit(self, messages: list[Written | None]) -> None:
        for held, target in (p for m in messages if m for p in m.pages):
            if key_of(target) == "":
                os.remove(held)  # a foreign file has come since the state was read
            else:
                os.replace(held, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes what is left of this job, also of attempts that told nothing."""
        for base, _, names in os.walk(self.folder):
            for name in names:
                if name.endswith(TEMPORARY) and f".{self.job}-" in name:
                    os.remove(os.path.join(base, name))


class RenderedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rendered_pages"

    def schema(self) -> str:
        return "doc string, key string, html string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["folder"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RenderedPages)


def outputs(docs: DataFrame, folder: str) -> DataFrame:
    """(doc, made_here, key, mtime, size) of the pages that there are of `docs` (doc, mtime, size); time and size are the source's, which its key holds."""

    def of(batches):
        for batch in batches:
            keys = [key_of(target_of(folder, d)) for d in batch["doc"]]
            out = [(d, k != "", k, m, s) for d, k, m, s in zip(batch["doc"], keys, batch["mtime"], batch["size"], strict=True) if k is not None]
            yield pd.DataFrame(out, columns=["doc", "made_here", "key", "mtime", "size"])

    return docs.select("doc", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size")).mapInPandas(of, "doc string, made_here boolean, key string, mtime long, size long")


def refresh(docs: DataFrame, folder: str, lang: str = "vi", with_toc: bool = True) -> DataFrame:
    """Writes the pages of `docs` (doc, text, mtime, size) that are missing or stale and returns (doc, state) of all as they were before; fresh pages are not rendered, foreign files not touched.

    The state is written to a stage table first, so that it does not change with the files."""
    from ..staging import staged

    register(docs.sparkSession)
    keyed = docs.withColumns({"mtime": F.col("mtime").cast("long"), "size": F.col("size").cast("long")}).withColumn("key", settings_key(F.lit(lang), F.lit(with_toc), F.col("doc"), F.col("mtime"), F.col("size"), F.col("text")))
    known = staged(cache_state(keyed.select("doc", "key", "mtime", "size"), outputs(keyed, folder)), "pages-state")
    due = keyed.join(known.filter("state IN ('missing', 'stale')").select("doc"), "doc", "left_semi")
    made = render(due, lang=lang, with_toc=with_toc).join(due.select("doc", "key"), "doc").select("doc", "key", "html")
    made.write.format("rendered_pages").option("folder", folder).mode("append").save()
    return known.select("doc", "state")
