"""Histories of git repositories as a Spark data source, one partition for each repository.

spark.read.format("git_history").option("repos", "a,b").option("table", "events").load(), with tables commits, events, tree, files, ignored, blobs (code at each commit), blame
and base (code at the revision of option `since`; texts of what differs from the working tree). `repos` may also be a JSON list, for folders with commas.
Calls have a time limit; after three that exceed it the rest of a repository is left out, and says so in a row of `unanswered`.
"""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.inventory import CODE, PRIVATE_ENDINGS, PRIVATE_NAMES

TABLES = {
    "commits": "repo string, pos long, sha string, epoch long, subject string",
    "events": "repo string, path string, pos long, kind string, other string, epoch long",
    "tree": "repo string, path string, mode string, sha string",
    "blame": "repo string, path string, line long, sha string, epoch long",
    "files": "repo string, path string, link boolean, dirty boolean",
    "ignored": "repo string, path string",
    "blobs": "repo string, path string, pos long, sha string, epoch long, text string",
    "base": "repo string, path string, text string",
    "unanswered": "repo string, calls long",
}
MARK, FIELD = "\x1e", "\x1f"


def private(path: str) -> bool:
    """As `inventory.is_private`, for what is read here."""
    low = path.lower()
    name = low.rpartition("/")[2]
    return name in PRIVATE_NAMES or name.startswith(".env.") or name.endswith(tuple(PRIVATE_ENDINGS)) or "secret" in low or "cookie" in low


class Repository:
    """One working tree; answers are None where git does not answer in time."""

    def __init__(self, root: str, limit: float = 120.0, strikes: int = 3):
        self.root, self.limit, self.strikes, self.unanswered = root, limit, strikes, 0

    def ask(self, *args: str) -> str | None:
        if self.unanswered >= self.strikes:
            self.unanswered += 1
            return None
        try:
            done = subprocess.run(["git", "-C", self.root, "-c", "core.quotepath=off", *args], capture_output=True, timeout=self.limit, check=False)
        except subprocess.TimeoutExpired:
            self.unanswered += 1
            return None
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None

    def log(self) -> list[tuple[list[str], list[tuple[str, str, str | None]]]]:
        """Commits, newest first, each with its changes (kind, path, other path)."""
        text = self.ask("log", "--topo-order", "-M", "--name-status", "-z", f"--format={MARK}%H{FIELD}%ct{FIELD}%s{FIELD}") or ""
        out = []
        for entry in text.split(MARK)[1:]:
            *head, rest = entry.split(FIELD, 3)
            words, changes = [w.strip("\n") for w in rest.split("\0")], []
            words = [w for w in words if w]
            while words:
                kind = words.pop(0)
                if kind[0] in "RC":
                    old, new = words.pop(0), words.pop(0)
                    if kind[0] == "R":
                        changes.append(("D", old, new))
                    changes.append(("A", new, old if kind[0] == "R" else None))
                else:
                    changes.append((kind[0] if kind[0] in "AD" else "M", words.pop(0), None))
            out.append((head, changes))
        return out

    def tree(self, rev: str = "HEAD") -> list[tuple[str, str, str]]:
        rows = []
        for line in (self.ask("ls-tree", "-r", "-z", rev) or "").split("\0"):
            if line:
                info, path = line.split("\t", 1)
                mode, _, sha = info.split(" ")
                rows.append((path, mode, sha))
        return rows

    def files(self) -> list[tuple[str, bool, bool]]:
        """(path, is a link, is changed) of what is tracked or neither tracked nor ignored, and there."""
        modes = {path: mode for path, mode, _ in self.tree()}
        status = [x for x in (self.ask("status", "--porcelain", "-z", "--no-renames", "-uall") or "").split("\0") if x]
        state = {x[3:]: x[:2] for x in status}
        here = sorted({*modes, *state} - {p for p, s in state.items() if "D" in s})
        return [(p, modes.get(p) == "120000", p in state) for p in here]

    def ignored(self) -> list[str]:
        return [x for x in (self.ask("ls-files", "--others", "--ignored", "--exclude-standard", "-z") or "").split("\0") if x]

    def show(self, rev: str, path: str) -> str | None:
        return self.ask("show", f"{rev}:{path}")

    def differing(self, rev: str) -> set[str]:
        """Paths of `rev` that are not there any more or hold something else in the working tree."""
        words = (self.ask("diff", "--no-renames", "--name-status", "-z", rev, "--") or "").split("\0")
        return {path for kind, path in zip(words[::2], words[1::2], strict=False) if kind[:1] in "DMT"}

    def is_ancestor(self, old: str, new: str) -> bool:
        return self.ask("merge-base", "--is-ancestor", old, new) is not None

    def blame(self, path: str) -> list[tuple[int, str | None, int | None]]:
        """(line, commit, committer time), white space aside; lines that no commit has yet have neither."""
        out, sha, line, times = [], "", 0, {}
        for row in (self.ask("blame", "-w", "--line-porcelain", "--", path) or "").split("\n"):
            if row.startswith("\t"):
                out.append((line, sha, times.get(sha, 0)) if sha.strip("0") else (line, None, None))
            elif row.startswith("committer-time "):
                times[sha] = int(row.split(" ")[1])
            elif len(parts := row.split(" ")) >= 3 and len(parts[0]) == 40:
                sha, line = parts[0], int(parts[2])
        return out


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        given = options["repos"]
        self.repos = json.loads(given) if given.startswith("[") else [r.strip() for r in given.split(",") if r.strip()]
        self.since = options.get("since", "HEAD")
        self.table, self.limit = options.get("table", "commits"), float(options.get("timeout", 120))
        self.endings = tuple(options.get("endings", " ".join(CODE)).split())

    def partitions(self):
        return [InputPartition(r) for r in self.repos]

    def read(self, partition):
        repo = Repository(partition.value, self.limit)
        name = partition.value
        if self.table in ("commits", "events"):
            for pos, (head, changes) in enumerate(repo.log()):
                sha, epoch, subject = head
                if self.table == "commits":
                    yield name, pos, sha.strip(), int(epoch), subject
                else:
                    for kind, path, other in changes:
                        yield name, path, pos, kind, other, int(epoch)
        elif self.table == "tree":
            for path, mode, sha in repo.tree():
                yield name, path, mode, sha
        elif self.table == "blame":
            for path, _, _ in repo.tree():
                if path.lower().endswith((".md", ".markdown", ".mdx")):
                    for line, sha, epoch in repo.blame(path):
                        yield name, path, line, sha, epoch
        elif self.table == "files":
            for path, link, dirty in repo.files():
                yield name, path, link, dirty
        elif self.table == "ignored":
            for path in repo.ignored():
                yield name, path
        elif self.table == "blobs":
            for pos, ((sha, epoch, _), changes) in enumerate(repo.log()):
                for kind, path, _ in changes:
                    if path.lower().endswith(self.endings) and not private(path):
                        yield name, path, pos, sha.strip(), int(epoch), "" if kind == "D" else repo.show(sha.strip(), path)
        elif self.table == "base":
            differing = repo.differing(self.since)
            for path, mode, _ in repo.tree(self.since):
                if path.lower().endswith(self.endings) and not private(path) and mode != "120000":
                    yield name, path, repo.show(self.since, path) if path in differing else None
        elif self.table == "unanswered":
            repo.log()
            yield name, repo.unanswered


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "commits")]

    def reader(self, schema):
        return GitReader(dict(self.options))


def read(spark: SparkSession, roots: dict[str, str], table: str, **options: str) -> DataFrame:
    """A table of the histories of `roots` (name: folder), with the names in `repo`."""
    register(spark)
    name = F.create_map(*(F.lit(x) for repo, root in roots.items() for x in (root, repo)))
    found = spark.read.format("git_history").options(repos=json.dumps(list(roots.values())), table=table, **options).load()
    return found.withColumn("repo", name[F.col("repo")])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)
