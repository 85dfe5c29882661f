"""A corpus: repositories as tables, and what can be asked of them.

Everything is per repository by the column `repo`, so one plan checks any number of them. Inside of the joins a file is named by its repository
and path together (`at`), so that no rule looks into another tree.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rules
from .functions import messages
from .functions.paths import ancestors, dirname, joined, suffixes
from .functions.text import is_acknowledged, redact, token_estimate
from .operators import claims, decisions, documents, findings, forbid, guards, markdown, places, resolve, scripts, shell, similar, trees, verdicts, vetoes
from .operators import impact as impacts
from .operators.history import last_times
from .operators.inventory import is_agent_file
from .sources import git, manifests
from .sources.files import walk
from .staging import staged

KEYS = ["repo", "path", "doc", "line", "col", "kind", "text", "target"]
SPLIT = "\u0000"
AT_ONCE = 4  # groups of rules that run at a time


def at(path: str | Column) -> Column:
    """A file's name among all repositories."""
    return F.concat_ws(SPLIT, "repo", path)


def below(path: str | Column) -> Column:
    """The same with the repository as the first folder, for what looks at folders."""
    return F.concat_ws("/", F.replace("repo", F.lit("/"), F.lit("\u0001")), path)


@dataclass
class Corpus:
    """files (repo, path, kind, text); events (repo, path, pos, kind, epoch, other), blame (repo, path, line, epoch) and blobs (repo, path, pos, epoch, text) may be absent: what they prove is then not told."""

    files: DataFrame
    events: DataFrame | None = None
    blame: DataFrame | None = None
    blobs: DataFrame | None = None
    live: list[str] = field(default_factory=list)
    history: list[str] = field(default_factory=list)
    plans: list[str] = field(default_factory=list)

    @staticmethod
    def from_folders(spark: SparkSession, roots: dict[str, str], history: bool = False, **settings) -> Corpus:
        """Reads the trees `roots` (name: folder), with `history` also the git history of each."""
        if not roots:
            raise ValueError("no folders given")
        files = reduce(DataFrame.unionByName, (walk(spark, root, repo) for repo, root in roots.items()))
        if not history:
            return Corpus(files, **settings)
        read = lambda table: git.read(spark, roots, table).persist()  # noqa: E731 asked for by several rules
        return Corpus(files, read("events"), read("blame"), read("blobs"), **settings)

    def documents(self) -> DataFrame:
        return self.files.filter("kind = 'doc' AND text IS NOT NULL").withColumn("doc", at("path"))

    def pages(self) -> DataFrame:
        return markdown.scan(self.documents())

    def kinds(self, pages: DataFrame) -> DataFrame:
        docs = self.documents().select("doc", "repo", "path", "text")
        lines = docs.select("doc", F.posexplode(F.slice(F.split("text", "\n"), 1, 20)).alias("p", "text")).select("doc", (F.col("p") + 1).alias("line"), "text")
        old = documents.old_versions(docs.select(below("path").alias("path"))).withColumnRenamed("path", "_at").withColumn("old", F.lit(True))
        known = docs.join(documents.status_words(lines), "doc", "left").withColumn("_at", below("path")).join(old, "_at", "left").join(pages.select("doc", "mark"), "doc")
        kind = documents.document_kind(F.col("path"), F.col("mark"), F.coalesce("status", F.lit("")), F.coalesce("old", F.lit(False)), self.live, self.history, self.plans)
        return known.select("doc", kind.alias("doc_kind"))

    def claims(self, pages: DataFrame | None = None) -> DataFrame:
        """(repo, path, doc, line, col, kind, text, target, anchor): inline names, links, commands and entries of drawn trees, without ignored lines and pages."""
        pages = (pages if pages is not None else self.pages()).filter("NOT ignore_file")
        spans = claims.inline_claims(markdown.exploded(pages, "spans"), "text").select("doc", "line", "col", "kind", "text", "target", F.lit("").alias("anchor"))
        links = claims.link_claims(markdown.exploded(pages, "links")).select("doc", "line", "col", F.lit("link").alias("kind"), F.col("dest").alias("text"), "target", "anchor")
        ignored = pages.select("doc", F.explode("ignored").alias("line"))
        return self._placed(spans.unionByName(links).unionByName(self._drawn(pages)).join(ignored, ["doc", "line"], "left_anti"))

    def _drawn(self, pages: DataFrame) -> DataFrame:
        """What drawn trees name, relative to their page's folder; diagrams, examples and blocks whose line is ignored draw nothing."""
        fences = self._placed(trees.drawn(markdown.exploded(pages, "fences"), trees.teaching_pages(self.documents())).filter("why IS NULL"))
        kept = fences.join(pages.select("doc", F.explode("ignored").alias("start")), ["doc", "start"], "left_anti").withColumn("folder", dirname(F.col("path")))
        entries = self._placed(staged(trees.tree_entries(kept), "entries").withColumnRenamed("path", "entry")).withColumn("folder", dirname(F.col("path"))).drop("path").withColumnRenamed("entry", "path")
        none = self.files.limit(0).select("repo", F.col("path").alias("candidate"))
        ever = none if self.events is None else self.events.select("repo", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("candidate")).distinct()
        told = trees.rebased(entries, self._there(), ever)
        return told.select("doc", "line", "col", F.lit("tree").alias("kind"), "text", F.col("path").alias("target"), F.lit("").alias("anchor"))

    @staticmethod
    def _placed(rows: DataFrame) -> DataFrame:
        part = F.split("doc", SPLIT)
        return rows.withColumns({"repo": part[0], "path": part[1]})

    # ------------------------------------------------------------ rules; each returns KEYS, rule, severity

    def _there(self) -> DataFrame:
        """(repo, candidate): all files and the folders above them."""
        folders = self.files.select("repo", F.explode(ancestors(F.col("path"))).alias("candidate"))
        return self.files.select("repo", F.col("path").alias("candidate")).unionByName(folders).distinct()

    def _written(self, rows: DataFrame) -> DataFrame:
        """`rows` with the time at which a commit wrote their line; null for lines that none has."""
        if self.blame is None:
            return rows.withColumn("written", F.lit(None).cast("long"))
        return rows.join(self.blame.select("repo", "path", F.col("line").cast("int").alias("line"), F.col("epoch").alias("written")), ["repo", "path", "line"], "left")

    def _unresolved(self, made: DataFrame) -> DataFrame:
        """Claims on paths none of whose candidates is there, with the candidates inside of the tree."""
        paths = made.filter("kind IN ('path', 'tree', 'link') AND target <> ''")
        target = F.regexp_replace("target", "^/+|/+$", "")
        each = paths.withColumns({"_t": target, "_d": dirname(F.col("path"))}).withColumns({"_near": joined(F.col("_d"), F.col("_t")), "_root": joined(F.lit(""), F.col("_t"))})
        inside = each.withColumn("_all", F.array_distinct(F.array("_near", "_root"))).withColumn("candidates", F.filter("_all", lambda c: ~c.startswith("../") & (c != "..")))
        tried = inside.select(*KEYS, "candidates", F.explode_outer("candidates").alias("candidate"))
        found = tried.join(self._there().withColumn("hit", F.lit(True)), ["repo", "candidate"], "left").groupBy(*KEYS, "candidates").agg(F.max("hit").alias("hit"))
        return found.filter("hit IS NULL").drop("hit").filter(~((F.col("kind") == "link") & verdicts.is_web_route(F.col("path"), F.col("text"))))

    def _served(self, lost: DataFrame) -> DataFrame:
        """Those of the broken links that a built site serves: from its root by the ending of a file's path, else from the page's folder or the folder that a site gives the page."""
        bare = F.regexp_replace(F.regexp_replace("target", "^/+|/+$", ""), r"\.html?$", "")
        links = lost.filter("kind = 'link' AND target <> ''").withColumns({"_bare": bare, "_rooted": F.col("target").startswith("/"), "_d": dirname(F.col("path"))})
        links = links.filter(F.col("_rooted") | places.is_site_address(F.col("target")) | F.col("target").rlike(r"\.html?$"))
        stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        own = F.when(F.lower(stem).isin("index", "readme"), F.col("_d")).otherwise(joined(F.col("_d"), stem))
        spots = F.when(F.col("_rooted"), F.array("_bare")).otherwise(F.array(joined(F.col("_d"), F.col("_bare")), joined(own, F.col("_bare"))))
        pages = F.flatten(F.transform(spots, lambda p: F.array(*(F.concat(p, F.lit(e)) for e in places.PAGE_ENDINGS))))
        names = F.when(F.col("_rooted"), F.array_append(pages, F.col("_bare"))).otherwise(pages)
        asked = links.select(*KEYS, "_rooted", F.explode(names).alias("_name"))
        by_end = self.files.select("repo", F.explode(suffixes(F.col("path"))).alias("_name")).distinct()
        rooted = asked.filter("_rooted").join(by_end, ["repo", "_name"], "left_semi")
        near = asked.filter("NOT _rooted").join(self.files.select("repo", F.col("path").alias("_name")), ["repo", "_name"], "left_semi")
        return rooted.unionByName(near).select(*KEYS).distinct()

    def _ruled(self, made: DataFrame, said: DataFrame) -> DataFrame:
        """Lost claims on paths, with rule and severity by history, the name close to them (near), whether only capitals differ (case) and whether their tree is a site."""
        lost = staged(self._written(self._unresolved(made)).join(said, ["doc", "line"], "left").withColumn("line_text", F.coalesce("line_text", F.lit(""))), "lost")
        real = self.files.select("repo", F.lower("path").alias("_low"))
        each = lost.select(*KEYS, F.explode("candidates").alias("_c")).withColumn("_low", F.lower("_c"))
        spelled = each.filter("kind = 'link'").join(real, ["repo", "_low"]).select(*KEYS).distinct().withColumn("case", F.lit(True))
        judged = staged(self._judged(lost).join(spelled, KEYS, "left"), "judged")
        spot = F.get("candidates", F.lit(0))
        judged = judged.withColumns({"group": F.concat_ws(SPLIT, "repo", dirname(spot)), "wanted": F.substring_index(spot, "/", -1), "folder": F.col("target").endswith("/")})
        named = self._there().select(F.concat_ws(SPLIT, "repo", dirname(F.col("candidate"))).alias("group"), F.substring_index("candidate", "/", -1).alias("name"), "repo", "candidate")
        named = named.join(self.files.select("repo", F.col("path").alias("candidate"), F.lit(False).alias("folder")), ["repo", "candidate"], "left").withColumn("folder", F.coalesce("folder", F.lit(True)))
        near = staged(similar.likely_typos(judged.filter("kind IN ('path', 'tree') AND NOT ever AND size(candidates) > 0"), named), "near")
        judged = judged.join(near.withColumnRenamed("name", "near"), ["group", "wanted", "folder"], "left").drop("group", "wanted", "folder")
        # a link that a site serves is no broken one, and proves that its tree is a site, which makes pages of its own
        served = staged(self._served(lost).withColumn("served", F.lit(True)), "served")
        judged = judged.join(served, KEYS, "left").join(served.select("repo", F.col("served").alias("site")).distinct(), "repo", "left").filter("served IS NULL")
        # the name that a tree draws does not tell where it went
        told = F.when(F.col("kind") == "tree", F.expr("substring(line_text, col + length(text))")).otherwise(F.col("line_text"))
        return staged(verdicts.path_rules(judged.withColumn("agent", is_agent_file(F.col("path"))).withColumn("names_target", F.coalesce(verdicts.names_target(told, F.col("moved_to")), F.lit(False)))), "ruled")

    def _lines(self) -> DataFrame:
        return self.documents().select("doc", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("p", "text")).select("doc", (F.col("p") + 1).alias("line"), "text")

    def _elsewhere(self, pages: DataFrame) -> DataFrame:
        """Pages whose commands and paths are another project's, which they have their readers clone."""
        own = self.files.select("repo", F.substring_index(F.regexp_replace("repo", "/+$", ""), "/", -1).alias("name")).distinct()
        return vetoes.other_projects(self.documents().select("doc", "repo", "path"), shell.entered(markdown.exploded(pages, "fences")), own)

    def _vetoed(self, ruled: DataFrame, pages: DataFrame) -> DataFrame:
        """Paths that never were and are no slips of the pen: (KEYS, veto, status), with all that speaks against telling them."""
        never = staged(ruled.filter("kind IN ('path', 'tree') AND rule = 'path-missing' AND near IS NULL").select(*KEYS, "candidates"), "never")
        lines = staged(self._lines().join(never.select("doc").distinct(), "doc", "left_semi"), "lines")
        keys = ["doc", "line", "target"]
        mark = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(True))
        spots = never.withColumn("candidate", F.explode("candidates"))
        # the folder that the path begins with, from the page's folder and from the root
        head = F.regexp_extract(F.col("target"), r"^(?:\.{0,2}/)*([^/]+)", 1)
        begun = never.withColumn("candidate", F.explode(F.array_distinct(F.array(joined(dirname(F.col("path")), head), joined(F.lit(""), head))))).filter("candidate <> ''")
        held = mark(begun.join(self._there(), ["repo", "candidate"], "left_semi"), "begun")
        covered = mark(vetoes.ignored_targets(spots.withColumn("candidate", below("candidate")), self._ignore_files()), "ignored")
        remote = mark(vetoes.told_elsewhere(never, lines), "remote")
        coded = mark(vetoes.in_literals(never, vetoes.literal_names(self.files.filter("text IS NOT NULL"))), "coded")
        retired = vetoes.retired_pages(lines, markdown.exploded(pages, "headings")).withColumn("retired", F.lit(True))
        foreign = self._elsewhere(pages).withColumn("foreign", F.lit(True))
        # an entry of a tree has no sentence; what follows its name in the line speaks of it
        remark = F.expr("substring(line_text, col + length(text))")
        told = lines.withColumnRenamed("text", "line_text")
        alone = never.filter("kind = 'tree'").join(told, ["doc", "line"], "left").withColumns({"before": F.lit(""), "after": F.coalesce(remark, F.lit(""))}).select(*never.columns, "before", "after")
        known = vetoes.claim_sentences(never.filter("kind <> 'tree'"), lines).unionByName(alone)
        for rows in (held, covered, remote, coded):
            known = known.join(rows, keys, "left")
        known = known.join(retired, "doc", "left").join(foreign, "doc", "left").join(self.kinds(pages), "doc")
        shown = vetoes.word_vetoes(F.col("target"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("doc_kind"))
        shown |= {"retired-page": F.col("retired"), "elsewhere": F.col("remote"), "ignored": F.col("ignored"), "other-project": F.col("foreign"), "no-folder": F.col("begun").isNull(), "in-code": F.col("coded")}
        return staged(vetoes.with_veto(known, shown).select(*KEYS, "veto", "status"), "vetoed")

    def _ignore_files(self) -> DataFrame:
        return self.files.filter("text IS NOT NULL").filter(F.substring_index("path", "/", -1) == ".gitignore").select(below("path").alias("path"), "text")

    def unproved(self) -> DataFrame:
        """(repo, path, line, col, claim, status, veto): paths of documents that are not in the tree and never were: missing, or skipped or unverified with the first reason why."""
        pages = staged(self.pages(), "pages")
        made = staged(self.claims(pages), "claims")
        said = markdown.exploded(pages, "said").withColumnRenamed("text", "line_text")
        return self._vetoed(self._ruled(made, said), pages).select("repo", "path", "line", "col", F.col("text").alias("claim"), "status", "veto")

    def _paths(self, made: DataFrame, said: DataFrame, pages: DataFrame) -> DataFrame:
        ruled = self._ruled(made, said)
        missing = self._vetoed(ruled, pages).filter("status = 'missing'").select(*KEYS, F.lit(True).alias("missing")).distinct()
        ruled = ruled.join(missing, KEYS, "left")
        never = F.col("rule") == "path-missing"
        link, said_so = F.col("kind") == "link", is_acknowledged(F.col("line_text"))
        rule = F.when(link, F.when(F.col("case"), "link-case").otherwise("link-broken")).when(never & F.col("near").isNotNull(), "path-typo").otherwise(F.col("rule"))
        severity = F.when(link, F.when(said_so, "info").when(F.col("case"), "warning").otherwise("error")).when(never & F.col("near").isNotNull(), "warning").otherwise(F.col("severity"))
        told = link | ~never | F.col("near").isNotNull() | F.coalesce("missing", F.lit(False))
        unsure = link & F.coalesce("site", F.lit(False)) & ~F.col("ever") & F.col("case").isNull() & (F.col("target").startswith("/") | places.is_site_address(F.col("target")))
        out = ruled.filter(told).withColumns({"rule": F.when(unsure, "link-unverified").otherwise(rule), "severity": severity}).select(*KEYS, "rule", "severity")
        out = staged(out, "paths")
        notes = self._placed(places.collapsed_site_links(out.filter("rule = 'link-unverified'").select("doc", "line", F.col("text").alias("dest"))))
        notes = notes.withColumns({"col": F.lit(1), "kind": F.lit("link"), "text": F.col("examples"), "target": F.lit("")}).select(*KEYS, F.lit("link-unverified").alias("rule"), F.lit("info").alias("severity"))
        return out.filter("rule <> 'link-unverified'").unionByName(notes)

    def _judged(self, lost: DataFrame) -> DataFrame:
        """What history says of the candidates of each lost claim: then, now, ever, and where it went."""
        if self.events is None:
            return lost.withColumns({"then": F.lit(False), "now": F.lit(False), "ever": F.lit(False), "moved_to": F.lit(None).cast("string")})
        events = self.events.select(at("path").alias("path"), "epoch", (-F.col("pos")).alias("commit"), "kind", "other")
        asked = lost.select(*KEYS, "written", F.explode("candidates").alias("_c")).withColumnRenamed("path", "_doc_path").withColumn("path", at("_c")).drop("_c")
        seen = verdicts.against_history(asked.select("path", "written").distinct(), events)
        moved = events.filter("kind = 'D' AND other IS NOT NULL").groupBy("path").agg(F.max_by("other", F.struct("epoch", "commit")).alias("moved_to"))
        both = asked.join(seen.select("path", F.col("written").alias("_w"), "then", "now", "ever"), (seen["path"] == asked["path"]) & asked["written"].eqNullSafe(F.col("_w"))).drop(seen["path"]).join(moved, "path", "left")
        keys = ["_doc_path" if k == "path" else k for k in KEYS]
        per = both.groupBy(*keys).agg(F.max("then").alias("then"), F.max("now").alias("now"), F.max("ever").alias("ever"), F.max("moved_to").alias("moved_to")).withColumnRenamed("_doc_path", "path")
        known = lost.join(per, KEYS, "left")
        # without a blame nothing is known of the line, so only that a path was ever there counts
        then = F.col("then") if self.blame is not None else F.lit(False)
        return known.withColumns({"then": then, "now": F.coalesce("now", F.lit(False)), "ever": F.coalesce("ever", F.lit(False))})

    def _symbols(self, made: DataFrame) -> DataFrame:
        code = self.files.filter("text IS NOT NULL")
        known = manifests.identifiers(code).select("repo", F.col("name").alias("target"))
        unknown = self._written(made.filter("kind = 'symbol'").join(known, ["repo", "target"], "left_anti"))
        if self.blobs is None:
            return unknown.select(*KEYS, F.lit("symbol-gone").alias("rule"), F.lit("info").alias("severity"))
        words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.concat_ws(SPLIT, F.col("repo"), w)))
        blobs = self.blobs.filter("text IS NOT NULL").select(at("path").alias("path"), "epoch", (-F.col("pos")).alias("commit"), words.alias("names"))
        asked = unknown.withColumn("_path", F.col("path")).withColumn("path", at("target"))
        gone = verdicts.gone_names(asked.select("path", "written").distinct(), verdicts.name_events(blobs), "symbol-gone", "symbol-removed-now").select("path", "written", "rule", "severity")
        hit = asked.join(gone.withColumnsRenamed({"path": "_p", "written": "_w"}), (F.col("path") == F.col("_p")) & F.col("written").eqNullSafe(F.col("_w")))
        return hit.withColumn("path", F.col("_path")).select(*KEYS, "rule", "severity")

    def _flags(self, made: DataFrame) -> DataFrame:
        known = manifests.flag_literals(self.files.filter("text IS NOT NULL")).withColumnRenamed("flag", "target")
        return made.filter("kind = 'flag'").join(known, ["repo", "target"], "left_anti").select(*KEYS, F.lit("flag-missing").alias("rule"), F.lit("warning").alias("severity"))

    def _run(self, pages: DataFrame) -> DataFrame:
        """What shell blocks run, as claims with `what`, `folder`, `flags` and `first`."""
        run = self._placed(shell.block_commands(markdown.exploded(pages.filter("NOT ignore_file"), "fences")).withColumnRenamed("start", "line"))
        return run.withColumns({"col": F.lit(1), "text": F.concat_ws(" ", "tool", "target"), "what": F.col("kind"), "kind": F.lit("command")})

    @staticmethod
    def _scripts_run(run: DataFrame) -> DataFrame:
        """Those that run a script or module, with the files that it may be (candidates): from the block's folder, the page's folder, and the one in the other."""
        here = F.when(F.col("folder") == "", dirname(F.col("path"))).otherwise(F.col("folder"))
        forms = F.when(F.col("what") == "module", F.array(*(F.replace(F.lit(f), F.lit("{}"), F.replace("target", F.lit("."), F.lit("/"))) for f in verdicts.MODULE_FORMS))).otherwise(F.array("target"))
        of_tree = run.filter("what = 'path' AND NOT target RLIKE '^[/~$<]|://' OR what = 'module' AND target LIKE '%.%'").filter(~claims.has_placeholder(F.col("target")))
        return of_tree.withColumn("candidates", F.array_distinct(F.flatten(F.transform(forms, lambda f: F.array(joined(F.col("folder"), f), joined(dirname(F.col("path")), f), joined(here, f))))))

    def _arguments(self, pages: DataFrame) -> DataFrame:
        """Options and subcommands that the code of their script lacks: removed, where it had them when the line was written."""
        ran = self._scripts_run(self._run(pages)).join(self._elsewhere(pages), "doc", "left_anti")
        tried = ran.select(*KEYS, "flags", F.col("first").alias("word"), F.posexplode("candidates").alias("_rank", "candidate")).filter(F.col("candidate").rlike(r"\.pyw?$"))
        code = self.files.filter("kind = 'code' AND text IS NOT NULL").select("repo", "path", "text")
        found = tried.join(code.select("repo", F.col("path").alias("candidate")), ["repo", "candidate"]).groupBy(*KEYS, "flags", "word").agg(F.min_by("candidate", "_rank").alias("script"))
        calls = staged(self._written(found), "calls")
        scope = scripts.places(calls)
        options = scripts.unknown_options(calls.select("*", F.explode("flags").alias("flag")).drop("flags", "word"), scope, code)
        words = scripts.with_hints(scripts.unknown_subcommands(calls.drop("flags"), scope, code))
        if self.blobs is None:
            options, words = options.withColumn("had", F.lit(False)), words.withColumn("had", F.lit(False))
        else:
            options, words = scripts.had_before(options, "flag", self.blobs), scripts.had_before(words, "word", self.blobs)
        rule = F.when(F.col("had"), "flag-removed").otherwise("flag-missing")
        told = options.withColumns({"text": F.col("flag"), "target": F.col("script"), "rule": rule})
        wrong = words.filter("had OR hint IS NOT NULL").withColumns({"text": F.col("word"), "target": F.col("script"), "rule": F.lit("subcommand-missing")})
        return told.select(*KEYS, "rule").unionByName(wrong.select(*KEYS, "rule")).withColumn("severity", F.lit("warning"))

    def _commands(self, pages: DataFrame) -> DataFrame:
        """Scripts, modules, package scripts and make targets that shell blocks run."""
        run, there = self._run(pages), self._there()
        here = F.when(F.col("folder") == "", dirname(F.col("path"))).otherwise(F.col("folder"))
        keys = [*KEYS, "what", "folder"]
        tried = self._scripts_run(run).select(*keys, "candidates", F.explode("candidates").alias("candidate")).join(there.withColumn("hit", F.lit(True)), ["repo", "candidate"], "left")
        lost = tried.groupBy(*keys, "candidates").agg(F.max("hit").alias("hit")).filter("hit IS NULL").drop("hit")
        judged = self._judged(self._written(lost)).withColumn("candidate", dirname(F.get("candidates", F.lit(0)))).join(there.withColumn("folder_there", F.lit(True)), ["repo", "candidate"], "left")
        judged = judged.join(self._elsewhere(pages), "doc", "left_anti")
        missing = verdicts.command_rules(judged.withColumn("folder_there", F.coalesce("folder_there", F.lit(False)) & (F.col("candidate") != ""))).select(*KEYS, "rule", "severity")

        npm = run.filter("what = 'npm'").select(*KEYS, below(here).alias("_at"))
        scripts_ = manifests.npm_scripts(self.files.filter("text IS NOT NULL").withColumn("path", below("path")))
        asked = npm.select(F.col("doc"), "line", F.col("_at").alias("folder"), F.col("target").alias("script")).distinct()
        packed = guards.package_script(asked, scripts_).withColumn("_own", F.substring_index("manifest", "/", 1) == F.substring_index("folder", "/", 1))
        has_any = scripts_.select(F.substring_index("manifest", "/", 1).alias("_r")).distinct()
        unknown = packed.filter("manifest IS NULL OR NOT _own").select("doc", "line", F.col("script").alias("target")).distinct()
        no_script = npm.join(unknown, ["doc", "line", "target"], "left_semi").withColumn("_r", F.substring_index("_at", "/", 1)).join(has_any, "_r", "left_semi").select(*KEYS, F.lit("npm-script-missing").alias("rule"), F.lit("error").alias("severity"))

        made = run.filter("what = 'make'").select(*KEYS, below(here).alias("folder")).withColumn("_f", F.regexp_replace("folder", "/$", ""))
        targets = manifests.make_targets(self.files.filter("text IS NOT NULL").withColumn("path", below("path"))).select("folder", "target")
        none = verdicts.unknown_targets(made.select("doc", "line", F.col("_f").alias("folder"), "target").distinct(), targets).select("doc", "line", "target", "rule", "severity")
        return missing.unionByName(no_script).unionByName(made.join(none, ["doc", "line", "target"]).select(*KEYS, "rule", "severity"))

    def _anchors(self, made: DataFrame, pages: DataFrame) -> DataFrame:
        """Anchors of links into pages of the tree, by any spelling."""
        links = made.filter("kind = 'link' AND anchor <> ''")
        page = F.when(F.col("target") == "", F.col("path")).otherwise(joined(dirname(F.col("path")), F.col("target")))
        docs = pages.select(F.col("doc").alias("_to"))
        into = links.withColumn("_to", at(page)).join(docs, "_to", "left_semi")
        named = pages.select(F.col("doc").alias("path"), F.explode("anchors").alias("anchor")).distinct()
        asked = into.withColumnRenamed("target", "_target").withColumn("target", F.col("_to"))
        lost = resolve.anchor_findings(asked, named).withColumn("target", F.col("_target"))
        unsure = F.col("anchor").rlike("[.:/]")
        return lost.select(*KEYS, F.when(unsure, "anchor-unverified").otherwise("anchor-missing").alias("rule"), F.when(unsure, "info").otherwise("warning").alias("severity"))

    def _decisions(self, said: DataFrame) -> DataFrame:
        """Mentions of decisions against the nearest log that counts for a page."""
        docs = self.documents().select("repo", "doc", "path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("p", "text")).select("repo", "doc", "path", (F.col("p") + 1).cast("int").alias("line"), "text")
        known = self._placed(decisions.decisions(docs.drop("repo")).withColumn("_path", F.col("path")).withColumn("doc", F.col("log"))).withColumns({"folder": decisions.scope(F.when(F.endswith("log", F.lit(".md")) | F.endswith("log", F.lit(".markdown")), F.col("path")).otherwise(F.concat_ws("/", "path", F.lit("x")))), "path": F.col("_path")})
        known = staged(known.select("repo", "log", "folder", "path", "line", "id", "status", "by"), "logs")
        told = decisions.mentions(self._placed(said.select("doc", "line", F.col("line_text").alias("text"))), known).filter(~verdicts.in_template_folder(F.col("path")))
        rule = F.when(F.col("status").isNull(), "decision-unknown").when(F.col("status") == "superseded", "decision-superseded").when(F.col("status") == "amended", "decision-amended")
        severity = F.when(F.col("status").isNull(), "error").when(F.col("status") == "superseded", "warning").otherwise("info")
        out = told.withColumns({"rule": rule, "severity": severity, "col": F.lit(1), "kind": F.lit("decision"), "target": F.col("id")}).filter("rule IS NOT NULL")
        return out.select(*KEYS, "rule", "severity")

    def _versions(self, made: DataFrame, pages: DataFrame) -> DataFrame:
        """Versions that headings state, and pins of packages, against manifests."""
        files = self.files.filter("text IS NOT NULL").withColumn("path", below("path"))
        heads = self._placed(claims.heading_versions(markdown.exploded(pages, "headings")))
        stated = verdicts.version_mismatches(heads.select(below("path").alias("doc"), "line", "version"), manifests.versions(files)).select(F.col("doc").alias("_at"), "line", "version", "rule", "severity")
        told = heads.withColumn("_at", below("path")).join(stated, ["_at", "line", "version"])
        versions = told.withColumns({"col": F.lit(1), "kind": F.lit("version"), "text": F.col("version"), "target": F.col("version")}).select(*KEYS, "rule", "severity")
        pins = manifests.requirement_pins(files).groupBy("folder", "package").agg(F.min("spec").alias("spec"))
        deps = made.filter("kind = 'dep'").withColumn("_spec", F.regexp_replace(F.regexp_replace("text", r"\s+|\[[^\]]*\]", ""), r"^[\w.-]+", ""))
        up = deps.select(*KEYS, "_spec", F.posexplode(F.transform(ancestors(F.col("path")), lambda a: F.regexp_replace(F.concat_ws("/", F.replace("repo", F.lit("/"), F.lit("\u0001")), a), "/$", ""))).alias("_up", "folder"))
        near = up.join(pins.withColumnRenamed("package", "target"), ["folder", "target"]).groupBy(*KEYS, "_spec").agg(F.min_by("spec", "_up").alias("spec"))
        return versions.unionByName(near.filter("spec <> _spec").select(*KEYS, F.lit("dep-mismatch").alias("rule"), F.lit("warning").alias("severity")))

    def _tables(self, pages: DataFrame) -> DataFrame:
        rows = markdown.exploded(pages, "tables").select("doc", "start", "width", F.explode("rows").alias("r"))
        odd = rows.filter("r.cells <> width").select("doc", "r.line", F.concat(F.col("r.cells"), F.lit(" cells, not "), "width").alias("text"), F.lit("table-shape").alias("rule"), F.lit("info").alias("severity"))
        by = Window.partitionBy("doc").orderBy("line")
        stray = pages.select("doc", F.explode("stray").alias("line")).withColumn("_new", (F.col("line") - F.lag("line", 1, -10).over(by) > 2).cast("int"))
        runs = stray.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "_run").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
        first = markdown.exploded(pages, "tables").groupBy("doc").agg(F.min("start").alias("first"))
        cut = runs.join(first, "doc").filter("first < line").select("doc", "line", F.concat("n", F.lit(" rows")).alias("text"), F.lit("table-orphan").alias("rule"), F.lit("warning").alias("severity"))
        return self._placed(odd.unionByName(cut)).withColumns({"col": F.lit(1), "kind": F.lit("table"), "target": F.lit("")}).select(*KEYS, "rule", "severity")

    def _forbidden(self, pages: DataFrame) -> DataFrame:
        """Directives that forbid something: those that cannot be read, and all lines of code that break one, with the line itself (`own`)."""
        known = staged(forbid.rules(self._placed(markdown.exploded(pages, "directives"))), "rules")
        named = self._placed(known.filter("error <> ''")).withColumns({"col": F.lit(1), "kind": F.lit("rule"), "text": F.col("body"), "target": F.lit("")})
        invalid = named.select(*KEYS, F.lit("rule-invalid").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("own"))
        broken = forbid.violations(known, self.files.filter("kind IN ('code', 'conf')"))
        claim = F.substring(redact(F.trim("text")), 1, 120)
        told = broken.withColumns({"own": F.col("text"), "col": F.lit(1), "kind": F.lit("rule"), "target": F.lit("")}).withColumn("text", claim)
        return invalid.unionByName(told.select(*KEYS, F.lit("rule-violation").alias("rule"), F.lit("error").alias("severity"), "own"))

    def _stale(self, made: DataFrame) -> DataFrame:
        """Pages older, by more than a day, than code that they refer to."""
        if self.events is None:
            return made.limit(0).select(*KEYS, F.lit("").alias("rule"), F.lit("").alias("severity"))
        from .operators.history import freshness

        target = F.regexp_replace("target", "^/+|/+$", "")
        refs = made.filter("kind IN ('path', 'tree', 'link') AND target <> ''").select("doc", F.explode(F.array(joined(dirname(F.col("path")), target), joined(F.lit(""), target))).alias("_c"), "repo").select("doc", at("_c").alias("path")).distinct()
        code = self.files.filter("kind = 'code'").select(at("path").alias("path"))
        old = freshness(refs.join(code, "path", "left_semi"), last_times(self.events.select(at("path").alias("path"), "epoch")))
        shown = F.regexp_replace("examples", rf"[^,]*?{SPLIT}", " ")
        return self._placed(old).withColumns({"line": F.lit(1), "col": F.lit(1), "kind": F.lit("page"), "text": F.trim(shown), "target": F.lit("")}).select(*KEYS, F.lit("stale-risk").alias("rule"), F.lit("info").alias("severity"))

    def _copies(self) -> DataFrame:
        """Lines whose newer copy has other numbers; only where it is known when lines were written."""
        docs = self.documents().select("doc", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("p", "text")).select("doc", (F.col("p") + 1).alias("line"), "text")
        dated = self._written(self._placed(docs)).filter("written IS NOT NULL").select("repo", F.col("doc"), "line", "text", F.col("written").alias("epoch"))
        # the repository stands in front of the line, in letters, so that copies meet inside of one tree
        own = F.translate(F.sha1(F.col("repo").cast("binary")), "0123456789", "ghijklmnop")
        old = documents.diverged_copies(dated.withColumn("text", F.concat(own, F.lit(" "), "text")))
        said = self._placed(old.join(docs, ["doc", "line"])).withColumns({"col": F.lit(1), "kind": F.lit("line"), "target": F.lit("")})
        return said.select(*KEYS, F.lit("copies-diverged").alias("rule"), F.lit("warning").alias("severity"))

    def _shared(self, needs: set[str]) -> dict[str, DataFrame]:
        """The tables `needs` of `rules.SHARED`, and the pages that they rest on, written once."""
        out = {"pages": staged(self.pages(), "pages")}
        if "claims" in needs:
            out["claims"] = staged(self.claims(out["pages"]), "claims")
        if "said" in needs:
            out["said"] = staged(markdown.exploded(out["pages"], "said").withColumnRenamed("text", "line_text"), "said")
        if "lines" in needs:
            out["lines"] = staged(self._placed(self._lines()).select("repo", "path", "doc", "line", "text"), "lines")
        return out

    def check(self, sure_only: bool = False, names: list[str] | None = None, lang: str = "en", groups: list[str] | None = None) -> DataFrame:
        """Findings: (repo, path, line, col, rule, severity, claim, message, fingerprint). `names`: only these rules; `groups`: only these of the registered rules (see `rules.rule`).

        The tables that they need are written once; each is planned and run by itself, some at a time, and its findings are written too.
        """
        run = rules.chosen(self, groups)
        tables = self._shared({"pages", "said", *(n for r in run for n in r.needs), *(["claims"] if self.events is not None else [])})
        pages, said = tables["pages"], tables["said"]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            found = list(pool.map(lambda r: staged(rules.findings(r, self, tables), f"found-{r.name}"), run))
        none = self.files.limit(0).select("repo", "path", F.lit(0).alias("line"), *(F.lit("").alias(c) for c in ("text", "rule", "severity")), F.lit(1).alias("col"), *(F.lit("").alias(c) for c in ("kind", "target", "own", "doc")))
        all_ = reduce(DataFrame.unionByName, found, none).withColumn("doc", F.coalesce("doc", at("path")))
        if names:
            all_ = all_.filter(F.col("rule").isin(names))
        placed = all_.withColumn("claim", F.col("text")).drop("text", "kind").join(said, ["doc", "line"], "left").withColumn("text", F.coalesce("own", "line_text", F.lit(""))).drop("own")
        judged = findings.downgraded(placed.join(self.kinds(pages).withColumnRenamed("doc_kind", "kind"), "doc", "left").withColumn("kind", F.coalesce("kind", F.lit("live"))))
        told = findings.first_of_each(judged.withColumn("fingerprint", findings.fingerprint(F.col("rule"), at("path"), F.col("claim"), F.col("text"))))
        if self.events is not None:
            told = self._without_foreign(told, tables["claims"])
        if sure_only:
            told = findings.sure_only(told)
        return told.select("repo", "path", "line", "col", "rule", "severity", "claim", messages.message(F.col("rule"), F.col("claim"), lang).alias("message"), "fingerprint")

    @staticmethod
    def _without_foreign(told: DataFrame, made: DataFrame) -> DataFrame:
        """One note instead of the broken links of a page most of whose links never led anywhere."""
        links = made.filter("kind = 'link'").groupBy("doc").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("doc", "path")
        foreign = findings.collapsed_links(told.withColumn("path", F.col("doc")), links).select(F.col("path").alias("doc"), F.col("line").alias("_line"), "never", F.lit(True).alias("foreign"))
        marked = told.join(foreign.drop("never"), "doc", "left").withColumn("_f", F.coalesce(F.col("foreign"), F.lit(False)) & (F.col("rule") == "link-broken"))
        note = marked.filter("_f AND line = _line").dropDuplicates(["doc"]).withColumns({"rule": F.lit("foreign-links"), "severity": F.lit("info")})
        return marked.filter("NOT _f").unionByName(note).drop("foreign", "_line", "_f")

    def context(self, query: str, budget: int = 2000) -> DataFrame:
        """(place, section, tokens, text): sections that answer `query` best, as many as fit into `budget` tokens; a best one larger than that is cut."""
        pages = self.pages()
        lines = self.documents().select("doc", "text").select("doc", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc", (F.col("p") + 1).cast("long").alias("line"), "text")
        heads = markdown.exploded(pages, "headings").filter("level <= 3").select("doc", F.col("line").cast("long").alias("line"), "title")
        by = Window.partitionBy("doc").orderBy("line")
        marked = lines.join(heads, ["doc", "line"], "left").withColumn("section", F.concat("doc", F.lit("#"), F.coalesce(F.max(F.when(F.col("title").isNotNull(), F.col("line"))).over(by), F.lit(1))))
        body = marked.groupBy("section", "doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
        weight = F.create_map(*(F.lit(x) for kv in documents.WEIGHTS.items() for x in kv))
        weighted = body.join(self.kinds(pages), "doc").select("section", "text", weight[F.col("doc_kind")].alias("weight"))
        ranked = documents.bm25(weighted, query).join(weighted.select("section", F.col("text").alias("body")), "section").withColumn("tokens", token_estimate(F.col("body")))
        return documents.context_texts(documents.context_pack(ranked, budget), ranked)

    def impact(self, before: DataFrame) -> DataFrame:
        """(repo, path, line, term, kind, file, note, late, text): lines of documents that tell of what the code has lost since `before` (repo, path, text: the code at an
        earlier time, null texts for what has not changed; see the table `base` of the git source). Plans are `late`; histories are not told."""
        pages = self.pages().persist()
        lines = self.documents().select("repo", "doc", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("p", "text")).select("repo", "doc", (F.col("p") + 1).alias("line"), "text")
        spans = markdown.exploded(pages, "spans").select(F.split("doc", SPLIT)[0].alias("repo"), "doc", "line", "text")
        now = self.files.filter("kind NOT IN ('doc', 'ignore') AND text IS NOT NULL").select("repo", "path", "text")
        told = impacts.impact(before, now, lines, spans).join(self.kinds(pages), "doc").filter("doc_kind <> 'history'")
        return self._placed(told).select("repo", "path", "line", "term", "kind", "file", "note", (F.col("doc_kind") == "plan").alias("late"), "text")

    def cost(self) -> DataFrame:
        return documents.cost_order(documents.agent_cost(self.files.filter("text IS NOT NULL")))


def _told_by(name: str, method: str, *needs: str, when: Callable[[Corpus], bool] = lambda corpus: True) -> None:
    """Registers a method of the corpus, which takes the tables in the order of `needs`."""
    rules.rule(name, *needs, when=when)(lambda corpus, **tables: getattr(corpus, method)(*(tables[n] for n in needs)))


_told_by("paths", "_paths", "claims", "said", "pages")
_told_by("symbols", "_symbols", "claims")
_told_by("flags", "_flags", "claims")
_told_by("commands", "_commands", "pages")
_told_by("arguments", "_arguments", "pages")
_told_by("anchors", "_anchors", "claims", "pages")
_told_by("decisions", "_decisions", "said")
_told_by("versions", "_versions", "claims", "pages")
_told_by("tables", "_tables", "pages")
_told_by("forbidden", "_forbidden", "pages")
_told_by("stale", "_stale", "claims", when=lambda corpus: corpus.events is not None)
_told_by("copies", "_copies", when=lambda corpus: corpus.blame is not None)
