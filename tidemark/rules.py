"""An open registry of rules. A rule declares which shared tables it needs; `Corpus.check` writes these once, then plans and runs each rule by itself and appends its findings.

    @rule("long-lines", "lines", says={"long-line": ("the line is long: {}", "dòng dài: {}")})
    def long_lines(corpus, lines):
        return lines.filter("length(text) > 200").selectExpr("repo", "path", "line", "left(text, 20) AS text", "'long-line' AS rule", "'info' AS severity")

A rule is called with the corpus and its tables by name and returns findings: repo, path, line, text (what is told of), rule, severity; perhaps col (else 1), kind, target, own (the line
that the fingerprint is taken of, where it is not that of the page) and doc (the page by which it is told, if not its own). Rows whose repo, path, line, rule or severity is null are refused when they are read. A rule that finds nothing returns no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import messages

#: Tables that rules may ask for: pages (see `markdown.scan`), claims (`Corpus.claims`), said (doc, line, line_text), lines (repo, path, doc, line, text).
SHARED = ("pages", "claims", "said", "lines")
NEEDED = ("repo", "path", "line", "text", "rule", "severity")
#: What else a finding may have, with the value of those that do not.
OPTIONAL = {"col": 1, "kind": "line", "target": "", "own": None, "doc": None}


@dataclass(frozen=True)
class Rule:
    """`find` is called with the corpus and the tables `needs`; `when` says whether the corpus has what the rule rests on, such as a history."""

    name: str
    find: Callable[..., DataFrame]
    needs: tuple[str, ...]
    when: Callable[[object], bool]


_RULES: dict[str, Rule] = {}


def rule(name: str, *needs: str, when: Callable[[object], bool] = lambda corpus: True, says: dict[str, tuple[str, str]] | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a rule under a name that is free; `says` gives messages in English and Vietnamese for what it tells, {} being the text."""
    unknown = [n for n in needs if n not in SHARED]
    if unknown:
        raise ValueError(f"no shared table {', '.join(unknown)}; there are {', '.join(SHARED)}")

    def add(find: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        taken = set(says or {}) & set(messages.MESSAGES)
        if name in _RULES or taken:
            raise ValueError(f"already registered: {name if name in _RULES else ', '.join(sorted(taken))}")
        _RULES[name] = Rule(name, find, needs, when)
        messages.MESSAGES.update(says or {})
        return find

    return add


def forget(name: str, *told: str) -> None:
    """Takes a rule, and the messages of what it `told`, out again."""
    del _RULES[name]
    for t in told:
        messages.MESSAGES.pop(t, None)


def chosen(corpus: object, names: Iterable[str] | None = None) -> list[Rule]:
    """The rules `names`, or all, that the corpus has what they rest on for; an unknown name is an error."""
    wanted = list(_RULES) if names is None else list(dict.fromkeys(names))
    unknown = [n for n in wanted if n not in _RULES]
    if unknown:
        raise ValueError(f"no rule {', '.join(unknown)}; there are {', '.join(_RULES)}")
    return [_RULES[n] for n in wanted if _RULES[n].when(corpus)]


def findings(of: Rule, corpus: object, tables: dict[str, DataFrame]) -> DataFrame:
    """What a rule finds, in the columns of all findings."""
    found = of.find(corpus, **{n: tables[n] for n in of.needs})
    lacking = [c for c in NEEDED if c not in found.columns]
    if lacking:
        raise ValueError(f"rule {of.name} returns no {', '.join(lacking)}")
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"rule {of.name}: {c} is null")))
    kept = [F.col(c) if c == "text" else sure(c).alias(c) for c in NEEDED]
    more = [(F.col(c) if c in found.columns else F.lit(v)).cast("int" if c == "col" else "string").alias(c) for c, v in OPTIONAL.items()]
    return found.select(*kept, *more).withColumn("line", F.col("line").cast("int"))
