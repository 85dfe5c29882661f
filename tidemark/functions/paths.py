"""Path arithmetic on columns of forward-slash paths, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case ending from the last dot of the name, the dot included; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def suffixes(path: Column) -> Column:
    """All endings of a path that begin at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """Folders that hold a path, nearest first, the root (empty) last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normalise(path: Column) -> Column:
    """Resolves `.`, `..` and doubled slashes of a relative path; `..` that leave the root stay in front."""

    def step(kept: Column, part: Column) -> Column:
        n = F.size(kept)
        inside = (n > 0) & (F.element_at(F.concat(F.array(F.lit("..")), kept), -1) != "..")
        return F.when(part.isin("", "."), kept).when((part == "..") & inside, F.slice(kept, 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    walked = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    # most paths have no such segment and are looked at once
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), walked).otherwise(path)


def joined(folder: Column, path: Column) -> Column:
    return normalise(F.concat_ws("/", folder, path))


def relative(target: Column, folder: Column) -> Column:
    """`target` as seen from `folder`."""
    to, base = F.filter(F.split(target, "/"), lambda x: x != ""), F.filter(F.split(folder, "/"), lambda x: x != "")
    most = F.least(F.size(to), F.size(base))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= most) & (F.get(to, i - 1) == F.get(base, i - 1)), i).otherwise(n))
    up = F.array_repeat(F.lit(".."), F.size(base) - shared)
    return F.array_join(F.concat(up, F.slice(to, shared + 1, F.size(to))), "/")


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a glob: `*` and `?` stay in a segment, `**` crosses them; a leading slash anchors; a name without a slash matches at any depth; a folder matches all below it. Letter case does not count."""
    text = pattern.strip().replace("\\", "/")
    anchored, inner = text.startswith("/"), text.lstrip("/")
    free = not anchored and "/" not in text.strip("/")
    if inner.endswith("/"):
        inner += "**"
    out, rest = "", inner
    while rest:
        if rest.startswith("**/"):
            out, rest = out + "(?:.*/)?", rest[3:]
        elif rest.startswith("**"):
            out, rest = out + ".*", rest[2:]
        else:
            c, rest = rest[0], rest[1:]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "_-/ " else "\\" + c)
    return f"(?iu)^{'(?:.*/)?' if free else ''}{out}(?:/.*)?$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out
