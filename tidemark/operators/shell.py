"""Command lines: splitting into words and simple commands, and what they run."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Options of `git clone` that take a value.
CLONE_VALUES = "-b --branch --depth -o --origin -c --config --template --reference --separate-git-dir".split()
TOKEN = re.compile(r"\"[^\"]*\"?|'[^']*'?|\S")


def argv(line: str) -> list[str]:
    """Words of a command line; quotes hold words together, there are no escapes."""
    words, now, open_, at = [], "", False, 0
    for m in TOKEN.finditer(line):
        if line[at : m.start()].strip() == "" and m.start() > at and (now or open_):
            words.append(now)
            now, open_ = "", False
        t = m.group()
        if t[0] in "\"'":
            now, open_ = now + t[1:].removesuffix(t[0]), True
        else:
            now += t
        at = m.end()
    return [*words, now] if now or open_ else words


def simple_commands(line: str) -> list[str]:
    """Parts of a compound line between &&, ||, ; and |, outside of quotes."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group())
        return f"\x00{len(held) - 1}\x00"

    plain = re.sub(r"\"[^\"]*\"?|'[^']*'?", hold, line)
    parts = re.split(r"&&|\|\||;|(?<!>)\|", plain)
    return [p.strip() for p in (re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], p) for p in parts) if p.strip()]


def clone_folder(words: list[str]) -> str:
    """The folder that `git clone ...` makes: the one it names, else the last name of the address."""
    named, value = [], False
    for w in words[2:]:
        if not value and not w.startswith("-"):
            named.append(w)
        value = not value and w in CLONE_VALUES
    if not named:
        return ""
    last = named[1] if len(named) > 1 else re.split("[/:]", named[0].rstrip("/"))[-1].removesuffix(".git")
    return last.rstrip("/").removeprefix("./")


def entered_clones(lines: list[str]) -> list[str]:
    """Clones that the lines of a block make and later enter."""
    made, out = set(), []
    for line in lines:
        for part in simple_commands(re.sub(r"(?:^|\s)#.*$", "", line)):
            words = argv(part)
            if words[:2] == ["git", "clone"]:
                made.add(clone_folder(words))
            elif words[:1] in (["cd"], ["Set-Location"], ["pushd"]) and len(words) > 1 and (name := words[-1].rstrip("/").removeprefix("./")) in made - {""}:
                out.append(name)
    return out


def commands(lines: list[str]) -> list[dict]:
    """What the lines of a shell block run: continuation lines are joined, `cd` moves the folder of later lines, assignments and sudo are skipped."""
    out, folder, joined, cloned = [], "", "", ""
    for line in lines:
        joined += line.rstrip()
        if joined.endswith(("\\", "`", "^")):
            joined = joined[:-1] + " "
            continue
        for part in simple_commands(re.sub(r"(?:^|\s)#.*$", "", joined)):
            words = argv(part)
            while words and (words[0] == "sudo" or re.fullmatch(r"[A-Za-z_]\w*=\S*", words[0])):
                words = words[1:]
            if words and words[0] == "cd":
                target = (words[1:] or [""])[0]
                # the folder that a clone makes is the tree itself
                folder = "" if target.rstrip("/") == cloned and cloned else target if target.startswith("/") or not folder else f"{folder}/{target}"
            elif words[:2] == ["git", "clone"]:
                cloned = clone_folder(words)
            elif words:
                out.append(describe(words) | {"folder": folder})
        joined = ""
    return out


def describe(words: list[str]) -> dict:
    """(tool, kind, target, flags, first): the script, module, package script or make target that a command runs, its options, and the word right behind it."""
    tool, rest = re.sub(r"\.exe$", "", words[0]), words[1:]
    flags = [w.split("=", 1)[0] for w in rest if w.startswith("--") and len(w) > 2]
    plain = [w for w in rest if not w.startswith("-")]
    kind, target = "command", tool
    if re.fullmatch(r"python[\d.]*|py", tool):
        if "-m" in rest and rest.index("-m") + 1 < len(rest):
            kind, target = "module", rest[rest.index("-m") + 1]
        elif "-c" not in rest and plain:
            kind, target = "path", plain[0]
    elif tool in ("npm", "pnpm", "yarn", "bun") and rest:
        run = rest[1:] if rest[0] == "run" else rest if tool in ("yarn", "bun") or rest[0] in ("test", "start") else []
        kind, target = ("npm", run[0]) if run else (kind, target)
    elif tool in ("make", "just"):
        named = [w for w in plain if "=" not in w]
        kind, target = ("make", named[0]) if named else (kind, target)
    elif tool in ("node", "bash", "sh", "zsh", "pwsh") and plain:
        kind, target = "path", plain[0]
    elif tool == "pytest" and plain:
        kind, target = "path", plain[0].split("::")[0]
    elif tool.startswith("./"):
        kind, target = "path", tool[2:]
    behind = rest[rest.index(target) + 1 :] if target in rest else rest if kind == "path" else []
    first = behind[0] if behind and re.fullmatch(r"[A-Za-z][\w-]*", behind[0]) else ""
    return {"tool": tool, "kind": kind, "target": target, "flags": flags, "first": first}


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_argv(line: pd.Series) -> pd.Series:
    return line.map(lambda x: argv(x or ""))


def block_commands(fences, lang_pattern: str = r"^(?:|sh|bash|shell|console|zsh|powershell|cmd|bat)$"):
    """(doc, start, tool, kind, target, flags, first, folder): what the shell blocks of `fences` (doc, start, lang, lines) run."""

    def of(batches):
        for batch in batches:
            rows = [{"doc": d, "start": s} | c for d, s, lines in zip(batch["doc"], batch["start"], batch["lines"], strict=True) for c in commands([x["text"] for x in lines])]
            if rows:
                yield pd.DataFrame(rows)[["doc", "start", "tool", "kind", "target", "flags", "first", "folder"]]

    return fences.filter(F.col("lang").rlike(lang_pattern)).select("doc", "start", "lines").mapInPandas(of, "doc string, start int, tool string, kind string, target string, flags array<string>, first string, folder string")


def entered(fences, lang_pattern: str = r"^(?:|sh|bash|shell|console|zsh|powershell|cmd|bat)$"):
    """(doc, folder): clones that the pages have their readers enter; a clone of one block may be entered in a later one."""

    def of(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        lines = [x["text"] for block in page.sort_values("start")["lines"] for x in block]
        return pd.DataFrame([(key[0], name) for name in dict.fromkeys(entered_clones(lines))], columns=["doc", "folder"])

    shells = fences.filter(F.col("lang").rlike(lang_pattern)).filter(F.exists("lines", lambda x: F.contains(x["text"], F.lit("clone"))) | F.exists("lines", lambda x: F.contains(x["text"], F.lit("cd ")) | F.contains(x["text"], F.lit("Set-Location"))))
    return shells.select("doc", "start", "lines").groupBy("doc").applyInPandas(of, "doc string, folder string")
