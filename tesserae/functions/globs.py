"""Path globs as anchored regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a step, ``[!x]`` a class; ``dir/**`` also matches dir."""
    if glob.endswith("/**"):
        return glob_regex(glob[:-3])[:-1] + "(?:/.*)?$"
    out, k = "^", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, k = out + ("\\" + c if c in ".^$+{}()|[]\\" else c), k + 1
    return out + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return reduce(Column.__or__, (path.rlike(glob_regex(g)) for g in globs), F.lit(False))


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    return matches_any(path, include) & ~matches_any(path, exclude)


def ignore_rules(lines: list[str], base: str = "") -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) for each rule of an ignore file, in order; a later rule wins."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.removeprefix("!")
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        inner = glob_regex(rule.lstrip("/"))[1:-1]
        start = f"^{base}" if anchored else f"^{base}(?:.*/)?"
        out.append((start + inner + ("/.*$" if folder else "(?:/.*)?$"), not keep))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, ignores in rules:
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def classify(path: Column, rules: list[tuple[str, str]], otherwise: str, head: Column | None = None, generated: tuple[str, ...] = ("@generated", "DO NOT EDIT")) -> Column:
    """The class of the first rule (glob, class) whose glob matches; heads marked as generated come first, binary heads over all."""
    out = F.lit(otherwise)
    for glob, name in reversed(rules):
        out = F.when(path.rlike(glob_regex(glob)), F.lit(name)).otherwise(out)
    if head is not None:
        marked = reduce(Column.__or__, (F.contains(head, F.lit(m)) for m in generated))
        out = F.when(marked, F.lit("generated")).otherwise(out)
        out = F.when(F.contains(head, F.lit("\x00")), F.lit("binary")).otherwise(out)
    return out
