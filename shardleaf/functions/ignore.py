"""Ignore rules for paths (git's syntax) as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_regex(rule: str) -> tuple[str, bool, bool] | None:
    """(pattern, keeps, folders only) of a rule; null for blank lines and comments."""
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keeps, rule = rule.startswith("!"), rule.removeprefix("!")
    folders, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    parts = re.split(r"(\*\*/|/\*\*$|\*+|\?|\[[!^]?[^\]]*\]|\\.)", rule.removeprefix("/"))
    forms = {"**/": "(?:.*/)?", "/**": "/.+", "?": "[^/]"}

    def form(part: str) -> str:
        if part in forms:
            return forms[part]
        if part.startswith("*"):
            return "[^/]*"
        if part.startswith("[") and len(part) > 2:
            return "[^" + part[2:] if part[1] in "!^" else part
        return re.escape(part[1:] if part.startswith("\\") and len(part) == 2 else part)

    return ("^" if anchored else "^(?:.*/)?") + "".join(map(form, parts)) + "$", keeps, folders


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether rules exclude a path; null for a null path.

    The last rule that matches a file decides; where none does, the last that matches its folder, and so on upwards.
    """
    compiled = [r for r in map(rule_regex, rules) if r]
    if not compiled:
        return F.when(path.isNotNull(), False)

    def decided(name: Column, whole: bool) -> Column:
        chain = F.lit(None).cast("boolean")
        for pattern, keeps, folders in compiled:  # the last one ends up outermost
            if not (whole and folders):
                chain = F.when(name.rlike(pattern), F.lit(not keeps)).otherwise(chain)
        return chain

    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    folder = F.aggregate(above, F.lit(None).cast("boolean"), lambda acc, n: F.coalesce(acc, decided(F.array_join(F.slice(parts, 1, n), "/"), False)))
    return F.when(path.isNotNull(), F.coalesce(decided(path, True), folder, F.lit(False)))
