"""What front matter declares: languages, conditions and tags, with advice on what is probably a mistake."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shardleaf.functions import text as T
from shardleaf.functions.languages import TOKENS

CONDITION, CONDITION_KEYS = "applies_when", ("tools", "bash_command_starts_with")
UNIVERSAL = "universal"


def _top_level(front: Column, key: str) -> Column:
    """What stands behind a key in the first column and on the indented or listed lines below it; null where there is no such key."""
    found = F.regexp_extract(front, rf"(?m)^{key}:([^\n]*(?:\n(?:[ \t]+|- )[^\n]*)*)", 1)
    return F.when(front.rlike(rf"(?m)^{key}:"), found)


def language_list(front: Column) -> Column:
    """Languages that front matter declares, lower-cased: one word, a flow list or a block list; an empty array for none.

    Values with a comma or a control character are left out.
    """
    value = _top_level(front, "language")
    head, below = F.trim(F.regexp_extract(value, r"\A([^\n]*)", 1)), F.regexp_replace(value, r"\A[^\n]*\n?", "")
    flow = F.regexp_extract(head, r"\[([^\]]*)\]", 1)
    block = F.filter(F.split(F.regexp_extract(below, r"\A((?:(?:  -|- )[^\n]*(?:\n|\z))*)", 1), "\n"), lambda x: x != "")
    items = F.when(head == "", F.transform(block, lambda x: F.regexp_replace(x, r"^[ -]+", ""))).when(head.rlike(r"\[[^\]]*\]"), F.split(flow, ",")).otherwise(F.array(head))
    clean = F.transform(items, lambda x: F.lower(T.strip_quotes(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))
    return F.coalesce(F.filter(clean, lambda x: (x != "") & ~x.rlike(r"[,\p{Cntrl}]")), F.array().cast("array<string>"))


def unknown_languages(languages: Column) -> Column:
    return F.array_except(languages, F.array(*map(F.lit, TOKENS)))


def near_miss_tags(tags: Column, wanted: str = UNIVERSAL) -> Column:
    """Tags that are probably meant to be ``wanted``: in other case, or of the same length with characters beyond ASCII."""
    low = lambda x: F.lower(x)
    return F.filter(tags, lambda x: (x != wanted) & ((low(x) == wanted) | (low(x).rlike(r"[^\x00-\x7F]") & (F.char_length(low(x)) == len(wanted)))))


def near_miss_key(front: Column, wanted: str = CONDITION) -> Column:
    """The first key of the first column that is probably meant to be ``wanted``; null for none."""
    keys = F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):"), 1)
    close = F.filter(keys, lambda k: T.near_miss(k, wanted) | ((k != wanted) & F.lower(k).startswith(wanted.split("_")[0])))
    return F.get(close, F.lit(0))


def read_condition(front: str | None) -> tuple[dict[str, list[str]] | None, list[str]]:
    """(condition, advice) of the condition block of front matter.

    Keys stand two blanks in, list items four; both may be a flow list. A tab, a value beside the block's own key, a
    scalar and an unknown key bring advice; without any known key there is no condition.
    """
    lines = (front or "").splitlines()
    at = next((i for i, line in enumerate(lines) if line.startswith(f"{CONDITION}:")), None)
    if at is None:
        return None, []
    if lines[at][len(CONDITION) + 1 :].strip():
        return None, ["expected keys below, not a value"]
    found: dict[str, list[str]] = {}
    advice: list[str] = []
    key = None
    for line in lines[at + 1 :]:
        if line.strip() and not line.startswith((" ", "\t")):
            break
        if "\t" in line[: len(line) - len(line.lstrip())]:
            return None, ["indented by a tab"]
        entry = re.match(r"  ([A-Za-z_][\w-]*):\s*(.*?)\s*$", line)
        item = re.match(r"    -\s*(.*?)\s*$", line)
        if entry:
            key, value = entry.groups()
            if key not in CONDITION_KEYS:
                advice.append(f"unknown key {key}")
                key = None
            elif value.startswith("[") and value.endswith("]"):
                found[key] = [x for x in (_unquoted(v.strip()) for v in value[1:-1].split(",")) if x]
            elif value:
                advice.append(f"{key} is no list")
                key = None
            else:
                found[key] = []
        elif item and key:
            found[key] += [x for x in [_unquoted(item[1])] if x]
        elif line.strip():
            advice.append("unexpected line")
    return (found or None), advice


def _unquoted(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def condition(front: Column) -> Column:
    """``condition`` (JSON, null for none) and ``advice`` of front matter; a key that is nearly right takes the condition's place."""

    @F.pandas_udf("lists struct<tools: array<string>, bash_command_starts_with: array<string>>, advice array<string>")
    def parse(values: pd.Series) -> pd.DataFrame:
        rows = [read_condition(v) for v in values]
        return pd.DataFrame({"lists": [None if c is None else {k: c.get(k) for k in CONDITION_KEYS} for c, _ in rows], "advice": [a for _, a in rows]})

    missed = near_miss_key(front)
    read = parse(front)
    wrong = F.array(F.concat(F.lit("unknown key "), missed, F.lit(", meant as " + CONDITION)))
    return F.struct(F.when(missed.isNull(), F.to_json(read["lists"])).alias("condition"), F.when(missed.isNotNull(), wrong).otherwise(read["advice"]).alias("advice"))
