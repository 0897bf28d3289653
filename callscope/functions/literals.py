"""What every match of a pattern must contain, so that patterns meet texts by key instead of one by one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from callscope.functions.sig import wildcard_to_regex

#: Letters of a key. A text's keys are all its runs of so many letters, and the empty key.
KEY = 3


def _alternatives(pattern: str) -> list[str] | None:
    """The pattern's branches outside of brackets, or None where they can't be told."""
    depth, start, out, i = 0, 0, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
            if i < 0:
                return None
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]] if depth == 0 else None


def _class_end(pattern: str, at: int) -> int:
    """The place of the ] that ends a class of characters; -1 for one that is nested or has no end."""
    i = at + 1 + (pattern[at + 1 : at + 2] == "^")
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            return -1
        elif pattern[i] == "]" and i > at + 1:
            return i
        i += 1
    return -1


def _longest(branch: str) -> str:
    """The longest run of plain characters that every match of a branch has; what stands in groups and classes is passed over."""
    runs, run, i, depth = [""], "", 0, 0
    while i < len(branch):
        c, plain = branch[i], None
        if c == "\\":
            i += 1
            plain = branch[i] if i < len(branch) and not branch[i].isalnum() else None
        elif c == "[":
            i = max(i, _class_end(branch, i))
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{":
            i = max(i, branch.find("}", i))
        elif c not in ".^$*+?|)":
            plain = c
        follows = branch[i + 1 : i + 2]
        if plain is None or depth:
            runs.append(run)
            run = ""
        elif follows and follows in "*?{":  # may be absent
            runs.append(run)
            run = ""
        else:
            run += plain
        i += 1
    return max([*runs, run], key=len)


def required_keys(pattern: str | None) -> list[str]:
    """Keys of which a text that the pattern is found in has at least one; [''] if there are no such keys but that one.

    Each branch gives the first letters of its longest run of plain characters. Patterns with flags, quotations or
    nested classes, and branches without a long run, give the empty key, which every text has.
    """
    if not pattern or "(?" in pattern or "\\Q" in pattern or "\\" in pattern and any(pattern[i + 1 : i + 2].isalnum() and pattern[i + 1] not in "dDwWsSbB" for i, c in enumerate(pattern) if c == "\\"):
        return [""]
    while pattern.startswith("(") and pattern.endswith(")") and _alternatives(pattern[1:-1]) is not None and "(" not in pattern[1:] and not pattern.endswith("\\)"):
        pattern = pattern[1:-1]
    branches = _alternatives(pattern)
    runs = [_longest(b) for b in branches] if branches else [""]
    return [""] if any(len(r) < KEY for r in runs) else sorted({r[:KEY] for r in runs})


@F.pandas_udf(ArrayType(StringType()))
def pattern_keys(patterns: pd.Series) -> pd.Series:
    """required_keys() of a column of patterns: for tables of rules, not of texts."""
    return patterns.map(required_keys)


@F.pandas_udf(StringType())
def wildcard_regexes(patterns: pd.Series) -> pd.Series:
    """wildcard_to_regex() of a column of wildcard patterns."""
    return patterns.map(lambda p: None if p is None else wildcard_to_regex(p))


def text_keys(text: Column) -> Column:
    """All keys of a text, each once."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), n - KEY + 1), lambda i: F.substring(text, i, KEY))
    return F.when(n >= KEY, F.array_distinct(F.concat(F.array(F.lit("")), runs))).otherwise(F.array(F.lit("")))


def is_pattern(pattern: Column) -> Column:
    """Whether the regex engine behind rlike() accepts a pattern; null patterns are none."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()
