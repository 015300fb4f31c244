"""Phonetic codes from a table of rules.

A rule's pattern is letters, then at most one ``(set)`` of letters, then marks:
``-`` for each matched letter that is looked at but not consumed, ``<`` to read
the replacement again as text, a digit for the priority (5 if absent), ``^`` for
the start of a word, ``^^`` also to begin a new word after it, ``$`` for the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The format's priority of rules without one, and its longest word in bytes.
PRIORITY, MOST_BYTES = 5, 256
PATTERN = re.compile(r"([^(\-<^$0-9]+)(?:\(([^)]*)\))?(-*)(<?)([0-9]?)(\^{0,2})(\$?)")


@dataclass(frozen=True)
class Rule:
    letters: str
    choice: str
    kept: int
    again: bool
    priority: int
    start: bool
    restart: bool
    end: bool
    out: str

    def reach(self, text: str, at: int) -> int:
        """Where the letters end if they stand at a place, else -1."""
        stop = at + len(self.letters)
        if not text.startswith(self.letters, at):
            return -1
        if self.choice:
            return stop + 1 if text[stop : stop + 1] and text[stop] in self.choice else -1
        return stop


def parse_rule(pattern: str, out: str) -> Rule | None:
    m = PATTERN.fullmatch(pattern)
    if not m:
        return None
    letters, choice, kept, again, priority, start, end = m.groups()
    return Rule(letters, choice or "", len(kept), bool(again), int(priority or PRIORITY), start != "", start == "^^", bool(end), out)


@lru_cache(maxsize=16)
def compiled(table: tuple[tuple[str, str], ...]) -> dict[str, list[Rule]]:
    """Rules by first letter, in the order of the table."""
    found: dict[str, list[Rule]] = {}
    for pattern, out in table:
        if rule := parse_rule(pattern, out):
            found.setdefault(rule.letters[0], []).append(rule)
    return found


def inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalpha()


def applies(rule: Rule, text: str, at: int, stop: int) -> bool:
    if rule.start and inside(text, at - 1):
        return False
    if rule.end and inside(text, stop):
        return False
    # An end mark alone asks for a letter before.
    return not rule.end or rule.start or inside(text, at - 1)


def yields(rules: dict[str, list[Rule]], rule: Rule, text: str, stop: int) -> bool:
    """Whether a rule that starts at the last letter matched reaches further with no lower priority, so that this one waits."""
    for other in rules.get(text[stop - 1], ()):
        end = other.reach(text, stop - 1)
        if end > stop and not other.start and not (other.end and inside(text, end)) and other.priority >= rule.priority:
            return True
    return False


def choose(rules: dict[str, list[Rule]], text: str, at: int) -> tuple[Rule, int] | None:
    """The first rule that holds at a place, with the number of letters it consumes."""
    for rule in rules.get(text[at], ()):
        stop = rule.reach(text, at)
        if stop < 0 or not applies(rule, text, at, stop):
            continue
        used = max(stop - at - rule.kept, 1)
        if used > 1 and not rule.kept and stop < len(text) and yields(rules, rule, text, stop):
            continue
        return rule, used
    return None


def encode(word: str, table: tuple[tuple[str, str], ...]) -> str:
    """The code of a word in the table's case; letters without a rule that holds give nothing."""
    if len(word.encode()) > MOST_BYTES:
        return ""
    rules, text, at, most, reread = compiled(table), word, 0, len(word), False
    out: list[str] = []
    while at < len(text):
        found = choose(rules, text, at)
        if found is None:
            at, reread = at + 1, False
            continue
        rule, used = found
        if rule.again and not reread:
            if out and rule.out and out[-1] in (text[at], rule.out[0]):
                out.pop()
            fresh = rule.out[: len(text) - at]
            text = text[:at] + fresh + text[at + max(used, len(fresh)) :]
            reread = True
            continue
        reread = False
        for c in rule.out[:-1]:
            if len(out) < most and (not out or out[-1] != c):
                out.append(c)
        if rule.restart:
            out.extend(rule.out[-1:])
            text, at = text[at + used :], 0
            continue
        if rule.out and not rule.again and len(out) < most:
            out.append(rule.out[-1])
        at += used
    return "".join(out)


def coder(table: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """The code of a column of words; null stays null."""
    fixed = tuple(tuple(row) for row in table)

    @pandas_udf("string")
    def code(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else encode(w, fixed))

    return code
