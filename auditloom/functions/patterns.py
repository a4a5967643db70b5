"""Rule patterns as Spark predicates.

Rules are written for a linear-time regex dialect without look-around and
back-references, where ``.`` stops at ``\\n`` only and ``\\w \\d \\s`` are Unicode. Spark's
``rlike`` is Java's dialect. The functions here say which patterns the strict dialect
takes, and put a pattern into a form in which ``rlike`` gives the same answer.
"""

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.classes import java_pattern
from auditloom.sources.workspace import ship

# Regex flags: unix line ends only, and Unicode character classes.
UNIX_LINES = "(?d)"
UNICODE_CLASSES = "(?dU)"

# trigger.*?(?<!guard): the usual form of a guarded rule pattern.
_GUARDED = r"^(.*)\.\*\?\(\?<!(.*)\)$"


def guard_parts(pattern: Column) -> tuple[Column, Column]:
    """(trigger, guard) of a guarded pattern; guard is null where the pattern has none."""
    guarded = pattern.rlike(_GUARDED)
    trigger = F.when(guarded, F.regexp_extract(pattern, _GUARDED, 1)).otherwise(pattern)
    return trigger, F.when(guarded, F.regexp_extract(pattern, _GUARDED, 2))


_SPELLING = T.StructType([T.StructField("java", T.StringType()), T.StructField("frame", T.StringType())])


def _spelled(patterns: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if p is None else java_pattern(p) for p in patterns]
    return pd.DataFrame(rows, columns=["java", "frame"], index=patterns.index)


def _spelling(pattern: Column) -> Column:
    """Rules are few beside sources, so that their patterns may pass through Python once."""
    return F.pandas_udf(_spelled, _SPELLING)(pattern)


def with_problem(rules: DataFrame, column: str, problem: str) -> DataFrame:
    """Add a column saying why the strict dialect rejects a pattern, null if it takes it.

    A construct is searched in the frame of the pattern, where classes and escaped signs
    are out of the way.
    """
    ship(rules.sparkSession)
    pattern = F.col(column)
    staged = rules.withColumn("_spelling", _spelling(pattern)).withColumn(
        "_escapes", F.replace(pattern, F.lit("\\\\"), F.lit(""))
    )
    frame, escapes, java = F.col("_spelling.frame"), F.col("_escapes"), F.col("_spelling.java")
    # rlike raises an error on a malformed pattern; try_reflect gives null instead.
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java)
    return staged.withColumn(
        problem,
        F.when(frame.rlike(r"\(\?<?[=!]"), "look-around")
        .when(frame.rlike(r"\(\?>"), "atomic group")
        .when(frame.rlike(r"[*+?}]\+"), "possessive repeat")
        .when(escapes.rlike(r"\\[0-9k]"), "back-reference")
        .when(escapes.rlike(r"\\[CEGHIJKLMNOQRTVXYZceghijlmoqy]"), "unknown escape")
        .when(pattern.isNotNull() & compiled.isNull(), "malformed"),
    ).drop("_escapes", "_spelling")


def spark_pattern(pattern: Column) -> Column:
    """The same pattern in Java's spelling (classes, properties, group names, code points, word ends)."""
    return _spelling(pattern)["java"]


# Case-blind and spaced-out patterns, characters written by number and nested classes are
# left alone.
_UNREADABLE = re.compile(r"\(\?[a-zA-Z-]*[ix]|\\[xuUpPQ0]|\[[^\]]*\[")
_WORD = r"(?:[A-Za-z0-9_ :,'\"<>=!@#%&;/~`-]|\\[ -/:-@\[-`{-~])+"
_WORD_GROUP = re.compile(rf"\((?:\?:)?({_WORD}(?:\|{_WORD})*)\)")
_OPTIONAL = ("*", "?", "{")


def needed_words(pattern: str) -> tuple[list[str], bool]:
    """Plain words of which every match must hold one, and whether that is all it takes.

    An empty list means that nothing can be said. ``(buy|sell)`` is just its two words,
    ``invoke.*token`` needs ``token`` and ``[a-z]+@[a-z]+`` needs ``@``.
    """
    words, exact, _ = _needed(pattern)
    return words, exact


def begins_with_needed(pattern: str) -> bool:
    """Every match begins with one of the needed words, so that what stands before the first of them is of no account."""
    return _needed(pattern)[2]


def _needed(pattern: str) -> tuple[list[str], bool, bool]:
    """(needed words, whether that is all it takes, whether every match begins with one of them)."""
    if _UNREADABLE.search(pattern):
        return [], False, False
    inner = _unwrapped(pattern)
    if inner is not None:
        return _needed(inner)
    blotted = _blot(pattern)
    words, exact, first, start = [], True, True, 0
    for branch in blotted.split("|"):
        text = pattern[start:start + len(branch)]
        start += len(branch) + 1
        if re.fullmatch(_WORD, text):
            words.append(_plain(text))
            continue
        exact = False
        needed, ahead = _needed_in_sequence(text, branch)
        if not needed:
            return [], False, False
        words += needed
        first &= ahead
    # A word that holds another one adds nothing.
    least = [w for i, w in enumerate(words) if not any(o in w and (o != w or j < i) for j, o in enumerate(words))]
    return least, exact, first and all(any(w.startswith(o) for o in least) for w in words)


def _needed_in_sequence(text: str, blotted: str) -> tuple[list[str], bool]:
    """(needed words, whether a match of the text begins with one of them)."""
    group = _WORD_GROUP.match(text)
    if group and not text[group.end():].startswith(_OPTIONAL):
        return [_plain(w) for w in re.findall(_WORD, group.group(1))], True
    runs = []
    for run in re.finditer(_WORD, text):
        if "\x00" in blotted[run.start():run.end()]:
            continue
        word = run.group()
        if text[run.end():].startswith(_OPTIONAL):
            # The sign before such a repetition may be missing from a match.
            word = re.sub(r"(\\.|.)$", "", word)
        runs.append((_plain(word), run.start() == 0))
    # Of equally long words, one with digits or signs is the rarer one in most texts.
    longest, ahead = max(runs, key=lambda run: (len(run[0]), not run[0].isalpha()), default=("", False))
    return ([longest], ahead) if longest else ([], False)


def _plain(word: str) -> str:
    return re.sub(r"\\(.)", r"\1", word)


def _unwrapped(pattern: str) -> str | None:
    """What a group around the whole pattern holds; null where there is no such group."""
    opening = re.match(r"\((?:\?:)?(?!\?)", pattern)
    if not opening:
        return None
    depth = 0
    for sign in re.finditer(r"(?s)\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern):
        depth += (sign.group() == "(") - (sign.group() == ")")
        if depth == 0:
            return pattern[opening.end():-1] if sign.end() == len(pattern) else None
    return None


def _blot(pattern: str) -> str:
    """The pattern with escapes other than signs, classes, groups and counts blotted out.

    The length stays the same; escaped signs become spaces, so that only real operators
    are left as such.
    """

    def blot(match: re.Match) -> str:
        return "\x00" * len(match.group())

    flat = re.sub(r"\\[ -/:-@\[-`{-~]", "  ", pattern)
    flat = re.sub(r"\\.", blot, flat)
    flat = re.sub(r"\[\^?\]?[^\]]*\]", blot, flat)
    flat = re.sub(r"\{[^}]*\}", blot, flat)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)", blot, flat)
    return flat


def holds(text: Column, word: str) -> Column:
    """The text holds the word."""
    return F.contains(text, F.lit(word))


def any_of(tests: list[Column]) -> Column:
    """One of the tests holds, as a balanced tree, so that any number of them makes a plan."""
    if len(tests) < 3:
        return reduce(or_, tests)
    half = len(tests) // 2
    return any_of(tests[:half]) | any_of(tests[half:])


def any_word(text: Column, words: list[str], holds: Callable[[Column, str], Column] = holds) -> Column:
    """The text holds one of the words."""
    return any_of([holds(text, w) for w in words])


def matches(
    text: Column, pattern: str, unicode_classes: bool = True, holds: Callable[[Column, str], Column] = holds
) -> Column:
    """The pattern matches somewhere in the text.

    A plain search for the needed words goes first, as it is far cheaper than a regex;
    ``holds`` says how a word is searched. Rules reach the plan as literals, never as SQL
    text, so that nothing in them is expanded.
    """
    words, exact = needed_words(pattern)
    if exact:
        return any_word(text, words, holds)
    flags = UNICODE_CLASSES if unicode_classes else UNIX_LINES
    found = text.rlike(flags + pattern)
    return any_word(text, words, holds) & found if words else found


class WordFlags:
    """One search per line for each word that several tests need.

    The words become the array column ``has`` of booleans. A word that holds another one
    of them, or an underscore, is searched only in lines that have that smaller part, so
    that it needs no flag of its own.
    """

    def __init__(self, words: set[str]):
        self._gates: dict[str, str] = {}
        for word in words:
            parts = [o for o in words if o != word and o in word]
            if parts:
                self._gates[word] = max(parts, key=lambda o: (len(o), o))
            elif "_" in word and word != "_":
                self._gates[word] = "_"
        plain = {w for w in words if w not in self._gates} | set(self._gates.values()) - set(self._gates)
        self._numbers = {w: i for i, w in enumerate(sorted(plain))}

    def column(self, line: Column) -> Column:
        """The array of flags."""
        return F.array(*[holds(line, w) for w in self._numbers])

    def holds(self, line: Column, word: str) -> Column:
        """The line holds the word, by its flag."""
        if word in self._numbers:
            return F.get("has", F.lit(self._numbers[word]))
        if word in self._gates:
            return self.holds(line, self._gates[word]) & holds(line, word)
        return holds(line, word)
