"""Line scans: which rule matches which line.

The rules become literal predicates of one projection, so that a scan is a single pass
over the sources without any shuffle. One row per hit comes out of a generator over the
numbers of the rules that hold. Texts that hold none of the words a hit needs are not
cut into lines at all.
"""

import json
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions.patterns import WordFlags, any_of, any_word, matches, needed_words
from auditloom.functions.text import trim_unicode
from auditloom.operators import rules as rule_sets
from auditloom.operators.lines import line_array, lines

# Predicates per array expression. It bounds the size of generated code; more rules only
# mean more arrays in the same projection.
RULES_PER_ARRAY = 100


def scan_strict(sources: DataFrame, rules: DataFrame, unicode_classes: bool = True) -> DataFrame:
    """Findings of the live rules, by first pattern only: one per rule and matching line."""
    return scan_rows(sources, rule_sets.collect_live(rules), unicode_classes)


def scan_all_patterns(sources: DataFrame, rules: DataFrame, unicode_classes: bool = True) -> DataFrame:
    """Like ``scan_strict``, but a rule hits a line if any of its patterns does."""
    enabled = rule_sets.collect_all_patterns(rules)
    return scan_rows(sources, enabled, unicode_classes)


def scan_guarded(sources: DataFrame, rules: DataFrame, unicode_classes: bool = True) -> DataFrame:
    """Findings where the trigger of a rule matches a line and its guard does not."""
    guarded = rule_sets.collect_guarded(rules)

    def test(rule: Row, flags: WordFlags) -> Column:
        hit = matches(F.col("line"), rule.trigger, unicode_classes, flags.holds)
        if rule.guard is not None:
            hit = hit & ~matches(F.col("line"), rule.guard, unicode_classes)
        return hit

    return _scan(sources, guarded, _guarded_key, test, lambda rule: [rule.trigger], lines)


def scan_context(
    sources: DataFrame, rules: DataFrame, reach: int, unicode_classes: bool = True
) -> DataFrame:
    """Like ``scan_guarded``, with the guard also looked for up to ``reach`` lines away.

    Every line carries its neighbours, taken from the text it was cut from, so that no
    window and no shuffle by source is needed, however long a source is.
    """
    guarded = rule_sets.collect_guarded(rules)

    def test(rule: Row, flags: WordFlags) -> Column:
        hit = matches(F.col("line"), rule.trigger, unicode_classes, flags.holds)
        if rule.guard is not None:
            hit = hit & ~F.exists("around", lambda near: matches(near, rule.guard, unicode_classes))
        return hit

    return _scan(
        sources, guarded, _guarded_key, test, lambda rule: [rule.trigger],
        lambda texts, gate: _lines_with_neighbours(texts, gate, reach),
    )


def _guarded_key(rule: Row) -> Hashable:
    return rule.trigger, rule.guard


def _lines_with_neighbours(sources: DataFrame, gate: Column, reach: int) -> DataFrame:
    cut = sources.select("program", "source_seq", "path", line_array(gate).alias("all_lines"))

    def with_neighbours(line: Column, pos: Column) -> Column:
        first = F.greatest(pos + 1 - reach, F.lit(1))
        return F.struct(
            (pos + 1).cast("bigint").alias("line_number"),
            line.alias("line"),
            F.slice("all_lines", first, pos + 2 + reach - first).alias("around"),
        )

    return cut.select("program", "source_seq", "path", F.inline(F.transform("all_lines", with_neighbours)))


def scan_rows(sources: DataFrame, rules: list[Row], unicode_classes: bool) -> DataFrame:
    """Findings of collected rules: a line is hit if one of a rule's ``tests`` matches it."""

    def key(rule: Row) -> Hashable:
        return tuple(sorted(rule.tests))

    def test(rule: Row, flags: WordFlags) -> Column:
        return any_of([matches(F.col("line"), p, unicode_classes, flags.holds) for p in key(rule)])

    return _scan(sources, rules, key, test, lambda rule: rule.tests, lines)


def _scan(
    sources: DataFrame,
    rules: list[Row],
    key: Callable[[Row], Hashable],
    test: Callable[[Row, WordFlags], Column],
    patterns: Callable[[Row], list[str]],
    to_lines: Callable[[DataFrame, Column], DataFrame],
) -> DataFrame:
    """One finding per rule and line for which the rule's test holds.

    Rules with one ``key`` have the same test. ``patterns`` are those of which a hit of the
    rule matches at least one.
    """
    words = [needed_words(p)[0] for rule in rules for p in patterns(rule)]
    needed = sorted({w for ws in words for w in ws})
    # Texts are passed by only if every rule has words that a hit of it needs.
    if words and all(words):
        needed = [w for w in needed if not any(o in w for o in needed if o != w)]
        gate = any_word(F.col("code"), needed)
    else:
        gate = F.lit(True)
    texts = to_lines(sources, gate)
    flags = WordFlags({w for rule in rules for p in patterns(rule) for w in needed_words(p)[0]})
    texts = texts.withColumn("has", flags.column(F.col("line")))
    # Rules with the same test are tried once.
    alike: dict[Hashable, list[int]] = {}
    for number, rule in enumerate(rules):
        alike.setdefault(key(rule), []).append(number)
    held = [F.when(test(rules[numbers[0]], flags), F.lit(numbers)) for numbers in alike.values()]
    chunks = [
        F.flatten(F.array_compact(F.array(*held[i:i + RULES_PER_ARRAY])))
        for i in range(0, len(held), RULES_PER_ARRAY)
    ] or [F.array().cast("array<int>")]
    # The numbers are worked out in a projection, whose code Spark splits into small methods.
    # They sit in a struct because a generator over a bare column would bring in a filter on
    # its size, pushed below the projection and so working everything out twice.
    hits = F.struct(F.concat(*chunks).alias("numbers"))
    place = ["program", "source_seq", "path", "line_number", "line"]
    found = texts.select(*place, hits.alias("hits")).select(*place, F.explode("hits.numbers").alias("number"))
    texts_of_rules = F.from_json(F.lit(json.dumps([rule_text(r) for r in rules])), _RULE_TEXTS)
    return found.withColumn("rule", F.get(texts_of_rules, "number")).select(*finding_columns(F.col("rule")))


def finding_columns(rule: Column | dict[str, Column], code_snippet: Column | None = None) -> list[Column]:
    """The columns of findings, from the columns of lines and a struct, or columns, with the text of a rule."""
    return [
        F.col("program"),
        F.col("source_seq"),
        F.lit(schemas.ANALYZER_REGEX).alias("analyzer"),
        rule["rule_seq"].alias("rule_seq"),
        F.col("line_number").alias("item_seq"),
        rule["rule_id"].alias("rule_id"),
        rule["rule_id"].alias("vuln_type"),
        rule["severity"].alias("severity"),
        rule["message"].alias("message"),
        rule["mitigation"].alias("mitigation"),
        F.col("line_number"),
        (trim_unicode(F.col("line")) if code_snippet is None else code_snippet).alias("code_snippet"),
        F.col("path").alias("file_path"),
    ]


_RULE_TEXTS = (
    "array<struct<rule_seq: int, rule_id: string, severity: string, message: string, mitigation: string>>"
)


def rule_text(rule: Row) -> dict:
    return {
        "rule_seq": rule.rule_seq, "rule_id": rule.id, "severity": rule.severity, "message": rule.description,
        "mitigation": rule.mitigation,
    }
