"""Which rules run, which do not, and why."""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from auditloom.functions.patterns import guard_parts, spark_pattern, with_problem

def with_state(rules: DataFrame) -> DataFrame:
    """Rules with their first pattern and state: live, disabled, no pattern, unsupported."""
    first = rules.withColumn("pattern", F.try_element_at("patterns", F.lit(1)))
    return with_problem(first, "pattern", "problem").withColumn(
        "state",
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("pattern").isNull(), "no pattern")
        .when(F.col("problem").isNotNull(), "unsupported")
        .otherwise("live"),
    )


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules that the strict scan runs: enabled, with a first pattern that compiles."""
    return (
        with_state(rules)
        .where(F.col("state") == "live")
        .select("rule_seq", "id", "description", "severity", "pattern", "mitigation")
    )


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Rules that the strict scan leaves out, with the reason."""
    return (
        with_state(rules)
        .where(F.col("state") != "live")
        .select(
            "rule_seq", "id", "state",
            F.when(F.col("state") == "unsupported", F.col("problem")).alias("problem"),
        )
    )


def pattern_states(rules: DataFrame) -> DataFrame:
    """One row per rule and pattern: what each kind of scan does with it, and why not more.

    ``strict`` and ``guarded`` try first patterns only, ``every`` tries all. A state is
    live, disabled, unused or unsupported; ``problem`` is that of the whole pattern,
    ``guarded_problem`` that of its trigger or guard. A rule without a pattern has one row
    with number 0 and the state "no pattern".
    """
    each = rules.select("rule_seq", "id", "enabled", F.posexplode_outer("patterns").alias("pos", "pattern"))
    trigger, guard = guard_parts(F.col("pattern"))
    checked = each.withColumns({"trigger": trigger, "guard": guard})
    for column, problem in (("pattern", "problem"), ("trigger", "trigger_problem"), ("guard", "guard_problem")):
        checked = with_problem(checked, column, problem)

    def state(problem: str, first_only: bool) -> Column:
        unused = (F.col("pos") > 0) & F.lit(first_only)
        return (
            F.when(~F.col("enabled"), "disabled")
            .when(F.col("pattern").isNull(), "no pattern")
            .when(unused, "unused")
            .when(F.col(problem).isNotNull(), "unsupported")
            .otherwise("live")
        )

    checked = checked.withColumn("guarded_problem", F.coalesce("trigger_problem", "guard_problem"))
    return checked.select(
        "rule_seq", "id", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("pattern_no"), "pattern",
        state("problem", True).alias("strict"), state("problem", False).alias("every"),
        state("guarded_problem", True).alias("guarded"), "problem", "guarded_problem",
    )


def lint_rules(rules: DataFrame) -> DataFrame:
    """One row per rule: state, patterns that are never tried, rules sharing its pattern."""
    stated = with_state(rules).select(
        "rule_seq", "id", "pattern", "state", "problem",
        F.greatest(F.size("patterns") - 1, F.lit(0)).alias("unused_patterns"),
    )
    # Counted before joining back, so that a pattern common to many rules stays one row.
    shared = (
        rules.select(F.try_element_at("patterns", F.lit(1)).alias("pattern"))
        .where(F.col("pattern").isNotNull())
        .groupBy("pattern")
        .agg((F.count("*") - 1).alias("same_pattern"))
    )
    return stated.join(shared, "pattern", "left").select(
        "rule_seq", "id", "state",
        F.when(F.col("state") == "unsupported", F.col("problem")).alias("problem"),
        "unused_patterns",
        F.coalesce("same_pattern", F.lit(0)).alias("same_pattern"),
    )


def last_rule_texts(rules: DataFrame) -> DataFrame:
    """Rule texts by id; the last of several rules with one id counts, enabled or not."""
    text = F.struct("description", "severity", "mitigation")
    return (
        rules.groupBy(F.col("id").alias("rule_id"))
        .agg(F.max_by(text, "rule_seq").alias("text"))
        .select("rule_id", "text.description", "text.severity", "text.mitigation")
    )


def collect_live(rules: DataFrame) -> list[Row]:
    """Live rules, on the driver, each with its ``tests``: the first pattern only."""
    return _in_order(
        active_rules(rules).withColumn("tests", F.array(spark_pattern(F.col("pattern")))).drop("pattern")
    )


def _with_first_pattern(rules: DataFrame) -> DataFrame:
    """Rules that are not disabled, with their first pattern."""
    first = rules.withColumn("pattern", F.try_element_at("patterns", F.lit(1)))
    return first.where(F.coalesce("enabled", F.lit(True)) & F.col("pattern").isNotNull())


def live_patterns(rules: DataFrame) -> DataFrame:
    """The first patterns of live rules, each once: pattern, its Java spelling, its rules and the bytes of their texts.

    Patterns are looked into once, however many rules have them.
    """
    text_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("id", "description", "severity", "mitigation")), F.lit(0))
    each = _with_first_pattern(rules).groupBy("pattern").agg(F.count("*").alias("rules"), F.sum(text_bytes).alias("text_bytes"))
    return with_problem(each, "pattern", "problem").where(F.col("problem").isNull()).select(
        "pattern", spark_pattern(F.col("pattern")).alias("java"), "rules", "text_bytes"
    )


def of_patterns(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rules that are not disabled and have one of the patterns as their first one, with its columns."""
    return _with_first_pattern(rules).join(patterns, "pattern")


def collect_of_patterns(rules: DataFrame, patterns: list[Row]) -> list[Row]:
    """``collect_live`` for the rules of some of the ``live_patterns``."""
    table = rules.sparkSession.createDataFrame([(p.pattern, [p.java]) for p in patterns], "pattern string, tests array<string>")
    return _in_order(
        of_patterns(rules, F.broadcast(table)).select("rule_seq", "id", "description", "severity", "mitigation", "tests")
    )


def collect_all_patterns(rules: DataFrame) -> list[Row]:
    """Enabled rules, on the driver, with every pattern that the strict dialect takes."""
    each = rules.where("enabled").select(
        "rule_seq", "id", "description", "severity", "mitigation", F.explode("patterns").alias("pattern")
    )
    return _in_order(
        with_problem(each, "pattern", "problem")
        .where(F.col("problem").isNull())
        .groupBy("rule_seq", "id", "description", "severity", "mitigation")
        .agg(F.collect_set(spark_pattern(F.col("pattern"))).alias("tests"))
    )


def collect_guarded(rules: DataFrame) -> list[Row]:
    """Enabled rules, on the driver, with the trigger and the guard of their first pattern."""
    trigger, guard = guard_parts(F.col("pattern"))
    parts = (
        rules.where("enabled")
        .withColumn("pattern", F.try_element_at("patterns", F.lit(1)))
        .where(F.col("pattern").isNotNull())
        .withColumn("trigger", trigger)
        .withColumn("guard", guard)
    )
    checked = with_problem(with_problem(parts, "trigger", "trigger_problem"), "guard", "guard_problem")
    return _in_order(
        checked.where("trigger_problem IS NULL AND guard_problem IS NULL").select(
            "rule_seq", "id", "description", "severity", "mitigation",
            spark_pattern(F.col("trigger")).alias("trigger"),
            spark_pattern(F.col("guard")).alias("guard"),
        )
    )


def _in_order(rules: DataFrame) -> list[Row]:
    """Rules on the driver: they are configuration that ends up as literals inside the plan."""
    return sorted(rules.toLocalIterator(), key=lambda r: r.rule_seq)
