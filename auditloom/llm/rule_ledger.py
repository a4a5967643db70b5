"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. Its measurements and one bit per failed rule are
stored; policies are masks over these bits with a version, so that another policy or an
ablation reads the ledger and no text. Everything is a DataFrame function.

Null texts have no words. Repeated rows are rows of their own. An empty table gives an
empty ledger. Columns of the input keep their place; a clash with a ledger column is
resolved in favour of the ledger.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import SPACES, WORD_BREAK, shield, unshield

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Rules by bit. A rule may only name measurements, so that it can be evaluated again from
# the ledger. Bits are never given to another rule.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 15 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclamations", "100 * n_exclamations > 40 * n_words"),
    ("word_length", "word_chars > 30 * n_words"),
)
BITS = {name: 1 << bit for bit, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a text, under a version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(BITS))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the measurements that the rules are about.

    Steps are separate projections, so that an array is worked out once and then only
    referred to.
    """
    words = F.filter(F.split("_text", WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    # Named twice, so that the hashes stay a column and are not worked out for every window.
    starts = F.when(F.size("_hashes") > WINDOW, F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))

    frame = (
        documents.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumns({"_words": words, "_lines": lines, "_solid": F.translate("_text", SPACES, "")})
        .withColumns({
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length("_solid").cast("bigint"),
            "n_symbols": _count("_solid", SYMBOLS),
            "n_exclamations": _count("_solid", "!"),
            "n_capitals": F.length(F.regexp_replace("_solid", r"\P{Lu}+", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hashes": hashes,
        })
        .drop("_text", "_lines", "_solid")
        .withColumn("_windows", windows)
        .drop("_words", "_hashes")
    )
    return _with_repeats(frame).drop("_windows")


def _count(text: str, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("bigint")


def _with_repeats(frame: DataFrame) -> DataFrame:
    """Words in windows that are found twice or more in a text, by sorted window hashes.

    Only texts with a repeated window are sorted. ``_where`` holds the starts of such
    windows in order; each adds the words that the one before it has not covered.
    """
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    ordered = F.when(
        repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )

    def twice(window: Column, at: Column) -> Column:
        before, after = F.get("_ordered", at - 1)["h"], F.get("_ordered", at + 1)["h"]
        return F.coalesce(before == window["h"], F.lit(False)) | F.coalesce(after == window["h"], F.lit(False))

    def cover(state: Column, start: Column) -> Column:
        end = start + WINDOW
        return F.struct(
            (state["n"] + end - F.greatest(state["end"], start)).alias("n"), end.alias("end")
        )

    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_where", empty, cover, lambda state: state["n"])
    return (
        frame.withColumn("_ordered", ordered)
        .withColumn("_where", F.array_sort(F.transform(F.filter("_ordered", twice), lambda w: w["i"])))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
        .drop("_ordered", "_where")
    )


def with_bits(measured: DataFrame) -> DataFrame:
    """The ledger: the measurements and ``fail_bits``, a bit for every rule that fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0) for bit, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total.cast("bigint"))


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with all measurements and ``fail_bits``; columns of theirs with such names give way."""
    hidden, names = shield(documents)
    rows = with_bits(measure(hidden, names[text]))
    return unshield(rows, names, [c for c in rows.columns if c not in names.values()])


def ablations(ledger_rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule of each policy does, from the bits alone.

    ``n_failed`` texts fail the rule; ``n_only`` fail no other rule of the policy and
    would be kept without it; ``n_rejected`` fail the policy. Rows are first counted by
    their bits, so that what follows is as small as the number of bit patterns. A rule
    that nothing fails has its row with zeros; an empty ledger gives no row.
    """
    patterns = ledger_rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(name).alias("rule"),
            F.lit(BITS[name]).cast("bigint").alias("bit"), F.lit(p.mask).cast("bigint").alias("mask"),
        )
        for p in policies for name in p.rules
    ])
    each = patterns.select("fail_bits", "n", F.inline(cases))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return each.groupBy("policy", "rule").agg(
        rows(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        rows(failed == F.col("bit")).alias("n_only"),
        rows(failed != 0).alias("n_rejected"),
        F.sum("n").alias("n_texts"),
    )
