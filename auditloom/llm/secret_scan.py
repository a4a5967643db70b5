"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern. The hash of each candidate's value is then counted over
the whole corpus by distinct repositories and owners: a value that many owners hold is a
copied example, one that a single owner holds and that looks random is a live-looking
credential. Everything is a DataFrame function.

Null texts are empty. Repeated rows are rows of their own. An empty table gives an empty
result. Offsets are code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import shield, stored, unshield

# Kinds in the order in which spans of one start are listed. ``loose`` candidates count
# only if the corpus speaks for them.
KINDS = ("assign", "access", "hex", "loose")
_ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# The least lengths are part of these patterns where a failing match could not hide
# another one. A run is tried at its start only, which keeps the search linear.
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "loose": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
LEAST_ASSIGNED = 6
# A value of more owners, or in more repositories, than this is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 20
# A loose candidate looks random with so many different characters, a digit and letters
# of both cases.
LEAST_VARIETY = 12
# Matches in a chunk of the two-level running sums.
_CHUNK = 256


def find_candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``candidates``: an array of (kind, start, end, value) by start and kind."""
    hidden, names = shield(documents)
    return unshield(_candidates(hidden, names[text]), names, ["candidates"])


def _candidates(documents: DataFrame, text: str) -> DataFrame:
    frame = documents.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        frame = _with_matches(frame, kind)
    merged = F.flatten(F.array(*[F.coalesce(f"_{kind}", F.array().cast(_SPANS)) for kind in KINDS]))
    return frame.withColumn("candidates", F.array_sort(merged)).drop("_text", *[f"_{k}" for k in KINDS])


_SPANS = "array<struct<start: int, rank: int, end: int, value: string>>"


def _with_matches(frame: DataFrame, kind: str) -> DataFrame:
    """Add ``_kind``: the spans of one kind, from the matches and the pieces between them."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    some = F.size("_found") > 0
    # A match and the piece before it have one length together: the step to its end.
    between = F.when(some, F.split("_text", pattern, -1))
    steps = F.when(
        some,
        F.transform("_found", lambda m, i: F.length(F.get("_between", i)) + F.length(m)),
    )
    frame = frame.withColumn("_found", found).withColumn("_between", between).withColumn("_steps", steps)
    frame = _with_running_sums(frame, "_steps", "_ends")

    def span(match: Column, at: Column) -> Column:
        end = F.get("_ends", at)
        value = F.regexp_extract(match, f"^{_ASSIGN}", 2) if kind == "assign" else match
        return F.struct(
            (end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
            value.alias("value"),
        )

    spans = F.transform("_found", span)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    if kind == "loose":
        spans = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return frame.withColumn(f"_{kind}", F.when(some, spans).cast(_SPANS)).drop("_found", "_between", "_steps", "_ends")


def _with_running_sums(frame: DataFrame, numbers: str, name: str) -> DataFrame:
    """Running sums of an array, in two levels so that long arrays do not take quadratic time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    count = F.size(numbers)
    chunks = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(numbers, c * _CHUNK + 1, _CHUNK),
        ),
    )
    frame = frame.withColumn("_chunks", chunks)
    frame = frame.withColumn("_totals", F.when(F.size("_chunks") > 0, F.transform("_chunks", total)))
    frame = frame.withColumn(
        "_before",
        F.when(F.size("_totals") > 0, F.transform("_totals", lambda _, c: total(F.slice("_totals", F.lit(1), c)))),
    )
    sums = F.transform(
        "_chunks",
        lambda chunk, c: F.transform(
            chunk, lambda _, i: F.get("_before", c) + total(F.slice(chunk, F.lit(1), i + 1))
        ),
    )
    return frame.withColumn(name, F.when(F.size("_before") > 0, F.flatten(sums))).drop("_chunks", "_totals", "_before")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners, n_seen, is_known) of rows (value_hash, repo, owner, rank).

    Rows are first counted by value, owner and repository, so that a value with a third
    of all rows is small before it is brought together. Null repositories and owners
    count as one of their own.
    """
    each = candidates.groupBy("value_hash", "owner", "repo").agg(
        F.count("*").alias("n"), F.min("rank").alias("rank")
    )
    by_owner = each.groupBy("value_hash", "owner").agg(
        F.count("*").alias("n_repos"), F.sum("n").alias("n"), F.min("rank").alias("rank")
    )
    return by_owner.groupBy("value_hash").agg(
        F.sum("n_repos").alias("n_repos"),
        F.count("*").alias("n_owners"),
        F.sum("n").alias("n_seen"),
        (F.min("rank") < KINDS.index("loose")).alias("is_known"),
    )


def scan_secrets(
    documents: DataFrame, repo: str, owner: str, text: str = "text", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """The rows, without their texts, with ``findings`` and ``n_live``, ``n_copied``.

    ``findings`` holds (start, rank, end, value, n_repos, n_owners, verdict): ``live`` for
    a value of at most ``max_owners`` owners and in at most ``max_repos`` repositories,
    whoever owns them, that looks random or stands beside a name, else ``copied``. Loose candidates are findings only if they are live, or if the
    corpus has their value in a named or formatted secret, and if no other finding of
    the text overlaps them.

    Texts are read once; their candidates are stored, and only they are shuffled. Columns of
    the rows that have the names of the new ones give way to them.
    """
    given, names = shield(documents)
    repo, owner, hidden = names[repo], names[owner], names[text]
    rows = given.withColumns({"_repo": F.col(repo).cast("string"), "_owner": F.col(owner).cast("string")})
    rows = _candidates(rows, hidden).drop(hidden).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "secrets")
    each = rows.where(F.size("candidates") > 0).select(
        "_row", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), F.inline("candidates")
    ).withColumn("value_hash", F.sha2("value", 256))
    # Stored, so that both sides of the join are plain scans and a hot value can be split.
    counted = each.join(stored(ownership(each), "owners"), "value_hash")

    value = F.col("value")
    variety = F.size(F.array_distinct(F.split(value, "")))
    random = (variety >= LEAST_VARIETY) & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    is_loose = F.col("rank") == KINDS.index("loose")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    live = few & (~is_loose | random)
    judged = counted.where(~is_loose | live | F.col("is_known")).withColumn(
        "verdict", F.when(live, "live").otherwise("copied")
    )
    finding = F.struct("start", "rank", "end", "value", "n_repos", "n_owners", "verdict")
    by_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(finding)).alias("_all"))

    def apart(found: Column) -> Column:
        return (found["rank"] < KINDS.index("loose")) | ~F.exists(
            "_named", lambda other: (other["start"] < found["end"]) & (found["start"] < other["end"])
        )

    by_row = by_row.withColumn("_named", F.filter("_all", lambda f: f["rank"] < KINDS.index("loose")))
    by_row = by_row.withColumn("findings", F.filter("_all", apart)).select("_row", "findings")
    joined = rows.join(by_row, "_row", "left").withColumn(
        "findings", F.coalesce("findings", F.array().cast(by_row.schema["findings"].dataType))
    )

    def count(verdict: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["verdict"] == verdict)).cast("bigint")

    counted = joined.withColumns({"n_live": count("live"), "n_copied": count("copied")})
    return unshield(counted, names, ["candidates", "findings", "n_live", "n_copied"], gone=(text,))


def span_text(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < KINDS.index("loose"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
