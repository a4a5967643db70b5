"""Personal data, by patterns and by contexts bootstrapped from them.

Validated matches of fixed patterns are the seeds. The word before a seed with the shape of
the seed is a lexical pattern, and so is the word after it; a line's start and end stand
for words. Patterns and the identifier-like instances beside them form a graph over the
corpus, which Spark scores in rounds: a pattern is as good as the share of its occurrences
that stand beside good instances, an instance as good as its best good pattern or, if it is
a seed anywhere, wholly good. An occurrence of a pattern is one of its word beside an
instance of its shape; the word beside other words is none. Instances of good patterns
that enough others support are found beside the seeds.

Null texts are empty. Repeated rows are rows of their own. An empty table gives an empty
result. Offsets are code points, ends exclusive.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import shield, stored, text_slices, unshield

# Kinds in the order in which spans of one start are listed; context comes from patterns.
KINDS = ("email", "ip", "card", "phone", "context")
CONTEXT = KINDS.index("context")
# A pattern is good from this share on, with so many different good instances. An instance
# has so many digits, or an @ between other signs.
LEAST_CONFIDENCE, LEAST_SUPPORT = 0.5, 3
LEAST_DIGITS = 6
ROUNDS = 3
# The word beside the first and the last word of a line; no word holds white space.
LINE_EDGE = "\n"

# Each looks at a run from its start only, so that long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)\S++")
_EDGES = "\"'`()[]{}<>|*$%&#!?.,;:="

_FOUND = (
    "spans array<struct<start: int, kind: int, end: int>>, "
    "mentions array<struct<start: int, end: int, left: string, right: string, shape: string, value: string, seed: boolean>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the seeds of a text, by start and kind."""
    found = []
    if "@" in text:
        found += [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and is_card(re.sub("[^0-9]", "", m.group())):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def context_word(token: str) -> str:
    return token.lower().strip(_EDGES)


def shape_of(value: str) -> str:
    """Kinds of signs in a value, in order of their first place in runs: 9 a @ and others."""
    runs = re.sub("[0-9]+", "9", value)
    return re.sub("[^\\W\\d_]+", "a", runs)


def is_candidate(word: str) -> bool:
    """True for what looks like a number or an e-mail address."""
    return len(_DIGIT.findall(word)) >= LEAST_DIGITS or "@" in word.strip("@" + _EDGES)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, left, right, shape, value, seed) of seeds and of identifier-like words apart from them.

    The words before and after are those of the same line, or else its edge. A number that
    is a card by itself, but for what stands beside it, counts as a seed.
    """
    if not spans and not _DIGIT.search(text) and "@" not in text:
        return []
    found: list[list] = []
    covered = sorted((s, e) for s, _, e in spans)
    at = 0
    left, line_end = LINE_EDGE, 0
    # Mentions whose next word has not come yet.
    waiting: list[list] = []
    for token in _TOKEN.finditer(text):
        start, end = token.span()
        new_line = "\n" in text[line_end:start]
        if waiting:
            right = LINE_EDGE if new_line else context_word(token.group())
            for mention in waiting:
                if mention[1] <= start:
                    mention[3] = right
            waiting = [m for m in waiting if m[1] > start]
        if new_line:
            left = LINE_EDGE
        line_end = end
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        inside = at < len(covered) and covered[at][0] < end
        if inside:
            seed = at
            while seed < len(covered) and covered[seed][0] < end:
                if covered[seed][0] >= start:
                    value = text[covered[seed][0]:covered[seed][1]]
                    found.append([*covered[seed], left, LINE_EDGE, shape_of(value), value, True])
                    waiting.append(found[-1])
                seed += 1
        else:
            word = token.group()
            if is_candidate(word):
                value = word.strip(_EDGES)
                first = start + word.find(value)
                seed_like = value.isascii() and value.isdigit() and is_card(value)
                found.append([first, first + len(value), left, LINE_EDGE, shape_of(value), value, seed_like])
                waiting.append(found[-1])
        left = context_word(token.group())
    return [tuple(m) for m in found]


def _find(text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        mention_type = pa.list_(pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string()),
            ("shape", pa.string()), ("value", pa.string()), ("seed", pa.bool_()),
        ]))
        names = [f.name for f in mention_type.value_type]
        for batch in batches:
            for part, texts in text_slices(batch, text):
                spans = [base_spans(t) for t in texts]
                seen = [mentions(t, s) for t, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in columns],
                        pa.array([[dict(zip(("start", "kind", "end"), s)) for s in ss] for ss in spans], span_type),
                        pa.array([[dict(zip(names, m)) for m in ms] for ms in seen], mention_type),
                    ],
                    names=[*columns, "spans", "mentions"],
                )

    return run


def in_contexts(mentions: DataFrame) -> DataFrame:
    """Each mention once with the word before and once with the word after, if they are words."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(word).alias("word")) for side, word in enumerate(("left", "right"))
    ])
    return mentions.select("*", F.inline(sides)).drop("left", "right").where("word <> ''")


def score_graph(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(side, word, shape, confidence, support) of the good patterns of mentions (left, right, shape, value, seed).

    Mentions are counted by pattern and instance first, so that neither a common word nor a
    common instance moves more than once from a task; each round is written to shared
    storage.
    """
    pattern = ["side", "word", "shape"]
    edges = stored(
        in_contexts(seen).groupBy(*pattern, "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph"
    )
    totals = stored(
        edges.groupBy(*pattern).agg(F.sum("n").alias("total"), F.count("*").alias("values"))
        .where(F.col("values") >= LEAST_SUPPORT).drop("values"),
        "totals",
    )
    seeds = stored(edges.where("seed").select("value").distinct().withColumn("score", F.lit(1.0)), "instances")
    scores = seeds
    for _ in range(rounds):
        scored = edges.join(scores, "value").groupBy(*pattern).agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.count("*").alias("support")
        )
        patterns = stored(
            scored.where(F.col("support") >= LEAST_SUPPORT).join(totals, pattern)
            .select(*pattern, (F.col("good") / F.col("total")).alias("confidence"), "support")
            .where(F.col("confidence") >= LEAST_CONFIDENCE),
            "patterns",
        )
        reached = edges.join(patterns, pattern).groupBy("value").agg(F.max("confidence").alias("score"))
        scores = stored(
            reached.unionByName(seeds).groupBy("value").agg(F.max("score").alias("score")), "instances"
        )
    return patterns


def find_pii(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows, without texts, with ``spans``: (start, kind, end) of seeds and of what contexts find.

    ``spans`` is in order of start and kind. Texts are read once; seeds and mentions are
    stored. A column ``spans`` of the rows gives way to the new one.
    """
    documents, names = shield(documents)
    given, text = text, names[text]
    kept = documents.drop(text)
    columns = kept.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), _FOUND])
    rows = documents.select(*[F.col(f"`{c}`") for c in [*columns, text]]).mapInArrow(_find(text, columns), schema)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "pii")
    seen = rows.select("_row", F.inline("mentions"))
    patterns = score_graph(seen, rounds)
    # A value that is a seed somewhere is one wherever it stands.
    known = stored(seen.where("seed").select("value").distinct(), "known")
    loose = rows.select("_row", "spans", F.inline("mentions")).where(
        ~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    )
    by_value = loose.join(known, "value", "left_semi").select("_row", "start", "end")
    by_pattern = in_contexts(loose).join(patterns, ["side", "word", "shape"], "left_semi").select("_row", "start", "end")
    more = by_value.unionByName(by_pattern).distinct().groupBy("_row").agg(
        F.collect_list(F.struct("start", F.lit(CONTEXT).alias("kind"), "end")).alias("more")
    )
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    found = rows.join(more, "_row", "left").withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("more", none))))
    return unshield(found, names, ["spans"], gone=(given,))


def mask(text: str, extra: list[tuple[int, int]]) -> str:
    """The text with its seeds, and further spans, replaced by their kinds in angle brackets."""
    spans = sorted([*base_spans(text), *((start, CONTEXT, end) for start, end in extra)])
    kept, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            kept += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def _mask(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                more = part.column("_more").to_pylist()
                masked = [mask(t, [(m["start"], m["end"]) for m in ms or []]) for t, ms in zip(texts, more)]
                valid = part.column("text").is_valid().to_pylist()
                out = {c: part.column(c) for c in columns}
                out["text"] = pa.array([t if v else None for t, v in zip(masked, valid)], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return run


def mask_pii(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents (doc, text, ..) with personal data masked.

    Seeds are masked where the text is; what contexts find, in few texts, is joined to
    them by id and text, so that texts move only if that is too much to broadcast.
    """
    schema = documents.schema
    hidden, names = shield(documents)
    documents = hidden.withColumnRenamed(names["text"], "text")
    doc = names[doc]
    keyed = documents.select(F.col(doc).alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    found = find_pii(keyed).withColumn("_more", F.filter("spans", lambda s: s["kind"] == CONTEXT))
    more = stored(found.where(F.size("_more") > 0).select("_id", "_hash", "_more").dropDuplicates(["_id", "_hash"]), "more")
    marked = documents.withColumn("_text_hash", F.xxhash64("text"))
    same = marked[doc].eqNullSafe(more["_id"]) & (marked["_text_hash"] == more["_hash"])
    columns = documents.columns
    joined = marked.join(more, same, "left").select(*[marked[f"`{c}`"] for c in columns], "_more")
    masked = joined.mapInArrow(_mask(columns), documents.schema)
    return masked.select(*[F.col("text" if c == "text" else names[c]).alias(c) for c in schema.names])


def span_text(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def seeds_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < CONTEXT)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
