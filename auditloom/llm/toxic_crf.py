"""Toxic spans by a linear-chain conditional random field, and document scores from them.

A text is one chain of words, each clean or toxic. Forward and backward sums give every
word's chance of being toxic. The highest chance, and how many and how dense the likely
words are, make the document's score, calibrated on labelled texts; words more likely
toxic than not are the offending spans.

Words for learning are labelled from documents' labels: a word is toxic in a toxic text
if it, or its beginning, is found in toxic texts far oftener than chance has it, counted
by the different places it stands in, so that copies of a text count once. Weights of
hashed features of the word and its neighbours, and of the moves between clean and toxic,
are then fitted to windows of labelled words by gradient steps on the exact likelihood.

A word is a run of letters of any script and digits, in lower case. Null texts are empty.
A text without a word has no span; its score is the share of toxic labels. Very long
texts are one chain like others, worked out in pieces whose products are joined. Repeated
rows get the same score: it depends on the text alone. Without labelled texts, or without
one of the labels, every score is the share of toxic labels, or 0 where there is none.
Columns of the rows that have the names of the new ones give way to them.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.grams import RunHashes, mix, runs
from auditloom.llm.shared import slices, stored

# Labelled texts that are learned from: toxic ones, and at most so many clean ones.
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 6000
# Windows of a text that weights are fitted to, and the words on each side of their middle.
TOXIC_WINDOWS, CLEAN_WINDOWS, REACH = 4, 2, 8
# A word, or a beginning of so many bytes, marks toxic texts if so large a share of its
# places are in them, and if chance would give that to fewer than so many of all. A text
# counts for so many places of a word at most.
HEADS = (4, 5, 6, 7, 8)
LEAST_SHARE, CHANCE_WORDS, PLACES_PER_TEXT = 0.7, 0.01, 3
# Hashed features of a word are numbers of so many bits; rounds and step of the fitting.
BITS, FEATURES = 20, 8
ROUNDS, STEP, SHRINK = 60, 0.5, 1e-5
# A word is part of a span if its chance is at least the first; it is counted from the second on.
SPAN_CHANCE, COUNT_CHANCE = 0.5, 0.2
# Bytes of text in a block; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 20
# Potentials further apart than this (as a logarithm) count as this far apart.
_FAR = 30.0

_SOLID = np.zeros(256, dtype=bool)
_SOLID[128:] = True
_SOLID[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_SALTS = mix(np.arange(1, FEATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """The words of a block of texts, in order: hash, hashes of beginnings, text number, bytes from and to."""

    hashes: np.ndarray
    heads: list[np.ndarray]
    owner: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray
    features: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words and their features from the lower-cased bytes of texts, end to end."""
    starts, stops, owner = runs(_SOLID[data], offsets)
    hashed = RunHashes(data)
    word = hashed.of(starts, stops)
    first = np.ones(len(word), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.roll(first, -1)
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[first], after[last] = 0, 0
    heads = [hashed.of(starts, np.minimum(starts + n, stops)) for n in HEADS]
    tail = hashed.of(np.maximum(stops - 3, starts), stops)
    # The word has two numbers, so that no other one is likely to share both.
    kinds = (word, word, before, after, heads[0], heads[1], heads[3], tail)
    features = np.empty((len(word), FEATURES), dtype=np.int32)
    for i, kind in enumerate(kinds):
        features[:, i] = (mix(kind + _SALTS[i]) >> np.uint64(64 - BITS)).astype(np.int32)
    return Words(word, heads, owner, starts, stops, first, features)


def names_of(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of whole words, and of the beginnings that are shorter than their words."""
    yield np.arange(len(words.hashes)), words.hashes
    for n, head in zip(HEADS, words.heads):
        longer = np.flatnonzero(words.stops - words.starts > n)
        yield longer, mix(head[longer] + np.uint64(n))


def forward_backward(odds: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of toxic, forward, backward) for every word of chains that follow each other.

    ``odds`` is the logarithm of toxic against clean by a word's own features, ``first``
    marks the first words of chains, ``start`` and ``move`` are potentials of the two
    labels at a start and from one word to the next. Forward and backward are the shares of
    toxic in the sums up to and beyond each word. The chain is cut into columns of equal
    length: products of 2 x 2 matrices carry sums across columns, and all columns take
    their steps together. A first word forgets what was before it, so that texts do not
    touch each other.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    rows = max(1, math.isqrt(n))
    columns = -(-n // rows)
    toxic = 1 / (1 + np.exp(-np.clip(odds, -_FAR, _FAR)))

    def laid(values: np.ndarray, rest: float) -> np.ndarray:
        out = np.full(rows * columns, rest)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(columns, rows).T)

    scale = max(float(move.max()), float(start.max()))
    m = [
        [laid(np.where(first, start[j], move[i, j]) / scale * (toxic if j else 1 - toxic), 0.5) for j in (0, 1)]
        for i in (0, 1)
    ]
    p00, p01, p10, p11 = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for r in range(rows):
        a, b, c, d = m[0][0][r], m[0][1][r], m[1][0][r], m[1][1][r]
        p00, p01 = p00 * a + p01 * c, p00 * b + p01 * d
        p10, p11 = p10 * a + p11 * c, p10 * b + p11 * d
        if r % 4 == 3:
            total = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()))
    entering, leaving = np.empty(columns), np.empty(columns)
    share = 0.5
    for column, (a, b, c, d) in enumerate(products):
        entering[column] = share
        clean, bad = (1 - share) * a + share * c, (1 - share) * b + share * d
        share = bad / (clean + bad)
    share = 0.5
    for column in range(columns - 1, -1, -1):
        leaving[column] = share
        a, b, c, d = products[column]
        clean, bad = a * (1 - share) + b * share, c * (1 - share) + d * share
        share = bad / (clean + bad)
    forward, backward = np.empty((rows, columns)), np.empty((rows, columns))
    share = entering
    for r in range(rows):
        clean = (1 - share) * m[0][0][r] + share * m[1][0][r]
        bad = (1 - share) * m[0][1][r] + share * m[1][1][r]
        share = bad / (clean + bad)
        forward[r] = share
    share = leaving
    for r in range(rows - 1, -1, -1):
        backward[r] = share
        clean = m[0][0][r] * (1 - share) + m[0][1][r] * share
        bad = m[1][0][r] * (1 - share) + m[1][1][r] * share
        share = bad / (clean + bad)
    forward, backward = forward.T.ravel()[:n], backward.T.ravel()[:n]
    both = forward * backward
    return both / (both + (1 - forward) * (1 - backward)), forward, backward


@dataclass
class Tagger:
    """Weights of features, potentials (as logarithms), and the calibration of document scores."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    levels: np.ndarray
    prior: float = 0.0
    fitted: bool = False

    def chances(self, words: Words) -> np.ndarray:
        odds = np.zeros(len(words.features))
        for i in range(FEATURES):
            odds += self.weights[words.features[:, i]]
        return forward_backward(odds, words.first, np.exp(self.start), np.exp(self.move))[0]

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        """Document scores from what their words' chances come to; NaN stands for no word."""
        if not self.fitted:
            return np.full(len(summaries), self.prior)
        bare = np.isnan(summaries[:, 0])
        level = np.where(bare[:, None], 0, summaries) @ self.levels[:-1] + self.levels[-1]
        return np.where(bare, self.prior, 1 / (1 + np.exp(-np.clip(level, -700, 700))))


def summaries_of(chances: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts x 3): the highest chance, the count and the density of likely words, on logarithmic scales."""
    out = np.full((texts, 3), np.nan)
    if len(owner):
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        there = owner[begins]
        likely = np.add.reduceat(np.where(chances >= COUNT_CHANCE, chances, 0), begins)
        n = np.diff(np.append(begins, len(owner)))
        out[there] = np.stack([_logit(np.maximum.reduceat(chances, begins)), np.log1p(likely), np.log1p(100 * likely / n)], axis=1)
    return out


def _logit(chance: np.ndarray) -> np.ndarray:
    chance = np.clip(chance, 1e-9, 1 - 1e-9)
    return np.log(chance) - np.log1p(-chance)


def fit_weights(features: np.ndarray, tags: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Tagger:
    """Weights of the highest likelihood of the tags, by adaptive gradient steps on all chains."""
    used, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    weights, start, move = np.zeros(len(used)), np.zeros(2), np.zeros((2, 2))
    sums = [np.full(len(used), 1e-8), np.full(2, 1e-8), np.full((2, 2), 1e-8)]
    inner = np.flatnonzero(~first)
    seen_move = np.bincount(2 * tags[inner - 1] + tags[inner], minlength=4).reshape(2, 2)
    seen_start = np.bincount(tags[first], minlength=2)
    n = max(len(tags), 1)
    for _ in range(rounds):
        odds = weights[place].sum(axis=1)
        chance, forward, backward = forward_backward(odds, first, np.exp(start), np.exp(move))
        toxic = 1 / (1 + np.exp(-np.clip(odds, -_FAR, _FAR)))
        before = np.stack([1 - forward[inner - 1], forward[inner - 1]])
        here = np.stack([(1 - toxic[inner]) * (1 - backward[inner]), toxic[inner] * backward[inner]])
        pair = before[:, None, :] * np.exp(move)[:, :, None] * here[None, :, :]
        pair /= pair.sum(axis=(0, 1))
        gap = np.repeat(chance - tags, FEATURES)
        steps = [
            np.bincount(place.ravel(), gap, minlength=len(used)) / n + SHRINK * weights,
            (np.array([(1 - chance[first]).sum(), chance[first].sum()]) - seen_start) / n,
            (pair.sum(axis=2) - seen_move) / n,
        ]
        for values, total, step in zip((weights, start, move), sums, steps):
            total += step * step
            values -= STEP * step / np.sqrt(total)
    spread = np.zeros(1 << BITS)
    spread[used] = weights
    return Tagger(spread, start, move, np.array([1.0, 0.0, 0.0, 0.0]), fitted=True)


def _blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the lower-cased bytes of their texts; a sign stays one sign."""
    column = pc.utf8_lower(batch.column(text).cast(pa.large_string()).fill_null(""))
    lengths = pc.binary_length(column).to_numpy()
    for begin, end in slices(lengths, BLOCK_BYTES):
        data = np.frombuffer("".join(column.slice(begin, end - begin).to_pylist()).encode(), dtype=np.uint8)
        yield batch.slice(begin, end - begin), data, np.concatenate([[0], np.cumsum(lengths[begin:end])]).astype(np.int64)


def _sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, float]:
    """(key, label, text) of labelled texts, one row for a key, and the share of toxic labels."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")
    ).where("label = other AND label IN (0, 1)").select("key", "label")
    counts = {row["label"]: row["n"] for row in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("key").cast("string"))
    picked = [
        one.where(F.col("label") == value).orderBy(order, "key").limit(most)
        for value, most in ((0, CLEAN_TEXTS), (1, TOXIC_TEXTS))
    ]
    # A bounded number of keys is broadcast. A key with many rows is reduced before it moves.
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(picked[0].unionByName(picked[1])), "key"
    )
    rows = rows.groupBy("key", "label").agg(F.min("text").alias("text")).select("*", F.xxhash64("key").alias("number"))
    return stored(rows, "toxic-sample"), counts.get(1, 0) / max(sum(counts.values()), 1)


def _name_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, t, c): how often words and beginnings stand in toxic and in clean texts of a block."""
    for batch in batches:
        for part, data, offsets in _blocks(batch, "text"):
            words = words_of(data, offsets)
            toxic = part.column("label").to_numpy(zero_copy_only=False)[words.owner] == 1
            for at, hashes in names_of(words):
                name, place = np.unique(hashes, return_inverse=True)
                t, n = np.bincount(place, toxic[at], minlength=len(name)), np.bincount(place, minlength=len(name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(t.astype(np.int64)), pa.array((n - t).astype(np.int64))],
                    names=["name", "t", "c"],
                )


def _divergence(t: Column, c: Column, base: float) -> Column:
    """How unlikely it is by chance that t of t + c places are toxic: minus the logarithm of a bound."""
    share = t / (t + c)
    rest = F.when(c > 0, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when(share > base, (t + c) * (share * F.log(share / base) + rest)).otherwise(0.0)


def marking_names(sample: DataFrame) -> np.ndarray:
    """Hashes of the words, and beginnings of words, that mark toxic texts, in order.

    Places are counted first, in sums for each block. Only for those names that would do by
    their counts are the places told apart, by the neighbours on both sides: copies of a
    text have one place between them. Clean places count each time.
    """
    sums = sample.mapInArrow(_name_counts, "name bigint, t bigint, c bigint").groupBy("name").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")
    )
    counts = stored(sums.where("t > 0"), "toxic-names")
    total = counts.agg(F.count("*").alias("names"), F.sum("t").alias("t")).first()
    clean = sums.agg(F.sum("c").alias("c")).first()["c"] or 0
    if not total["names"] or not clean:
        return np.zeros(0, dtype=np.uint64)
    base = total["t"] / (total["t"] + clean)
    least = math.log(total["names"] / CHANCE_WORDS)

    def good(t: Column, c: Column) -> Column:
        return (t / (t + c) >= LEAST_SHARE) & (_divergence(t, c, base) >= least)

    likely = counts.where(good(F.col("t"), F.col("c")))
    sent = sample.sparkSession.sparkContext.broadcast(
        np.sort(np.array([row["name"] for row in likely.select("name").collect()], dtype=np.int64).view(np.uint64))
    )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _blocks(batch, "text"):
                words = words_of(data, offsets)
                after, before = np.roll(words.hashes, -1), np.roll(words.hashes, 1)
                before[words.first], after[np.roll(words.first, -1)] = 1, 2
                place, text = mix(mix(before) + after), _numbers(part)[words.owner]
                for at, hashes in names_of(words):
                    mine = np.isin(hashes, sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (hashes[mine], place[at][mine], text[at][mine])],
                        names=["name", "place", "text"],
                    )

    found = sample.where("label = 1").mapInArrow(places, "name bigint, place bigint, text bigint").distinct()
    different = found.groupBy("name").agg(
        F.countDistinct("place").alias("places"), F.countDistinct("text").alias("texts")
    )
    t = F.least("places", F.col("texts") * PLACES_PER_TEXT, "t")
    rows = likely.join(different, "name").where(good(t, F.col("c"))).select("name").collect()
    return np.sort(np.array([row["name"] for row in rows], dtype=np.int64).view(np.uint64))


def _numbers(part: pa.RecordBatch) -> np.ndarray:
    return part.column("number").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _windows(sample: DataFrame, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, first) of windows around marking words of toxic texts, and of clean texts."""
    sent = sample.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _blocks(batch, "text"):
                words = words_of(data, offsets)
                keys, labels = part.column("key").cast(pa.string()).to_pylist(), part.column("label").to_pylist()
                tags = np.zeros(len(words.hashes), dtype=bool)
                for at, hashes in names_of(words):
                    tags[at] |= np.isin(hashes, sent.value)
                bounds = np.searchsorted(words.owner, np.arange(len(labels) + 1))
                rows: list[tuple] = []
                for number, label in enumerate(labels):
                    low, high = bounds[number], bounds[number + 1]
                    middles = np.flatnonzero(tags[low:high]) if label else np.arange(high - low)
                    most = TOXIC_WINDOWS if label else CLEAN_WINDOWS
                    for i in np.unique(np.linspace(0, len(middles) - 1, most).astype(int)) if len(middles) else ():
                        a, b = max(low, low + middles[i] - REACH), min(high, low + middles[i] + REACH + 1)
                        known = tags[a:b] if label else np.zeros(b - a, dtype=bool)
                        rows.append((keys[number], int(i), words.features[a:b].tobytes(), known.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["key", "at", "features", "tags"],
                )

    rows = sample.mapInArrow(run, "key string, at int, features binary, tags binary").collect()
    rows.sort(key=lambda row: (row["key"], row["at"]))
    tags = np.frombuffer(b"".join(row["tags"] for row in rows), dtype=bool).astype(np.int64)
    features = np.frombuffer(b"".join(row["features"] for row in rows), dtype=np.int32).reshape(-1, FEATURES)
    first = np.zeros(len(tags), dtype=bool)
    first[np.cumsum([0] + [len(row["tags"]) for row in rows])[:-1]] = True
    return features, tags, first


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Tagger:
    """A tagger from texts and their labels 0 and 1, joined by key.

    At most ``TOXIC_TEXTS`` and ``CLEAN_TEXTS`` keys are taken, chosen by their hashes; keys
    with different labels are left out.
    """
    sample, prior = _sample(documents, labels, key, text, label)
    marks = marking_names(sample)
    if not len(marks):
        return Tagger(np.zeros(1 << BITS), np.zeros(2), np.zeros((2, 2)), np.zeros(4), prior)
    tagger = fit_weights(*_windows(sample, marks))
    tagger.prior = prior
    rows = _tagged(sample.select("label", "text"), tagger, "text", ["summary"]).select("label", "summary").collect()
    _calibrate(tagger, np.array([row["summary"] for row in rows], dtype=float), np.array([row["label"] for row in rows]))
    return tagger


def _calibrate(tagger: Tagger, summaries: np.ndarray, label: np.ndarray) -> None:
    """Levels that make scores chances; texts weigh as much as their label is common."""
    there = ~np.isnan(summaries[:, 0])
    summaries, label = summaries[there], label[there]
    n = np.bincount(label, minlength=2)
    weight = np.where(label == 1, tagger.prior / max(n[1], 1), (1 - tagger.prior) / max(n[0], 1))
    design = np.concatenate([summaries, np.ones((len(label), 1))], axis=1)
    values, ridge = np.zeros(4), 1e-4 * np.eye(4)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ values, -700, 700)))
        slope = design.T @ (weight * (label - chance)) - ridge @ values
        curve = (design * (weight * chance * (1 - chance))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        values += step * min(1, 4 / max(np.abs(step).max(), 1e-12))
    tagger.levels = values


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("chance", T.DoubleType()),
]))


def _spans(words: Words, chances: np.ndarray, data: np.ndarray, offsets: np.ndarray, texts: int) -> pa.Array:
    """Runs of likely toxic neighbours as code points from and to, with their highest chance."""
    at = np.flatnonzero(chances >= SPAN_CHANCE)
    joined = np.zeros(len(at), dtype=bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & ~words.first[at[1:]]
    begins = np.flatnonzero(~joined)
    ends = np.append(begins, len(at))[1:] - 1
    signs = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    owner = words.owner[at[begins]] if len(at) else np.zeros(0, dtype=np.int64)
    base = signs[offsets[owner]]
    low, high = signs[words.starts[at[begins]]] - base, signs[words.stops[at[ends]]] - base
    top = np.maximum.reduceat(chances[at], begins) if len(at) else np.zeros(0)
    rows = pa.StructArray.from_arrays([pa.array(low), pa.array(high), pa.array(top)], names=["start", "end", "chance"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)), rows)


def _tagged(documents: DataFrame, tagger: Tagger, text: str, names: list[str]) -> DataFrame:
    """The rows with new columns: the summary alone, or the score and, if named, the spans."""
    sent = documents.sparkSession.sparkContext.broadcast(tagger)
    raw = names == ["summary"]
    kinds = [T.ArrayType(T.DoubleType())] if raw else [T.DoubleType(), SPANS]
    fields = [*documents.schema.fields, *(T.StructField(n, kind) for n, kind in zip(names, kinds))]
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        for batch in batches:
            for part, data, offsets in _blocks(batch, text):
                words = words_of(data, offsets)
                chances = mine.chances(words) if mine.fitted else np.zeros(len(words.hashes))
                summaries = summaries_of(chances, words.owner, part.num_rows)
                new = [pa.array(list(summaries)) if raw else pa.array(mine.scores(summaries))]
                if len(names) == 2:
                    new.append(_spans(words, chances, data, offsets, part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=columns)

    return documents.mapInArrow(run, T.StructType(fields))


def tag(documents: DataFrame, tagger: Tagger, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """The rows with the score and the toxic spans, in one pass without a shuffle.

    Spans are in code points of the text, the end exclusive, each with its highest chance.
    """
    return _tagged(documents.drop(*({score, spans} - {text})), tagger, text, [score, spans])
