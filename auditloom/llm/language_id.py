"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in every language, learned by
expectation maximisation over all segmentations of the words of labelled texts. A text's
likelihood in a language is the product over its words; a word's is the sum over all its
segmentations into pieces, by a forward pass. The answer is the language of the highest
posterior under equal priors.

Words are runs of letters in lower case, with the vocabulary's word mark before them; other
signs, numerals among them, are no letters. A letter that is no piece is the unknown
piece. A text that is null, or has no letter, is ``und`` with score 0. Words and texts may
be of any length, in learning as in scoring. Languages of equal posterior: the first by
name. Repeated rows are rows of their own, and a row's answer depends on its text alone.
Without a labelled text every answer is ``und``.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.sentencepiece_codec import MARK, NORMAL, parse_model
from auditloom.llm.shared import kept_in_worker, stored
from auditloom.llm.word_tables import RowsByWord, array_slices

UNDETERMINED = "und"
# Labelled texts per language that the pieces are learned from, and rounds of learning.
TEXTS_PER_LANGUAGE = 400
ROUNDS = 3
# Added to the expected count of every piece.
PSEUDO_COUNT = 0.05
# Different words that a task remembers with their likelihoods.
CACHE_WORDS = 80_000
# Bytes of texts in a block.
BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as a table of hashed prefixes: number of the piece, or -1 for a mere prefix."""

    def __init__(self, texts: list[str]):
        known = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        prefixes = {t[:n] for t in known for n in range(1, len(t) + 1)}
        ordered = sorted(prefixes)
        hashes = np.array([int(_hash_text(t)) for t in ordered], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.numbers = np.array([known.get(t, -1) for t in ordered], dtype=np.int64)[order]
        self.unknown = len(known)
        self.count = len(known) + 1
        self.longest = max(map(len, known), default=1)

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) in order of start, of words with one length as a code matrix."""
        rows, length = codes.shape
        for start in range(length):
            alive = np.arange(rows)
            hashed = np.zeros(rows, dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                hashed = hashed * _BASE + codes[alive, end - 1]
                at = np.searchsorted(self.hashes, hashed)
                at[at == len(self.hashes)] = 0
                found = self.hashes[at] == hashed
                number = self.numbers[at]
                if end == start + 1:
                    number = np.where(found & (number >= 0), number, self.unknown)
                    yield start, end, alive, number
                else:
                    piece = found & (number >= 0)
                    if piece.any():
                        yield start, end, alive[piece], number[piece]
                if not found.any():
                    break
                alive, hashed = alive[found], hashed[found]


def _hash_text(text: str) -> np.uint64:
    value = 0
    for sign in text:
        value = (value * int(_BASE) + ord(sign) + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(value)


def code_groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, code matrix) of words of each length, with the word mark first."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        data = "".join([MARK + words[i] for i in at]).encode("utf-32-le")
        codes = np.frombuffer(data, dtype=np.uint32).reshape(len(at), length + 1)
        yield at, codes.astype(np.uint64) + np.uint64(1)


def forward(pieces: Pieces, probabilities: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log likelihoods (words, languages); sums are scaled as they go, so that no word is too long."""
    rows, length = codes.shape
    languages = probabilities.shape[1]
    # Only as many steps are held as a piece is long.
    span = min(pieces.longest, length) + 1
    sums = np.zeros((span, rows, languages))
    sums[0] = 1
    scale = np.zeros((rows, languages))
    last = -1
    for start, end, some, number in pieces.edges(codes):
        if start != last:
            if start:
                sums[(start - 1) % span] = 0
                if start % 8 == 0:
                    top = sums.max(axis=0)
                    sums /= top
                    scale += np.log(top)
            last = start
        sums[end % span, some] += sums[start % span, some] * probabilities[number]
    return scale + np.log(sums[length % span])


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, end to end, and the text number of each."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    words = split.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), owner[there.to_numpy(zero_copy_only=False)]


def expected_counts(pieces: Pieces, probabilities: np.ndarray, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words of one length, over all their segmentations.

    ``probabilities`` is the column of one language. Sums from both sides are scaled as they
    go; each place keeps the logarithm of its scale, so that no word is too long.
    """
    rows, length = codes.shape
    edges = list(pieces.edges(codes))
    before, after = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))
    before_scale, after_scale = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))
    before[0] = after[length] = 1
    last = 0
    for start, end, some, number in edges:
        if start != last:
            last = start
            # The places ahead hold sums of one scale, that of the place just reached.
            ahead = slice(start, min(start + pieces.longest, length) + 1)
            before_scale[ahead] = before_scale[start - 1]
            if start % 8 == 0:
                top = before[ahead].max(axis=0)
                before[ahead] /= top
                before_scale[ahead] += np.log(top)
        before[end, some] += before[start, some] * probabilities[number]
    if length:
        before_scale[length] = before_scale[last]
    last = length
    for start, end, some, number in reversed(edges):
        if start != last:
            last = start
            behind = slice(start + 1, min(start + 1 + pieces.longest, length + 1))
            if (length - start) % 8 == 0:
                top = after[behind].max(axis=0)
                after[behind] /= top
                after_scale[behind] += np.log(top)
            after_scale[start] = after_scale[start + 1]
        after[start, some] += after[end, some] * probabilities[number]
    counts = np.zeros(pieces.count)
    total = np.log(before[length]) + before_scale[length]
    for start, end, some, number in edges:
        scale = np.exp(before_scale[start, some] + after_scale[end, some] - total[some])
        used = before[start, some] * probabilities[number] * after[end, some] * scale * times[some]
        counts += np.bincount(number, used, minlength=pieces.count)
    return counts


@dataclass
class LanguageModel:
    pieces: Pieces
    languages: list[str]
    probabilities: np.ndarray

    def __post_init__(self):
        self.table = RowsByWord(np.float64, CACHE_WORDS, self._likelihoods)

    def _likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of words, a value for each language; words of one length go together."""
        width = len(self.languages)
        fresh = np.empty((len(words), width))
        for at, codes in code_groups(words):
            fresh[at] = forward(self.pieces, self.probabilities, codes)
        return fresh.ravel(), np.full(len(words), width)

    def scores(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        words, owner = words_in(texts)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        numbers = self.table.numbers(words)
        values = self.table.flat.reshape(-1, len(self.languages))[numbers]
        # Each text is summed by itself, in the order of its words.
        totals = np.stack([np.bincount(owner, values[:, i], minlength=n) for i in range(values.shape[1])], axis=1)
        shares = np.exp(totals - totals.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        told = np.bincount(owner, minlength=n) > 0
        names = [self.languages[b] if t else UNDETERMINED for b, t in zip(best, told)]
        return names, np.where(told, shares[np.arange(n), best], 0.0)


def learn(
    labelled: DataFrame, vocabulary: bytes, text: str = "text", lang: str = "lang", key: str = "doc_id",
    texts_per_language: int = TEXTS_PER_LANGUAGE, rounds: int = ROUNDS,
) -> LanguageModel:
    """A model from labelled texts; rows without a text or a label are left out.

    Of each language the texts of ``texts_per_language`` keys are used, chosen by a hash
    of the key. Words are counted and expectations are taken in Spark; the driver gets a number
    per language and piece, which the fixed vocabulary bounds.
    """
    spark = labelled.sparkSession
    pieces = Pieces([t for t, _, kind in parse_model(vocabulary).pieces if kind == NORMAL])
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    named = usable.groupBy(lang).count().orderBy(lang).collect()
    languages = [row[lang] for row in named]
    if not languages:
        return LanguageModel(pieces, [], np.zeros((pieces.count, 0)))
    # Keys are chosen without their texts. Their number is bounded, so that they are
    # broadcast and no text moves.
    order = F.xxhash64(F.col("key").cast("string"))
    keys = None
    for name in languages:
        part = usable.where(F.col(lang) == name).select(F.col(key).alias("key"), F.col(lang).alias("lang")).distinct()
        part = part.orderBy(order, "key").limit(texts_per_language)
        keys = part if keys is None else keys.unionByName(part)
    texts = usable.select(F.col(key).alias("key_"), F.col(lang).alias("lang_"), F.col(text).alias("text"))
    same = F.col("key_").eqNullSafe(F.col("key")) & (F.col("lang_") == F.col("lang"))
    chosen = texts.join(F.broadcast(keys), same).select("lang", "text")
    # Words as the scorer cuts them.
    words = stored(chosen.mapInArrow(_lang_words, "lang string, word string")
                   .groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    probabilities = np.full((pieces.count, len(languages)), 1 / pieces.count)
    for _ in range(rounds):
        probabilities = _learning_round(spark, words, pieces, languages, probabilities)
    return LanguageModel(pieces, languages, probabilities)


def _lang_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in array_slices(batch, "text", BLOCK_BYTES):
            words, owner = words_in(texts)
            langs = part.column("lang").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([langs, words.cast(pa.string())], names=["lang", "word"])


def _learning_round(spark: SparkSession, words: DataFrame, pieces: Pieces, languages: list[str], probabilities: np.ndarray) -> np.ndarray:
    sent = spark.sparkContext.broadcast((pieces, languages, probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, shares = sent.value
        total = np.zeros((known.count, len(names)))
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            all_words = np.array(batch.column("word").to_pylist(), dtype=object)
            times = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            for column, name in enumerate(names):
                mine = np.flatnonzero(langs == name)
                if not len(mine):
                    continue
                for at, codes in code_groups(list(all_words[mine])):
                    total[:, column] += expected_counts(known, shares[:, column], codes, times[mine][at])
        piece, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(column), pa.array(total[piece, column])], names=["piece", "lang", "n"]
        )

    rows = words.mapInArrow(run, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    counts = np.full(probabilities.shape, PSEUDO_COUNT)
    for row in rows.collect():
        counts[row["piece"], row["lang"]] += row["n"]
    return counts / counts.sum(axis=0)


def model_of(name: str, parts: tuple) -> LanguageModel:
    """The model of a query; a Python worker keeps the last one, with its words."""
    return kept_in_worker(("language", name), lambda: LanguageModel(*parts))


def identify(
    documents: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """The rows with the language and its posterior, in one pass without a shuffle.

    Columns of the rows that have the names of the new ones give way to them.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.probabilities))
    name = uuid.uuid4().hex
    kept = documents.drop(*({pred, score} - {text}))
    fields = [*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = model_of(name, sent.value)
        for batch in batches:
            for part, texts in array_slices(batch, text, BLOCK_BYTES):
                names, scores = mine.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[f.name for f in fields],
                )

    return kept.mapInArrow(run, T.StructType(fields))
