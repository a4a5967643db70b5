"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds the word sequences of the normalised test items. Each training text
is streamed through it; at every word the automaton knows the longest sequence ending
there that some item holds, and so which words lie in a window of an item. Items come in
blocks of bounded size, one automaton per block; every text, as it was given, meets every
block in one task, and what all blocks hit is merged there. Results do not depend on how
items are dealt into blocks. Items without an id hit texts as others do.

Words are runs of digits, letters and signs beyond ASCII, with A-Z lower-cased. An item
of fewer words than a window, but not none, is one window. Null texts have no words.
Repeated rows are rows of their own. Without texts the result is empty, without items
nothing is hit.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import text_slices

WINDOW = 10
# Words of the items in one automaton; a longer item has one of its own.
BLOCK_WORDS = 100_000
# Text bytes that a task holds while several automatons go over them one after another.
GROUP_BYTES = 1 << 24
# Bytes of a text as those of its words, with spaces between; all bytes of a sign beyond
# ASCII belong to words.
_WORD_BYTES = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)
) + bytes(range(0x80, 0x100))

_RUN = re.compile(rb"[^ ]+")
_HITS = "n_words bigint, spans array<int>, items array<bigint>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        # Items by the state that stands for a window or for a whole short item.
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, sequence in items:
            self._mark(item, sequence)
        self._inherit()

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, known, word)
        new = self._state(length[last] + 1, {})
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at == -1:
            link[new] = 0
        else:
            known = step[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, known, word)
        return new

    def _split(self, at: int, known: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        half = self._state(length[at] + 1, dict(step[known]))
        link[half] = link[known]
        link[known] = half
        while at != -1 and step[at].get(word) == known:
            step[at][word] = half
            at = link[at]
        return half

    def _state(self, length: int, step: dict[bytes, int]) -> int:
        self.step.append(step)
        self.link.append(-1)
        self.length.append(length)
        return len(self.step) - 1

    def _mark(self, item: int, sequence: list[bytes]) -> None:
        """Note the item at the states of its windows."""
        short = 0 < len(sequence) < self.window
        state = 0
        for i, word in enumerate(sequence):
            state = self.step[state][word]
            if not short:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                if i + 1 >= self.window:
                    self.items.setdefault(state, set()).add(item)
        if short:
            self.short.setdefault(state, []).append((len(sequence), item))

    def _inherit(self) -> None:
        """Short items that end wherever a state's longest sequence does."""
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.ending[state] = self.ending[self.link[state]] + tuple(self.short.get(state, ()))

    def hits(self, text_words: list[bytes]) -> tuple[list[int], set[int]]:
        """(start, end, start, end, ..) of the words in windows, merged, and the items hit."""
        step, link, length, window, ending = self.step, self.link, self.length, self.window, self.ending
        some_short = bool(self.short)
        spans: list[int] = []
        found: set[int] = set()
        state = matched = 0
        for i, word in enumerate(text_words):
            after = step[state].get(word)
            if after is None:
                while state and after is None:
                    state = link[state]
                    after = step[state].get(word)
                if after is None:
                    matched = 0
                    continue
                matched = length[state]
            state = after
            matched += 1
            reach = 0
            if matched >= window:
                reach = matched
                held = state
                while length[link[held]] >= window:
                    held = link[held]
                found |= self.items[held]
            if some_short and ending[state]:
                for size, item in ending[state]:
                    if size <= matched:
                        found.add(item)
                        reach = max(reach, size)
            if reach:
                start = i + 1 - reach
                while spans and spans[-2] >= start:
                    start = min(start, spans[-2])
                    del spans[-2:]
                if spans and spans[-1] >= start:
                    spans[-1] = i + 1
                else:
                    spans += [start, i + 1]
        return spans, found


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, a bounded block at a time; one partition is read at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for number, item_text in benchmark.where(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        length = len(words(item_text))
        if block and size + length > block_words:
            yield block
            block, size = [], 0
        block.append((number, item_text))
        size += length
    yield block


def _automaton(block, window: int) -> Automaton:
    automaton = Automaton([(item, words(text)) for item, text in block.value], window)
    if getattr(block, "_path", None):
        # The worker's copy is a file, which is read again when it is needed again.
        vars(block).pop("_value", None)
    return automaton


def _groups(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[list[tuple[pa.RecordBatch, list[str]]]]:
    """Parts of batches with their texts, of about ``limit`` bytes together."""
    group, size = [], 0
    for batch in batches:
        for part, texts in text_slices(batch, column):
            group.append((part, texts))
            size += sum(map(len, texts))
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def _joined(spans: list[int], more: list[int]) -> list[int]:
    """Spans of two automatons, merged."""
    if not spans or not more:
        return spans or more
    joined: list[int] = []
    for start, end in sorted([*zip(spans[::2], spans[1::2]), *zip(more[::2], more[1::2])]):
        if joined and joined[-1] >= start:
            joined[-1] = max(joined[-1], end)
        else:
            joined += [start, end]
    return joined


def _hits(batches: Iterator[pa.RecordBatch], column: str, blocks: list, window: int):
    """(part, texts, [(spans, items) of a text under all blocks]) for all parts of the batches.

    Several automatons are built one after another for each group of texts, so that a task
    holds one at a time.
    """
    only = _automaton(blocks[0], window) if len(blocks) == 1 else None
    for group in _groups(batches, column, 0 if only else GROUP_BYTES):
        hits = [[([], set()) for _ in texts] for _, texts in group]
        for block in blocks:
            automaton = only or _automaton(block, window)
            for (_, texts), held in zip(group, hits):
                for i, text in enumerate(texts):
                    spans, found = automaton.hits(words(text))
                    if spans:
                        held[i] = (_joined(held[i][0], spans), held[i][1] | found)
        for (part, texts), held in zip(group, hits):
            yield part, texts, held


def _listed(items: set[int | None]) -> list[int | None]:
    return sorted(items, key=lambda i: (i is None, i or 0))


def _scan(blocks: list, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, hits in _hits(batches, "_text", blocks, window):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    pa.array([len(words(text)) for text in texts], pa.int64()),
                    pa.array([spans for spans, _ in hits], pa.list_(pa.int32())),
                    pa.array([_listed(found) for _, found in hits], pa.list_(pa.int64())),
                ],
                names=["_row", "n_words", "spans", "items"],
            )

    return run


def scan_benchmark(
    documents: DataFrame, benchmark: DataFrame, row: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(row, n_words, spans, items): merged spans of hit words (start, end, ..) and items hit.

    A row of the result is a row of the documents, in one pass without a shuffle, whatever
    the number of blocks; ``row`` need not tell rows apart.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select(F.col(row).alias("_row"), F.col(text).alias("_text"))
    kind = texts.schema["_row"].dataType.simpleString()
    blocks = [context.broadcast(block) for block in item_blocks(benchmark, item, item_text, block_words)]
    return texts.mapInArrow(_scan(blocks, window), f"_row {kind}, {_HITS}").withColumnRenamed("_row", row)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(
        F.transform(F.col(spans), lambda edge, i: F.when(i % 2 == 0, -edge).otherwise(edge)),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )


def _cut(window_spans: list[int], text: str) -> str:
    """The text without the words of the spans and the signs between them."""
    if not window_spans:
        return text
    data = text.encode()
    places = [m.span() for m in _RUN.finditer(data.translate(_WORD_BYTES))]
    kept, at = [], 0
    for start, end in zip(window_spans[::2], window_spans[1::2]):
        kept.append(data[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def _clean(blocks: list, window: int, max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, hits in _hits(batches, "text", blocks, window):
            kept, cleaned = [], []
            for i, (text, (spans, _)) in enumerate(zip(texts, hits)):
                if sum(spans[1::2]) - sum(spans[::2]) > max_share * len(words(text)):
                    continue
                kept.append(i)
                cleaned.append(_cut(spans, text) if part.column("text")[i].is_valid else None)
            rows = part.take(pa.array(kept, pa.int64()))
            at = rows.schema.get_field_index("text")
            yield rows.set_column(at, rows.schema.field("text"), pa.array(cleaned, rows.schema.field("text").type))

    return run


def remove_benchmark(
    documents: DataFrame, benchmark: DataFrame, max_share: float = 0.2, item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents (.., text, ..) without benchmark passages.

    The hit spans of all items are cut out of the text at once; a document goes whole if
    more than ``max_share`` of its words are hit.
    """
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in item_blocks(benchmark, item, item_text, block_words)]
    return documents.mapInArrow(_clean(blocks, window, max_share), documents.schema)
