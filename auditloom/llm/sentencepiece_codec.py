"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read field by field; from it the normaliser, the metaspace marker, the
scores and the byte fallback are rebuilt as a tokenizer of the other library, for models
of both kinds (unigram, and merges by score). Texts are encoded in batches; a batch
encodes each different word once, and its ids, and their bytes in decoding, are put
together by numpy. Parity with the original is verified on odd texts before a model is
used; models that this library cannot rebuild are an error.

Null texts stay null and have no ids. Empty texts have no ids. Very long texts are taken
whole, a block each. Repeated rows are rows of their own; other columns pass through, but
for those that have the names of the new ones, which give way to them.
"""

import functools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.shared import kept_in_worker
from auditloom.llm.word_tables import RowsByWord, array_slices, spread, sums_of

# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM_MODEL, BPE_MODEL = 1, 2
MARK = "▁"
# Different words that a task remembers, and threads of the library in a task.
CACHE_WORDS = 80_000
THREADS = 2
# Texts in one batch of the library, and words that are handed to it in one text.
BATCH_TEXTS, JOINED = 400, 50
# Bytes of texts in a block.
BLOCK_BYTES = 1 << 18


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} is not part of the format")
            size = varint()
        yield number, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM_MODEL
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    marker_is_suffix: bool = False


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 24:
                    model.marker_is_suffix = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges in the order in which the model makes them: by the score of the merged piece."""
    rank = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, i in rank.items():
        if pieces[i][2] != NORMAL:
            continue
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in rank and right in rank:
                found.append((-pieces[i][1], i, rank[left], rank[right], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


class Codec:
    """Encoder and decoder of one model, with the words it has seen."""

    def __init__(self, data: bytes, threads: int = THREADS):
        # Read by the library when its threads start, so set before the first batch.
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        model = parse_model(data)
        if not model.escape_whitespaces or model.marker_is_suffix:
            raise ValueError("only models that mark the beginnings of words are read")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.pieces = [text for text, _, _ in model.pieces]
        unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.skipped = {i for i, p in enumerate(model.pieces) if p[2] in (CONTROL,)}
        if model.kind == BPE_MODEL:
            core = models.BPE(
                vocab={text: i for i, text in enumerate(self.pieces)}, merges=merges_of(model.pieces),
                unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback,
            )
        elif model.kind == UNIGRAM_MODEL:
            core = models.Unigram([(t, s) for t, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
        else:
            raise ValueError("only unigram and merge models are read")
        self.core = Tokenizer(core)
        # Words handed over together are cut at spaces, of which a normalised text has none.
        self.joined = Tokenizer(core)
        self.joined.pre_tokenizer = pre_tokenizers.Split(Regex(" "), "removed")
        self.charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        self.model = model
        # Words can be encoded one by one if no piece goes on after a word has ended.
        self.by_word = not any(MARK in text.lstrip(MARK) for text, _, kind in model.pieces if kind == NORMAL)
        self.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.starts = np.array([text.startswith(MARK) for text in self.pieces])
        self.words = RowsByWord(np.int32, CACHE_WORDS, self._ids)
        self._byte_table()

    def _byte_table(self) -> None:
        """What each piece gives in decoding, end to end: spaces for marks, bytes for byte pieces."""
        out = []
        for i, (text, _, kind) in enumerate(self.model.pieces):
            if i in self.skipped:
                out.append(b"")
            elif kind == BYTE and self.model.byte_fallback:
                out.append(bytes([int(text[3:5], 16)]))
            else:
                out.append(text.replace(MARK, " ").encode())
        self.bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.byte_lengths = np.array([len(x) for x in out], dtype=np.int64)
        self.byte_begins = np.cumsum(self.byte_lengths) - self.byte_lengths
        # Pieces that look like a byte but are none, or the other way round, are left to the decoder.
        self.odd = np.array([text.startswith("<0x") != (kind == BYTE) for text, _, kind in self.model.pieces])

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = " ".join(w for w in text.split(" ") if w)
        if not text:
            return ""
        text = text.replace(" ", MARK)
        return MARK + text if self.model.add_dummy_prefix else text

    def _words(self, text: str) -> list[str]:
        """Words with the marks before them; their ends are where no piece can cross."""
        if not self.by_word:
            return [text] if text else []
        words: list[str] = []
        marks = 0
        first = True
        for part in text.split(MARK):
            marks += not first
            first = False
            if part:
                words.append(MARK * marks + part)
                marks = 0
        if marks:
            words.append(MARK * marks)
        return words

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has."""
        # A plain word has its one mark in front, and so its first piece alone begins with a mark.
        joined = [w for w in words if len(w) > 1 and w[0] == MARK and MARK not in w[1:] and " " not in w]
        texts = [" ".join(joined[i:i + JOINED]) for i in range(0, len(joined), JOINED)]
        flat = np.concatenate([np.empty(0, dtype=np.int32), *self._encoded(self.joined, texts)])
        starts = np.flatnonzero(self.starts[flat])
        if len(starts) != len(joined) or (len(starts) and starts[0]):
            joined, flat, starts = [], flat[:0], starts[:0]
        if len(joined) == len(words):
            return flat, np.diff(np.append(starts, len(flat)))
        taken = set(joined)
        rest = [w for w in words if w not in taken]
        lists = self._encoded(self.core, rest)
        place = {w: i for i, w in enumerate(joined + rest)}
        every = np.concatenate([flat, *lists])
        lengths = np.concatenate([np.diff(np.append(starts, len(flat))), np.array([len(x) for x in lists], dtype=np.int64)])
        order = np.array([place[w] for w in words])
        return every[spread((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]

    def _encoded(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(e.ids, dtype=np.int32)
            for i in range(0, len(texts), BATCH_TEXTS)
            for e in tokenizer.encode_batch_fast(texts[i:i + BATCH_TEXTS], add_special_tokens=False)
        ]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts without nulls."""
        if self.model.remove_extra_whitespaces and not self.charsmap:
            texts = pc.utf8_trim(texts, " ")
        easy = self._easy(texts)
        split = pc.split_pattern(texts.filter(pa.array(easy)), " ")
        mark = pa.scalar(MARK, pa.large_string())
        words = pc.binary_join_element_wise(mark, split.flatten(), pa.scalar("", pa.large_string()))
        odd = [self._words(self.normalise(t)) for t in texts.filter(pa.array(~easy)).to_pylist()]
        counts = np.empty(len(texts), dtype=np.int64)
        counts[easy], counts[~easy] = np.diff(split.offsets.to_numpy()), [len(w) for w in odd]
        begins = np.empty(len(texts), dtype=np.int64)
        begins[easy] = np.cumsum(counts[easy]) - counts[easy]
        begins[~easy] = len(words) + np.cumsum(counts[~easy]) - counts[~easy]
        both = pa.concat_arrays([words, pa.array([w for ws in odd for w in ws], pa.large_string())])
        numbers = self.words.numbers(both)[spread(begins, counts)]
        ids, lengths = self.words.gather(numbers)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], np.cumsum(sums_of(lengths, bounds))])

    def _easy(self, texts: pa.Array) -> np.ndarray:
        """Which texts are words between single spaces, so that nothing else needs care."""
        if self.charsmap or not (self.by_word and self.model.add_dummy_prefix):
            return np.zeros(len(texts), dtype=bool)
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $|^$"), pc.match_substring(texts, MARK))
        return ~odd.to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, offsets = self.encode_array(pa.array(texts, pa.large_string()))
        return np.split(ids, offsets[1:-1]) if texts else []

    def decode_array(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The normalised texts of ids, end to end: spaces for marks, without the first one that encoding adds."""
        begins, lengths = self.byte_begins[ids], self.byte_lengths[ids]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if self.model.add_dummy_prefix and len(filled):
            first = offsets[filled]
            leads = (lengths[first] > 0) & (self.bytes[np.minimum(begins[first], len(self.bytes) - 1)] == 0x20)
            begins[first[leads]] += 1
            lengths[first[leads]] -= 1
        data = self.bytes[spread(begins, lengths)]
        ends = np.concatenate([[0], np.cumsum(sums_of(lengths, offsets))])
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
        plain = not self.odd[ids].any() and not (len(filled) and (self.byte_lengths[ids[offsets[filled]]] == 0).any())
        if plain:
            try:
                out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.large_string())
                if not pc.any(pc.match_substring(out, MARK)).as_py():
                    return out
            except pa.ArrowInvalid:
                pass
        return pa.array([self._decode(x) for x in np.split(ids, offsets[1:-1])][:len(offsets) - 1], pa.large_string())

    def _decode(self, ids: np.ndarray) -> str:
        text = self._join([self.pieces[i] for i in ids.tolist() if i not in self.skipped]).replace(MARK, " ")
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text

    def decode(self, batch: list) -> list[str]:
        ids = [np.asarray(x, dtype=np.int32) for x in batch]
        offsets = np.cumsum([0] + [len(x) for x in ids])
        return self.decode_array(np.concatenate([np.empty(0, dtype=np.int32), *ids]), offsets).to_pylist()

    def _join(self, pieces: list[str]) -> str:
        plain = "".join(pieces)
        # Only texts with byte pieces need the decoder that puts bytes together.
        return self.decoder.decode(pieces) if self.model.byte_fallback and "<0x" in plain else plain


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Numbers of the texts whose ids differ from those of the original library."""
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = Codec(data).encode(texts)
    theirs = original.encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(ours, theirs)) if a.tolist() != b]


PROBES = (
    "", " ", "plain words", "  a  b   ", "\té\n日本 😀", "▁▁a a▁b", "x" * 50, "ﬁ½ Ⅷ \u00a0", "<s> <0x41> </s>", "don't 12,345.67!",
)


@functools.lru_cache(maxsize=4)
def verified(data: bytes) -> bytes:
    """The model, if the rebuilt tokenizer gives the original's ids on odd texts; else an error."""
    wrong = parity(data, list(PROBES))
    if wrong:
        raise ValueError(f"the rebuilt model differs from the original on {PROBES[wrong[0]]!r}")
    return data


def codec_of(data: bytes, threads: int) -> Codec:
    """The codec of a model; a Python worker keeps the last one with its words."""
    return kept_in_worker(("codec", data), lambda: Codec(data, threads))


def _id_lists(ids: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=null)


def _encoded(
    documents: DataFrame, model: bytes, text: str, ids: str, threads: int, decoded: str | None
) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(verified(model))
    kept = documents.drop(*({ids, decoded} - {text, None}))
    fields = [*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, threads)
        for batch in batches:
            for part, texts in array_slices(batch, text, BLOCK_BYTES):
                encoded, offsets = codec.encode_array(texts)
                null = part.column(text).is_null()
                columns = [*part.columns, _id_lists(encoded, offsets, null)]
                if decoded:
                    back = codec.decode_array(encoded, offsets)
                    columns.append(pc.if_else(null, pa.scalar(None, pa.large_string()), back).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, T.StructType(fields))


def encode_texts(documents: DataFrame, model: bytes, text: str = "text", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """The rows with a column of token ids. ``model`` is the content of a model file."""
    return _encoded(documents, model, text, ids, threads, None)


def decode_ids(rows: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded", threads: int = THREADS) -> DataFrame:
    """The rows with the texts of their ids."""
    sent = rows.sparkSession.sparkContext.broadcast(verified(model))
    kept = rows.drop(text) if text != ids else rows
    fields = [*kept.schema.fields, T.StructField(text, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, threads)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            texts = codec.decode([i or [] for i in lists])
            column = pa.array([None if i is None else t for i, t in zip(lists, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def encode_and_decode(documents: DataFrame, model: bytes, text: str = "text", threads: int = THREADS) -> DataFrame:
    """The rows with ``ids``, ``decoded`` and ``same``: decoding gives the text back.

    Both steps are one task, so that ids do not travel between them.
    """
    rows = _encoded(documents, model, text, "ids", threads, "decoded")
    return rows.withColumn("same", F.col("decoded").eqNullSafe(F.col(text)))
