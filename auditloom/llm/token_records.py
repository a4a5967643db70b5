"""Token ids as length-delimited binary records, with an offset index.

Format. A part file is a sequence of records in ascending order of key; the parts follow
each other by number. All numbers are little-endian. A record is

    u64 length of the body | u32 masked checksum of these 8 bytes
    body | u32 masked checksum of the body | one byte 0x0A

and its body is i64 key, u8 whether the key is there, u8 width of an id in bytes (2 or
4), then the ids. A checksum is CRC-32, masked by turning it right by 15 bits and adding
0xA282EAD8. Part files have the name of Spark's text writer, which commits them: a lost
executor's half-written parts never show. The index is a Parquet table (part, position,
key, offset, length) beside them, so that records can be read in any order.

Null texts are empty; with the end id they have one id. Repeated rows are records of
their own; rows of one key follow their texts' hashes. Null keys come first. A very long
text is one record. An empty table has no records. Other columns are not looked at.
"""

import bisect
import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.shared import kept_in_worker, stored
from auditloom.llm.word_tables import RowsByWord, array_slices, spread, sums_of

# Text bytes of one part file and of a block, and different stems that a worker remembers. Blocks of 1 MB with
# 400,000 stems are slower and take a little more memory.
PART_BYTES = 16 << 20
BLOCK_BYTES = 2 << 20
CACHE_WORDS = 250_000
_MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """One record, without the last byte, which the writer adds."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = struct.pack("<qBB", key or 0, key is not None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(key, ids, place of the next record) of the record at a place; damage is an error."""
    (length,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if masked(data[at:at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    body = data[at + 12:at + 12 + length]
    if len(body) < length or masked(body) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"damaged record at {at}")
    key, there, width = struct.unpack_from("<qBB", body)
    return key if there else None, np.frombuffer(body, dtype=f"<u{width}", offset=10), at + length + 17


# Signs that the tokenizer keeps apart from a letter before them.
_TRAILING = "!#$%&*,.:;?|"
# The steps of a tokenizer whose words can be encoded one by one: white space is dropped,
# letters are lower-cased and kept apart from other signs, bytes stand for themselves.
_NORMALISER = ["NFC", ("Replace", r"\s+", " "), "Lowercase"]
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words that are handed to the library in one text, and texts in one batch.
_JOINED, _BATCH = 50, 400
# Words whose ids are gathered at a time: more would only take memory.
_GATHERED = 1 << 15


def _cuts_words(definition: dict) -> bool:
    """Whether a tokenizer takes these steps, so that texts can be cut at white space first."""
    steps = [
        (n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"]
        for n in (definition.get("normalizer") or {}).get("normalizers", [])
    ]
    cuts = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = definition["model"]
    return (
        steps == _NORMALISER and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex") == _CUTS and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in definition.get("added_tokens", []))
    )


def _byte_signs() -> str:
    """What the tokenizer writes for each byte, a visible sign; spaces stay, as they part words here."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unseen = iter(range(256, 512))
    signs = [chr(b if b in seen else next(unseen)) for b in range(256)]
    return "".join([*signs[:32], " ", *signs[33:]])


_SIGNS = _byte_signs()
# Small letters of the first blocks of Unicode, which the tokenizer's first steps leave as they are.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)


def _stem_and_tail(word: str) -> tuple[str, str, bool]:
    """A word as a stem and the signs behind it, which are always encoded apart.

    The last value says whether the stem is plain: lower-case letters of the first blocks of
    Unicode and nothing else. Letters further on may be unknown to the tokenizer as letters,
    and a letter whose lower case is two signs may end in a mark; words that end so stay whole.
    """
    stem = word.rstrip(_TRAILING)
    if stem.isascii() and stem.isalpha():
        return stem.lower(), word[len(stem):], True
    last = stem[-1:].lower()
    if len(stem) < len(word) and not (len(last) == 1 and last < "\u0250" and last.isalpha()):
        return word, "", False
    low = stem.lower()
    if low.isalpha() and (low.isascii() or (len(low) == len(stem) and max(low) < "\u0250")):
        return low, word[len(stem):], True
    return stem, word[len(stem):], False


def _stems_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of small letters and signs behind them as stems and tails; the others whole, with empty tails."""
    tails = pc.utf8_ltrim(words, characters=_LETTERS)
    plain = pc.equal(pc.binary_length(pc.ascii_rtrim(tails, characters=_TRAILING)), 0)
    stems = pc.if_else(plain, pc.ascii_rtrim(words, characters=_TRAILING), words)
    return stems, pc.if_else(plain, tails, "")


def _are_letters(words: pa.Array) -> pa.Array:
    """Whether words are small letters and nothing else."""
    rest = pc.binary_length(pc.utf8_ltrim(words, characters=_LETTERS))
    return pc.and_(pc.equal(rest, 0), pc.greater(pc.binary_length(words), 0))


def _picked(values: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie end to end those with the given numbers, and their lengths."""
    found = lengths[order]
    return values[spread((np.cumsum(lengths) - lengths)[order], found)], found


def _laid(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and the length of each list."""
    arrays = [np.array(x, dtype=np.uint32) for x in lists]
    return np.concatenate([np.empty(0, dtype=np.uint32), *arrays]), np.array([len(x) for x in arrays], dtype=np.int64)


class Encoder:
    """A tokenizer for whole blocks of texts.

    If its first steps keep words apart, texts are cut at white space, and each different
    word is looked up once and each different stem encoded once; plain stems skip the first
    steps, which would not change them, and go to the model many in one text. Any other
    tokenizer takes whole texts.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        said = json.loads(definition)
        self.by_word = _cuts_words(said)
        if self.by_word:
            vocabulary = said["model"]["vocab"]
            # The same pieces in memory, without the first steps.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            # A mark may join a small letter and not the capital, and a special word is read before letters are.
            special = [f"(?i:{re.escape(t['content'])})" for t in said.get("added_tokens", [])]
            self.keep_case = "|".join([r"\p{M}", *special])
        self.parts = RowsByWord(np.uint32, CACHE_WORDS, self._words)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain stems, end to end, and their lengths; each ends with the only piece that may end a word."""
        joined = [" ".join(stems[i:i + _JOINED]).encode() for i in range(0, len(stems), _JOINED)]
        joined = [codecs.charmap_decode(t, "strict", _SIGNS)[0] for t in joined]
        ids = [np.empty(0, dtype=np.uint32)]
        for i in range(0, len(joined), _BATCH):
            ids += [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(joined[i:i + _BATCH], add_special_tokens=False)]
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.last[flat]) + 1
        return (flat, np.diff(ends, prepend=0)) if len(ends) == len(stems) else _laid(self._whole(stems))

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, end to end, and their lengths."""
        split = [_stem_and_tail(w) for w in words]
        plain = dict.fromkeys(stem for stem, _, is_plain in split if is_plain)
        rest = dict.fromkeys(stem for stem, _, is_plain in split if not is_plain)
        rest.update(dict.fromkeys(tail for _, tail, _ in split))
        parts = [self._plain(list(plain)), _laid(self._whole(list(rest)))]
        plain = dict(zip(plain, range(len(plain))))
        rest = dict(zip(rest, range(len(plain), len(plain) + len(rest))))
        order = np.array([x for stem, tail, is_plain in split for x in ((plain if is_plain else rest)[stem], rest[tail])], dtype=np.int64)
        ids, lengths = _picked(*(np.concatenate(x) for x in zip(*parts)), order)
        return ids, lengths.reshape(-1, 2).sum(axis=1)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = _are_letters(pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)
        parts = [self._plain(list(compress(words, plain))), self._others(list(compress(words, ~plain)))]
        order = np.empty(len(words), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        return _picked(*(np.concatenate(x) for x in zip(*parts)), order)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts, each followed by the end id."""
        if not self.by_word:
            lists = [np.array([*ids, end], dtype=np.uint32) for ids in self._whole(texts.to_pylist())]
            return np.concatenate([np.empty(0, dtype=np.uint32), *lists]), np.cumsum([0, *map(len, lists)])
        # Words that differ in the case of ASCII letters have the same ids, and are looked up once.
        kept = pc.match_substring_regex(texts, self.keep_case)
        split = pc.ascii_split_whitespace(pc.if_else(kept, texts, pc.ascii_lower(texts)))
        words = split.flatten()
        bounds = split.offsets.to_numpy().astype(np.int64)
        told = words.dictionary_encode()
        stems, tails = _stems_and_tails(told.dictionary)
        tailed = pc.not_equal(tails, "").to_numpy(zero_copy_only=False)
        numbers = self.parts.numbers(pa.concat_arrays([stems, tails.filter(pa.array(tailed))]))
        stems, tails = np.split(numbers, [len(tailed)])
        ids, lengths = self.parts.gather(np.insert(stems, np.flatnonzero(tailed) + 1, tails))
        lengths = sums_of(lengths, np.concatenate([[0], np.cumsum(1 + tailed)]))
        at = told.indices.to_numpy()
        begins, lengths = (np.cumsum(lengths) - lengths)[at], lengths[at]
        cuts = range(0, len(at), _GATHERED)
        ids = np.concatenate([ids[:0], *(ids[spread(begins[i:i + _GATHERED], lengths[i:i + _GATHERED])] for i in cuts)])
        sizes = sums_of(lengths, bounds - bounds[0])
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(offsets[-1], end, dtype=np.uint32)
        within = np.ones(len(out), dtype=bool)
        within[offsets[1:] - 1] = False
        out[within] = ids
        return out, offsets


def encoder_of(definition: str) -> Encoder:
    return kept_in_worker(("encoder", definition), lambda: Encoder(definition))


def _bounds(rows: DataFrame, parts: int, count: int, least: int) -> list[tuple]:
    """First rows of all parts but the first, so that parts hold about as many bytes of text.

    They come from a sample of rows, like those of Spark's own range partitioning; the
    row number tells equal rows apart, so that any number of copies is split.
    """
    share = min(1.0, max(200 * parts, 2000) / max(count, 1))
    picked = rows.select("key", "order", "number", F.octet_length("text").alias("n"))
    if share < 1:
        picked = picked.sample(fraction=share, seed=7)
    picked = sorted((_place(r["key"], r["order"], r["number"]), r["n"] + least) for r in picked.collect())
    sizes = np.cumsum([n for _, n in picked])
    if not len(sizes):
        return []
    at = np.searchsorted(sizes, sizes[-1] * np.arange(1, parts) / parts)
    return sorted({picked[i][0] for i in at})


def _place(key: int | None, order: int, number: int) -> tuple:
    return key is not None, key or 0, order, number


def write_records(
    documents: DataFrame, folder: str, definition: str, end: int, key: str = "doc_id", text: str = "text",
    part_bytes: int = PART_BYTES,
) -> None:
    """Encode and write the texts below a folder: part files in ``data``, then the ``index``.

    ``definition`` is the JSON text of a tokenizer. Texts are encoded where they are read;
    their records, not the texts, are dealt by ranges of keys into parts of about
    ``part_bytes`` of text, sorted and written there.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("order"), F.monotonically_increasing_id().alias("number"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // part_bytes))
    sent = spark.sparkContext.broadcast((definition, _bounds(rows, parts, size["rows"], 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, bounds = sent.value
        encoder = encoder_of(definition)
        for batch in batches:
            for part, texts in array_slices(batch, "text", BLOCK_BYTES):
                ids, offsets = encoder.encode(texts, end)
                keys, orders, numbers = (part.column(c).to_pylist() for c in ("key", "order", "number"))
                frames = [frame(k, ids[a:b]) for k, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist())]
                to = [bisect.bisect_right(bounds, _place(*place)) for place in zip(keys, orders, numbers)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to, pa.int32()), *(part.column(c) for c in ("key", "order", "number")),
                        pa.array(frames, pa.binary()),
                    ],
                    names=["part", "key", "order", "number", "frame"],
                )

    encoded = rows.mapInArrow(run, "part int, key bigint, order bigint, number bigint, frame binary")
    framed = encoded.repartitionById(parts, "part").sortWithinPartitions("key", "order", "number")
    # The text writer puts down the bytes as they are and ends each row with one byte.
    framed.select(F.col("frame").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(f"{folder}/data")
    index_parts(spark, folder).write.parquet(f"{folder}/index")


def _part_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, content) of the part files, one at a time in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("part"), "content")


def index_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, position, key, offset, length) of every record, read from the part files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                data, at, keys, offsets = content.as_py(), 0, [], []
                while at < len(data):
                    (length,) = struct.unpack_from("<Q", data, at)
                    stored_key, there = struct.unpack_from("<qB", data, at + 12)
                    keys.append(stored_key if there else None)
                    offsets.append(at)
                    at += length + 17
                bounds = np.array([*offsets, len(data)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int64()),
                        pa.array(keys, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)),
                    ],
                    names=["part", "position", "key", "offset", "length"],
                )

    return _part_files(spark, folder).mapInArrow(
        run, "part bigint, position bigint, key bigint, offset bigint, length bigint"
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, rows) with rows (position, key, ids) of part files, some thousand at a time."""
    for batch in batches:
        for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
            data, at, position, rows = content.as_py(), 0, 0, []
            while at < len(data):
                key, ids, at = unframe(data, at)
                rows.append((position, key, ids.astype("<u4")))
                position += 1
                if len(rows) == 2000:
                    yield part, rows
                    rows = []
            if rows:
                yield part, rows


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(part, position, key, ids) of all records; damage is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _records(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                ],
                names=["part", "position", "key", "ids"],
            )

    return _part_files(spark, folder).mapInArrow(run, "part bigint, position bigint, key bigint, ids array<int>")


def record_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of all records in the files.

    ``start`` counts the ids of all records before. Parts are summed first, and their
    sums, a row for each part file, added up in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_before, total = None, 0
        for part, rows in _records(batches):
            if part != part_before:
                part_before, total = part, 0
            sizes = np.array([len(r[2]) for r in rows], dtype=np.int64)
            ends = total + np.cumsum(sizes)
            total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(ends - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64()),
                ],
                names=["part", "key", "inside", "n_tokens", "ids_crc32"],
            )

    rows = stored(
        _part_files(spark, folder).mapInArrow(
            run, "part bigint, key bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
        ),
        "records",
    )
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "part").select(
        "key", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_entries(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """(part, offset, key, ids) of the records at the entries (part, offset) of the index.

    The wanted offsets of a part meet its file; other parts are not read on. Entries may
    repeat and come in any order; one that is no record's place is an error.
    """
    wanted = entries.groupBy(F.col("part").alias("wanted")).agg(F.collect_list("offset").alias("offsets"))
    rows = _part_files(spark, folder).join(wanted, F.col("part") == F.col("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content, offsets in zip(batch.column("part").to_pylist(), batch.column("content"), batch.column("offsets").to_pylist()):
                data = content.as_py()
                found = [(part, at, *unframe(data, at)[:2]) for at in offsets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([r[i] for r in found], pa.int64()) for i in range(3)),
                        pa.array([r[3].astype(np.int32) for r in found], pa.list_(pa.int32())),
                    ],
                    names=["part", "offset", "key", "ids"],
                )

    return rows.select("part", "content", "offsets").mapInArrow(run, "part bigint, offset bigint, key bigint, ids array<int>")
