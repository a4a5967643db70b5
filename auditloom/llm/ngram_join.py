"""Jaccard join of texts over word n-grams, as a blocked sparse matrix product.

The rows of the incidence matrix are texts, its columns n-grams; the product of the
matrix with its transpose holds the sizes of all overlaps. Only the parts of it that can
hold a link are worked out:

* Rows with the same set are one row.
* Sizes decide which rows can link at all, and in how many n-grams a linked pair may
  differ at most. The columns are cut into more blocks than that, so that a linked pair
  has a filled block in which both rows are the same. Where sets are too small for that,
  or a set leaves too many blocks empty, the least columns that the sizes ask for take
  the blocks' place. Rows are grouped by what they have in common, and groups that share
  a row are joined into clusters. Nothing outside a cluster can link.
* A cluster's rows are dealt into blocks of bounded size, by size of set, and each pair
  of blocks within reach of each other is one task. It adds up overlaps column block by
  column block and discards rows whose overlap, with all that is still to come, stays
  below the bound that the two sizes set.

A task gives the links that hold its components together, never all pairs. Links are
exact but for collisions of 64-bit hashes, of n-grams within a pair and of whole sets; no
partner is capped or sampled.

Null texts, and texts without words, have an empty set and link with nothing. Repeated
rows share a set. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.components import connected_components
from auditloom.llm.grams import gram_sets, mix, sum_by
from auditloom.llm.shared import let_go, shield, slices, stored

# At least so many blocks more than the bound asks for. Linked sets agree in one block more
# than that, so that sets with no more empty blocks agree in a filled one.
SPARE_BLOCKS = 2
# Rows and n-grams of a block of rows; a task holds two blocks.
BLOCK_ROWS, BLOCK_GRAMS = 512, 2_000_000
COLUMN_BLOCK = 2048

_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_SETS = "_id bigint, text_hash bigint, n bigint, node bigint"


def size_steps(longest: int, percent: int) -> list[int]:
    """Least sizes of the size classes: sizes that can link are in the same or the next class."""
    steps = [1]
    while steps[-1] <= longest:
        steps.append(steps[-1] * 100 // percent + 1)
    return steps


def blocks_of_classes(steps: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, spare blocks) for pairs whose smaller set is in each size class.

    Spare blocks make up for those that most sets leave empty. 0 blocks say that there is
    no such number, as sets are too small.
    """
    blocks, spares = [], []
    for smallest, beyond in zip(steps, steps[1:]):
        largest = beyond - 1
        differing = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
        for spare in range(SPARE_BLOCKS, differing + 12):
            count = differing + 1 + spare
            empty = count * np.exp(-smallest / count)
            if empty + 3 * np.sqrt(empty) <= spare:
                break
        else:
            count = spare = 0
        blocks.append(count)
        spares.append(spare)
    return np.array(blocks), np.array(spares)


def least_columns(grams: np.ndarray, percent: int, together: int) -> np.ndarray:
    """Keys of the n-grams with the least hashes, ``together`` at a time.

    Linked sets of one size or another share percent / 100 of the larger one. So their
    first ``together`` n-grams in common are among the first ones of each, as many as
    there are beyond that share, and ``together`` more.
    """
    first = grams[:len(grams) - -(-percent * len(grams) // 100) + together]
    if together == 1:
        return mix(first ^ _C3)
    one, other = np.triu_indices(len(first), 1)
    return mix(mix(first[one] + _C2) + first[other])


def block_keys(grams: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every set, the keys of its column blocks, for partners of its own class and the one below.

    Beside them is the room of each key: twice the number of keys of its kind that the set
    could do without, as it has more equal blocks with every partner, and one more for the
    class below; negative if it can do without none.
    """
    sizes = np.diff(offsets)
    steps = size_steps(int(sizes.max(initial=1)) * 100 // percent + 1, percent)
    classes = np.searchsorted(steps, sizes, side="right") - 1
    counts, spares = blocks_of_classes(steps, percent)
    # Different sets that link share two n-grams from about two thirds on.
    together = 2 if percent >= 67 else 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    values = mix(grams ^ _C1)
    parts: list[list[np.ndarray]] = [[] for _ in sizes]
    rooms: list[list[np.ndarray]] = [[] for _ in sizes]
    small: set[int] = set()
    sparse: set[int] = set()
    for below in (0, 1):
        level = classes - below
        real = (level >= 0) & (sizes > 0)
        used = np.where(real, counts[np.maximum(level, 0)], 0)
        small.update(np.flatnonzero(real & (used == 0)).tolist())
        chosen = (used > 0)[text]
        if not chosen.any():
            continue
        owner, inside = text[chosen], values[chosen]
        block = ((grams[chosen] >> np.uint64(32)) * used[owner].astype(np.uint64)) >> np.uint64(32)
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(fresh)
        held = sum_by(inside, np.append(at, len(owner)))
        labels = level[owner[at]].astype(np.uint64) * _C2 + block[at]
        keys = mix(mix(labels + _C1) + held)
        bounds = np.searchsorted(owner[at], np.arange(len(sizes) + 1))
        for i in np.flatnonzero(used > 0).tolist():
            mine = keys[bounds[i]:bounds[i + 1]]
            parts[i].append(mine)
            room = int(spares[level[i]] - (used[i] - len(mine)))
            rooms[i].append(np.full(len(mine), 2 * room + below, dtype=np.int32))
            if room < 0:
                sparse.add(i)
    for which, number in ((small, together), (sparse, 1)):
        for i in which:
            parts[i].append(least_columns(grams[offsets[i]:offsets[i + 1]], percent, number))
            rooms[i].append(np.full(len(parts[i][-1]), -1, dtype=np.int32))
    return (
        [np.concatenate(p) if p else np.empty(0, dtype=np.uint64) for p in parts],
        [np.concatenate(r) if r else np.empty(0, dtype=np.int32) for r in rooms],
    )


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the n-gram sets of their texts."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    lengths = pc.binary_length(texts).to_numpy()
    for start, end in slices(lengths):
        part = texts.slice(start, end - start)
        data = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths[start:end])]).astype(np.int64)
        yield batch.slice(start, end - start), *gram_sets(data, offsets, size)


def _nodes(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, the same for equal sets wherever they are worked out."""
    return mix(sum_by(mix(grams + _C1), offsets) ^ mix(sum_by(mix(grams ^ _C2), offsets))).view(np.int64)


def _digest(size: int):
    """Sizes and hashes of the sets of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part, grams, offsets in _sets(batch, size):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"), part.column("text_hash"), pa.array(np.diff(offsets), pa.int64()),
                        pa.array(_nodes(grams, offsets)),
                    ],
                    names=["_id", "text_hash", "n", "node"],
                )
        let_go()

    return run


def _keys(size: int, percent: int):
    """(node, key, room) of the column blocks of each set, once per set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for batch in batches:
            for _, grams, offsets in _sets(batch, size):
                nodes, (keys, rooms) = _nodes(grams, offsets), block_keys(grams, offsets, percent)
                fresh = [i for i, node in enumerate(nodes.tolist()) if node not in seen and not seen.add(node)]
                if fresh:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(nodes[fresh], [len(keys[i]) for i in fresh])),
                            pa.array(np.concatenate([keys[i] for i in fresh]).view(np.int64)),
                            pa.array(np.concatenate([rooms[i] for i in fresh])),
                        ],
                        names=["node", "key", "room"],
                    )
        let_go()

    return run


def _packed(frame: DataFrame, text: str) -> DataFrame:
    """The rows with their texts compressed, for a join that moves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        codec = zstandard.ZstdCompressor()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at).cast(pa.large_binary())
            small = [None if not t.is_valid else codec.compress(t.as_buffer()) for t in column]
            yield batch.set_column(at, text, pa.array(small, pa.binary()))
        let_go()

    fields = ", ".join(
        f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in frame.schema
    )
    return frame.mapInArrow(run, fields)


def _unpack(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows with the bytes of their texts."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index(text)
        # Texts are longer again here, so only some rows at a time.
        for start in range(0, len(batch), 500):
            part = batch.slice(start, 500)
            texts = [None if t is None else codec.decompress(t) for t in part.column(at).to_pylist()]
            yield part.set_column(at, text, pa.array(texts, pa.binary()))


def _unpacked(frame: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in _unpack(batches, text):
            at = part.schema.get_field_index(text)
            yield part.set_column(at, text, part.column(at).cast(pa.string()))
        let_go()

    fields = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, fields)


def _fetch(size: int):
    """The sets of cluster rows from their packed texts, each once per task of Spark.

    Texts are unpacked in the same Python step: two steps in one stage take two workers for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for batch in _unpack(batches, "text"):
            for part, grams, offsets in _sets(batch, size):
                nodes = part.column("node").to_pylist()
                same = _nodes(grams, offsets) == part.column("node").to_numpy()
                chosen = [
                    i for i in np.flatnonzero(same).tolist() if nodes[i] not in seen and not seen.add(nodes[i])
                ]
                packed = [grams[offsets[i]:offsets[i + 1]].tobytes() for i in chosen]
                kept = part.take(pa.array(chosen, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("node"), pa.array(packed, pa.binary()), kept.column("tasks")],
                    names=["node", "grams", "tasks"],
                )
        let_go()

    return run


def linked_rows(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each row of a block, the first row of its component."""
    sizes = np.array([len(s) for s in sets])
    text = np.repeat(np.arange(len(sets)), sizes)
    columns, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[number] > 1
    order = np.argsort(number[shared], kind="stable")
    _, column = np.unique(number[shared][order], return_inverse=True)
    text = text[shared][order]
    least = -(-percent * (sizes[:, None] + sizes[None, :]) // (100 + percent))
    overlap = np.zeros((len(sets), len(sets)), dtype=np.int64)
    left = np.bincount(text, minlength=len(sets))
    alive = np.arange(len(sets))
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMN_BLOCK):
        lo, hi = np.searchsorted(column, [start, start + COLUMN_BLOCK])
        block = np.zeros((len(sets), COLUMN_BLOCK), dtype=np.float32)
        block[text[lo:hi], column[lo:hi] - start] = 1
        left = left - np.bincount(text[lo:hi], minlength=len(sets))
        rows = block[alive]
        grid = np.ix_(alive, alive)
        overlap[grid] += (rows @ rows.T).astype(np.int64)
        reach = overlap[grid] + np.minimum.outer(left[alive], left[alive]) >= least[grid]
        np.fill_diagonal(reach, False)
        alive = alive[reach.any(axis=1)]
        if not len(alive):
            return np.arange(len(sets))
    linked = np.zeros(overlap.shape, dtype=bool)
    grid = np.ix_(alive, alive)
    linked[grid] = overlap[grid] >= least[grid]
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        lower = np.where(linked, label[None, :], len(sets)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _product(percent: int):
    """Links that hold together the components of each task; rows come sorted by task."""

    def links(rows: dict[int, bytes]) -> pa.RecordBatch:
        ids = np.array(sorted(rows), dtype=np.int64)
        label = linked_rows([np.frombuffer(rows[i], dtype=np.uint64) for i in ids.tolist()], percent)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        task, rows = None, {}
        for batch in batches:
            for name, row, grams in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "grams"))):
                if name != task:
                    if len(rows) > 1:
                        yield links(rows)
                    task, rows = name, {}
                rows[row] = grams
        if len(rows) > 1:
            yield links(rows)
        rows = {}
        let_go()

    return run


def _tasks(classes: DataFrame, percent: int) -> DataFrame:
    """Cluster rows (component, node, n, ..) with ``tasks``: the pairs of blocks they belong to."""
    total = classes.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    total = total.where("rows > 1")
    small = (F.col("rows") <= 2 * BLOCK_ROWS) & (F.col("grams") <= 2 * BLOCK_GRAMS)
    # Size classes by the same rule as above, counted in steps of the logarithm: sizes that
    # can link are at most one apart, with a little to spare for rounding.
    width = np.log(100 / percent) + 1e-9
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(width))).cast("int")
    rows = classes.join(total, "component").withColumn("level", level)
    large = rows.where(~small)
    levels = large.groupBy("component", "level").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    for step in (-1, 0, 1):
        near = levels.select("component", (F.col("level") - step).alias("level"), F.col("blocks").alias(f"blocks{step}"))
        large = large.join(near, ["component", "level"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks0")).cast("int")
    large = large.withColumn("mine", mine)

    def names(step: int) -> Column:
        there = F.coalesce(F.col(f"blocks{step}"), F.lit(0))

        def name(other: Column) -> Column:
            here = F.format_string("%05d.%08d", "level", "mine")
            far = F.format_string("%05d.%08d", F.col("level") + step, other)
            return F.concat_ws(":", F.col("component").cast("string"), F.least(here, far), F.greatest(here, far))

        return F.when(there > 0, F.transform(F.sequence(F.lit(0), there - 1), name)).otherwise(F.array().cast("array<string>"))

    large = large.withColumn("tasks", F.concat(names(-1), names(0), names(1)))
    few = rows.where(small).withColumn("tasks", F.array(F.col("component").cast("string")))
    columns = ["node", "first", "tasks"]
    return few.select(columns).unionByName(large.select(columns))


def _joined(documents: DataFrame, doc: str, text: str, size: int, percent: int) -> DataFrame:
    """Per row: its key (_id, text_hash), n, component_id, and the key of the row that stands for its component."""
    pairs = documents.select(
        F.col(doc).cast("bigint").alias("_id"), F.col(text).alias("text"), text_hash(text).alias("text_hash")
    )
    digests = stored(pairs.mapInArrow(_digest(size), _SETS), "sets")
    filled = digests.where("n > 0")
    first = F.min(F.struct("_id", "text_hash")).alias("first")
    classes = stored(filled.groupBy("node").agg(F.min("n").alias("n"), first), "classes")

    keyed = pairs.select("text").mapInArrow(_keys(size, percent), "node bigint, key bigint, room int")
    clusters = connected_components(_near(keyed))
    members = stored(clusters.withColumnRenamed("id", "node").join(classes, "node"), "members")

    # The texts of cluster rows, one for each set, come once more.
    tasks = stored(_tasks(members, percent), "tasks").select("node", "first", "tasks")
    tasks = tasks.select("node", F.col("first._id").alias("_of"), F.col("first.text_hash").alias("hash_of"), "tasks")
    # Sorted and merged at every size: how many rows are in clusters is not known beforehand.
    # By id and text, so that texts of one id do not meet each other.
    moved = _packed(pairs, "text")
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("text_hash") == F.col("hash_of"))
    fetched = moved.join(tasks.hint("merge"), same).select("text", "node", "tasks")
    sets = fetched.mapInArrow(_fetch(size), "node bigint, grams binary, tasks array<string>")
    dealt = sets.select("node", "grams", F.explode("tasks").alias("task")).repartition("task").sortWithinPartitions("task")
    links = stored(dealt.mapInArrow(_product(percent), "a bigint, b bigint"), "links")
    linked = connected_components(links).withColumnRenamed("id", "node")

    rooted = classes.join(linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    stands = rooted.groupBy("root").agg(F.min("first").alias("stands"))
    # Stored, so that a set with a third of all rows can be split in the join.
    of_class = stored(rooted.join(stands, "root").select("node", "stands"), "stands")
    some = filled.join(of_class, "node").select("_id", "text_hash", "n", F.col("stands._id").alias("component_id"), "stands")
    none = digests.where("n = 0").select(
        "_id", "text_hash", "n", F.col("_id").alias("component_id"), F.struct("_id", "text_hash").alias("stands")
    )
    return some.unionByName(none)


def _near(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) that chain the sets with an equal key; rows are (node, key, room).

    Linked sets have one key more in common than either has room for. So each set does
    without as many keys as it has room for, the most common ones first: the rarest key
    of those that a linked pair shares stays with both. These are mostly short passages
    that stand in very many sets.
    """
    same = Window.partitionBy("key")
    shared = stored(keyed.withColumn("sets", F.count("*").over(same)).where("sets > 1"), "shared")
    rank = F.row_number().over(Window.partitionBy("node", "room").orderBy(F.desc("sets"), "key"))
    kept = shared.withColumn("rank", rank).where((F.col("room") < 0) | (F.col("rank") > F.shiftright("room", 1)))
    chained = kept.select(F.col("node").alias("a"), F.lag("node").over(same.orderBy("node")).alias("b"))
    return stored(chained.where("b IS NOT NULL AND b <> a").distinct(), "near")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def join_ngrams(documents: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """(id, n, component_id) per row: size of its set, smallest id that links lead to.

    Rows link if 100 * overlap >= percent * union of their sets of ``size``-word n-grams.
    ``doc`` is an integer column, whose repeated and null values are allowed.
    """
    return _joined(documents, doc, text, size, percent).select(F.col("_id").alias("id"), "n", "component_id")


def keep_one(documents: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows without near duplicates: of linked rows, the one with the smallest id stays.

    Rows with one id and one text count as the same row, of which one stays. Rows without
    words stay. Columns keep their names and values, whatever they are called.
    """
    given = documents.columns
    documents, names = shield(documents)
    doc, text = names[doc], names[text]
    rows = stored(_joined(documents, doc, text, size, percent).where("n > 0"), "groups")
    own = F.struct("_id", "text_hash")
    gone = stored(rows.where(own != F.col("stands")).select("_id", "text_hash").distinct(), "gone")
    again = stored(
        rows.where(own == F.col("stands")).groupBy("_id", "text_hash").count().where("count > 1").drop("count"), "again"
    )
    keyed = _packed(documents.withColumns({"_id": F.col(doc).cast("bigint"), "text_hash_": text_hash(text)}), text)

    def same(other: DataFrame) -> Column:
        return keyed["_id"].eqNullSafe(other["_id"]) & (keyed["text_hash_"] == other["text_hash"])

    rest = keyed.join(gone.hint("merge"), same(gone), "left_anti")
    if again.isEmpty():
        return _unpacked(rest.select(documents.columns), text).toDF(*given)
    once = rest.join(again, same(again), "left_anti")
    # Equal rows are reduced in their tasks before they move.
    one = rest.join(again, same(again), "left_semi").dropDuplicates(["_id", "text_hash_"])
    return _unpacked(once.select(documents.columns).unionByName(one.select(documents.columns)), text).toDF(*given)
