import random
import re

import pyarrow as pa
import pytest

from auditloom.llm import decontaminate as clean

from tests.llm.conftest import PASSAGE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        sequence = WORD.findall((item_text or "").translate(LOWER))
        size = min(window, len(sequence))
        windows = {tuple(sequence[i:i + size]) for i in range(len(sequence) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), hit, found


def spans_to_words(spans):
    return {i for start, end in zip(spans[::2], spans[1::2]) for i in range(start, end)}


def test_automaton_against_brute_force():
    random.seed(2)
    for _ in range(300):
        letters = "abc"[: random.randint(1, 3)]
        window = random.choice([2, 3, 5])
        items = [(i, " ".join(random.choices(letters, k=random.randint(0, 9)))) for i in range(random.randint(0, 5))]
        automaton = clean.Automaton([(i, clean.words(t)) for i, t in items], window)
        for _ in range(5):
            text = " ".join(random.choices(letters + "x", k=random.randint(0, 25)))
            count, hit, found = brute(text, items, window)
            spans, items_found = automaton.hits(clean.words(text))
            assert (spans_to_words(spans), items_found) == (hit, found)
            assert spans == sorted(spans)


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_scan_of_all_rows(documents, benchmark, block_words):
    numbered = documents.selectExpr("monotonically_increasing_id() AS row", "text", "doc_id").cache()
    texts = {r.row: r.text for r in numbered.collect()}
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = clean.scan_benchmark(numbered, benchmark, row="row", block_words=block_words).withColumn("n_hit", clean.hit_words())
    got = rows.collect()
    assert len(got) == len(texts)
    for row in got:
        count, hit, found = brute(texts[row.row], items, 10)
        assert (row.n_words, spans_to_words(row.spans), set(row.items), row.n_hit) == (count, hit, found, len(hit))


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_repeated_and_missing_ids_are_rows_of_their_own(spark, benchmark, block_words):
    texts = [(7, PASSAGE), (7, f"so {PASSAGE}"), (7, "clean"), (None, "clean too"), (None, f"{PASSAGE} it was")]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    wanted = []
    for doc, text in texts:
        count, hit, found = brute(text, items, 10)
        wanted.append((str(doc), count, sorted(hit), sorted(found)))
    rows = clean.scan_benchmark(documents, benchmark, block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.n_words, sorted(spans_to_words(r.spans)), sorted(r["items"])) for r in rows) == sorted(wanted)


def test_groups_of_texts_and_spans_of_blocks():
    spans = [[0, 4, 9, 12], [3, 5, 12, 13], []]
    assert clean._joined(spans[0], spans[1]) == [0, 5, 9, 13]
    assert clean._joined(spans[0], spans[2]) == clean._joined(spans[2], spans[0]) == spans[0]
    batches = [pa.RecordBatch.from_pydict({"text": ["abc", None, "de"]}), pa.RecordBatch.from_pydict({"text": ["f" * 9, "g"]})]
    groups = [[texts for _, texts in group] for group in clean._groups(iter(batches), "text", 6)]
    assert [sum(group, []) for group in groups] == [["abc", "", "de", "f" * 9, "g"]]
    assert len(list(clean._groups(iter(batches), "text", 0))) == 2


def test_passages_are_cut_and_clean_texts_stay(documents, benchmark):
    before = {(r.doc_id, r.source): r.text for r in documents.collect()}
    kept = clean.remove_benchmark(documents, benchmark, max_share=0.9)
    assert kept.columns == documents.columns
    after = {(r.doc_id, r.source): r.text for r in kept.collect()}
    assert after.keys() == before.keys()
    assert after[(1, "a")] == "Intro words here. . More words after it."
    assert all(after[k] == before[k] for k in before if k[0] not in (1, 5))
    strict = clean.remove_benchmark(documents, benchmark, max_share=0.2)
    assert sorted(str(r.doc_id) for r in strict.collect()) == sorted(str(k[0]) for k in before if k[0] not in (1, 5))


def numbered_words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_removal_does_not_depend_on_blocks(spark, block_words):
    a, b, long = numbered_words("a", 15), numbered_words("b", 15), numbered_words("c", 20)
    items = spark.createDataFrame(
        [(1, a), (2, b), (3, " ".join(long.split()[:12])), (4, " ".join(long.split()[8:])), (5, "x0 x1 x2 y0 y1 y2 z")],
        "item_id bigint, text string",
    )
    texts = [
        # 15 % and 15 % of the words.
        f"{a} {numbered_words('p', 70)} {b}",
        # Passages of two items that overlap.
        f"{numbered_words('p', 90)} {long} {numbered_words('q', 90)}",
        # Only cutting makes the words of the last item neighbours.
        f"{numbered_words('p', 90)} x0 x1 x2 {a} y0 y1 y2 z {numbered_words('q', 90)}",
        f"{numbered_words('p', 90)} {numbered_words('q', 90)}",
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = clean.remove_benchmark(documents, items, max_share=0.2, block_words=block_words)
    assert {r.doc_id: " ".join(r.text.split()) for r in kept.collect()} == {
        1: f"{numbered_words('p', 90)} {numbered_words('q', 90)}",
        2: f"{numbered_words('p', 90)} x0 x1 x2 y0 y1 y2 z {numbered_words('q', 90)}",
        3: texts[3],
    }


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_items_without_an_id(spark, block_words):
    items = spark.createDataFrame(
        [(None, numbered_words("a", 12)), (2, numbered_words("b", 12)), (None, None)], "item_id bigint, text string"
    )
    documents = spark.createDataFrame([(1, f"{numbered_words('a', 12)} {numbered_words('b', 12)} end")], "doc_id bigint, text string")
    assert [r.text for r in clean.remove_benchmark(documents, items, 0.99, block_words=block_words).collect()] == [" end"]
    assert clean.scan_benchmark(documents, items, block_words=block_words).first().asDict() == {
        "doc_id": 1, "n_words": 25, "spans": [0, 24], "items": [2, None],
    }


def test_no_texts_and_no_items(documents, no_documents, benchmark):
    assert clean.scan_benchmark(no_documents, benchmark).count() == 0
    none = benchmark.where("false")
    assert {len(r.spans) for r in clean.scan_benchmark(documents, none).collect()} == {0}
    assert clean.remove_benchmark(documents, none).count() == documents.count()


def test_offsets_with_signs_beyond_ascii():
    text = f"Ünï çødé — {PASSAGE.upper()}! ünd ẞ"
    sequence = clean.words(PASSAGE)
    spans, _ = clean.Automaton([(1, sequence)]).hits(clean.words(text))
    assert clean._cut(spans, text) == "Ünï çødé — ! ünd ẞ"
