import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import ngram_join as join
from auditloom.llm import shared
from auditloom.llm.grams import gram_sets, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [grams(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def copies(seed=3):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(25):
        words = random.choices(vocabulary, k=random.choice([2, 4, 9, 30, 80, 300]))
        for _ in range(random.choice([1, 2, 5, 9])):
            changed = list(words)
            for _ in range(random.choice([0, 0, 1, 2, 5])):
                changed[random.randrange(len(changed))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(changed).upper() if random.random() < 0.2 else "  ".join(changed)))
    return rows + [(900, None), (901, " "), (902, ""), (3, "again one id with another text")]


def result(spark, rows, size, percent):
    found = join.join_ngrams(spark.createDataFrame(rows, "doc_id bigint, text string"), size=size, percent=percent)
    return sorted(((r.id, r.n, r.component_id) for r in found.collect()), key=str)


def test_links_against_brute_force(spark):
    rows = copies()
    assert result(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert result(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_clusters_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(join, "BLOCK_ROWS", 3)
    rows = copies(4)
    assert result(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert result(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_linked_rows_in_many_column_blocks(monkeypatch):
    monkeypatch.setattr(join, "COLUMN_BLOCK", 16)
    random.seed(1)
    base = random.sample(range(1 << 40), 200)
    sets = [np.array(sorted(base[:200 - i] + random.sample(range(1 << 40), i)), dtype=np.uint64) for i in (0, 4, 9, 30, 60)]
    label = join.linked_rows(sets, 90)
    for a in range(5):
        both = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for b in range(5)]
        linked = [b for b in range(5) if 190 * both[b] >= 90 * (len(sets[a]) + len(sets[b]))]
        assert {label[b] for b in linked} == {label[a]}
    assert label[4] != label[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé \n\x0b\u00a0", max_size=30), max_size=8), st.integers(1, 4))
def test_sets_of_texts(texts, size):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    _, owner = word_hashes(data, offsets)
    _, bounds = gram_sets(data, offsets, size)
    for i, text in enumerate(texts):
        assert (owner == i).sum() == len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert bounds[i + 1] - bounds[i] == len(grams(text, size))


def test_size_classes_reach_every_partner():
    steps = join.size_steps(5000, 90)
    classes = np.searchsorted(steps, np.arange(1, 5001), side="right") - 1
    for small in range(1, 4500):
        assert classes[min(small * 100 // 90, 5000) - 1] - classes[small - 1] <= 1


def test_one_of_each_group_stays(spark, documents, no_documents):
    kept = join.keep_one(documents)
    assert kept.columns == documents.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 1 and both rows of 5 share a text; rows without words stay.
    assert ids == sorted(["1", "2", "3", "4", "None", "6", "7", "8", "9"])
    assert join.keep_one(no_documents).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f")] * 5, "doc_id bigint, text string")
    assert join.keep_one(same).count() == 1
    assert join.join_ngrams(no_documents).count() == 0


@pytest.mark.parametrize("percent, size", [(90, 4), (90, 30), (90, 400), (80, 6), (80, 25), (80, 60), (80, 500), (50, 12)])
def test_linked_sets_have_a_key_in_common(percent, size):
    """Whatever the size, at the lowest overlap that still links."""
    random.seed(size)
    for trial in range(60):
        most = size * (100 - percent) // (100 + percent)
        base = random.sample(range(1 << 62), size + most)
        kept = base[:size - most] + [random.randrange(1 << 62) for _ in range(most)] if trial % 2 else base
        sets = [np.array(sorted(x), dtype=np.uint64) << np.uint64(2) for x in (base[:size], kept)]
        both = len(set(sets[0].tolist()) & set(sets[1].tolist()))
        if 100 * both < percent * (len(sets[0]) + len(sets[1]) - both):
            continue
        offsets = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        keys, rooms = join.block_keys(np.concatenate(sets), offsets, percent)
        one, other = (dict(zip(k.tolist(), r.tolist())) for k, r in zip(keys, rooms))
        both_keys = set(one) & set(other)
        # More than either set may do without; keys of another kind stay anyway.
        room = max([max(one[k], other[k]) >> 1 for k in both_keys if min(one[k], other[k]) >= 0], default=0)
        free = sum(min(one[k], other[k]) < 0 for k in both_keys)
        assert free or len(both_keys) > room


def test_one_python_step_in_a_stage(spark, monkeypatch, capsys):
    """Two Python steps without an exchange between them take two workers for each task."""
    plans = {}
    real = join.stored

    def watched(frame, what):
        frame.explain()
        plans[what] = capsys.readouterr().out
        return real(frame, what)

    monkeypatch.setattr(join, "stored", watched)
    assert join.keep_one(spark.createDataFrame(copies(), "doc_id bigint, text string")).count()
    assert "links" in plans
    for what, plan in plans.items():
        for between in plan.split("MapInArrow")[1:-1]:
            assert "Exchange" in between, what


def test_workers_keep_one_operator():
    shared.let_go()
    made = []
    for name in ("a", "a", "b", "a"):
        assert shared.kept_in_worker((name,), lambda: made.append(name) or name) == name
        assert len(shared._kept) == 1
    assert made == ["a", "b", "a"]
    shared.let_go()
    assert not shared._kept
