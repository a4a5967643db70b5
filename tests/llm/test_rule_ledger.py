import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import rule_ledger as ledger


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
        len(covered),
    )


def measured(rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [(row.text, tuple(row[n] for n in names)) for row in rows]


def test_measures_of_all_rows(documents):
    rows = ledger.ledger(documents).collect()
    assert len(rows) == documents.count()
    for text, got in measured(rows):
        assert got == expected(text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab#|! \n\u00a0é", max_size=200), min_size=1, max_size=30))
def test_measures_against_brute_force(spark, texts):
    rows = ledger.ledger(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for text, got in measured(rows):
        assert got == expected(text)


def test_policies_read_bits(documents):
    rows = ledger.ledger(documents).withColumn("base", ledger.fails(ledger.BASE)).collect()
    for row in rows:
        assert row.base == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert row.base == bool(row.fail_bits & 3)


def test_ablations_count_bits(documents):
    rows = ledger.ledger(documents).cache()
    bits = [r.fail_bits for r in rows.collect()]
    found = {(r.policy, r.rule): r for r in ledger.ablations(rows, [ledger.BASE, ledger.FULL]).collect()}
    assert len(found) == len(ledger.BASE.rules) + len(ledger.FULL.rules)
    for (version, rule), row in found.items():
        mask = {"base-1": ledger.BASE, "full-1": ledger.FULL}[version].mask
        assert row.n_failed == sum(bool(b & ledger.BITS[rule]) for b in bits)
        assert row.n_only == sum(b & mask == ledger.BITS[rule] for b in bits)
        assert row.n_rejected == sum(bool(b & mask) for b in bits)
        assert row.n_texts == len(bits)


def test_empty_table(no_documents):
    assert ledger.ledger(no_documents).count() == 0
    assert ledger.ablations(ledger.ledger(no_documents), [ledger.FULL]).count() == 0
