import re

from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import pii_bootstrap as pii


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    odd = sum(map(int, number[-1::-2]))
    return (odd + sum(sum(map(int, str(2 * int(d)))) for d in number[-2::-2])) % 10 == 0


PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def expected(text):
    found = []
    for kind, (pattern, good) in enumerate(PATTERNS):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ09.@+-_ (%1é", max_size=60))
def test_base_spans_against_plain_patterns(text):
    assert pii.base_spans(text) == expected(text)


def test_known_cases():
    for text in [
        "a@b.c.d_x@y.z", "a@b.c..x@y.z", "x@@y.z", "4111 1111 1111 1111 4111", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8.9",
        "00000000255.1.1.1", "+1 (017) 555-7713", "+12", "9" * 4000 + ".1.1.1", "a" * 50_000, "1 " * 20_000, "@" * 1000,
    ]:
        assert pii.base_spans(text) == expected(text)


def test_all_rows(documents, no_documents):
    rows = pii.find_pii(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == documents.count()
    for row in rows:
        assert [tuple(s) for s in row.spans if s.kind < pii.CONTEXT] == expected(texts[row.doc_id])
    assert pii.find_pii(no_documents).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    seeds = [f"user {i} phonez +1 (2{i:02d}) 555-00{i:02d} end" for i in range(8)]
    unseen = ["user 9 phonez 12-345-678-90x end", "plain 12345678 text", "phonez is a word"]
    rows = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id bigint, text string")
    docs = {r.doc_id: r for r in pii.find_pii(rows).collect()}
    assert all(not [s for s in docs[i].spans if s.kind == pii.CONTEXT] for i in (9, 10))
    # Shapes differ, so the pattern of the seeds does not speak for the unseen one.
    same_shape = spark.createDataFrame(
        list(enumerate([f"code idnr 41111111{n}" for n in ("11111111", "22222220", "33333339")] + ["my idnr 1234567890123456 x"])),
        "doc_id bigint, text string",
    )
    found = {r.doc_id: r.spans for r in pii.find_pii(same_shape).collect()}
    if all(any(s.kind == 2 for s in found[i]) for i in range(3)):
        assert [s.kind for s in found[3]] == [pii.CONTEXT]


def card(n):
    """A number of 16 digits that is a card."""
    return next(f"{4000000000000000 + 10 * n + d}" for d in range(10) if luhn(f"{4000000000000000 + 10 * n + d}"))


def contexts_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {
        r.doc_id: texts[r.doc_id][s.start:s.end]
        for r in pii.find_pii(rows).collect() for s in r.spans if s.kind == pii.CONTEXT
    }


def test_a_cue_word_that_is_common_in_prose(spark):
    prose = [f"the card game number {i} has a card on the card table" for i in range(60)]
    seeds = [f"her card {card(i)} was used" for i in range(5)]
    # Only the word before is known, only the word after, the line's start, and none.
    unseen = ["lost card 1234567890123456, he said", "see 9876543210987654 was paid", "box 1111222233334445 moved"]
    assert contexts_of(spark, prose + seeds + unseen) == {65: "1234567890123456", 66: "9876543210987654"}
    # The pattern's share counts, not that of all numbers: most numbers after the word are no seeds.
    others = [f"a card 99{i:02d}123456789012 of {i}" for i in range(6)]
    assert contexts_of(spark, seeds[:4] + others + ["lost card 1234567890123456 x"]) == {}


def test_line_starts_and_odd_addresses(spark):
    seeds = [f"head\n{card(i)} word{i} tail{i}" for i in range(4)]
    assert contexts_of(spark, [*seeds, "head\n1234567890123456 xx"]) == {4: "1234567890123456"}
    mail = [f"write to user{'abcd'[i]}@example.com soon" for i in range(4)]
    assert contexts_of(spark, [*mail, "write to name@bücher.de today"]) == {4: "name@bücher.de"}


def test_words_before_and_after():
    text = f"a b: {card(1)}, next\n{card(2)}\nlast +1 (017) 555-7713 end"
    found = pii.mentions(text, pii.base_spans(text))
    assert [(m[2], m[3]) for m in found] == [("b", "next"), ("\n", "\n"), ("last", "end")]
    assert pii.shape_of("12-34-56-78-90-12-34-56") == "9-9-9-9-9-9-9-9"


def test_seeds_are_found_wherever_they_stand(spark):
    rows = spark.createDataFrame([(1, "pay 4111111111111111 now"), (2, "4111111111111111 5500000000000004 x")], "doc_id bigint, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(rows).collect()}
    assert found[1] == [(4, 2, 20)]
    assert found[2] == [(0, pii.CONTEXT, 16), (17, pii.CONTEXT, 33)]


def test_masking(documents, no_documents):
    masked = pii.mask_pii(documents)
    assert masked.columns == documents.columns
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert masked.count() == documents.count()
    assert rows[7] == "Mail me: <EMAIL> or call <PHONE>; card <CARD>, host <IP>"
    assert rows[2] is None and rows[3] == ""
    assert pii.mask_pii(no_documents).count() == 0
