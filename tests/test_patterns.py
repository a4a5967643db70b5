import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom import catalogue
from auditloom.functions.patterns import begins_with_needed, needed_words


@pytest.mark.parametrize(
    "pattern, words, exact",
    [
        ("invoke", ["invoke"], True),
        ("(buy|sell)", ["buy", "sell"], True),
        ("buy|sell", ["buy", "sell"], True),
        ("(init|reinit)", ["init"], True),
        (r"permit\(", ["permit("], True),
        (r"a\|b", ["a|b"], True),
        (r"a\.\*b", ["a.*b"], True),
        (r"unsafe\s*\{", ["unsafe"], False),
        (r"\.call\s*\{\s*value", [".call"], False),
        (r"(\w+\s*/\s*\d+)", ["/"], False),
        (r"(as\s+u8|as\s+i8)", ["u8", "i8"], False),
        (r"(for\s+\(.*\)|loop\s*\{)", ["for", "loop"], False),
        ("(f32|f64).*?(x|y)", ["f32", "f64"], False),
        ("[a-z]+@[a-z]+", ["@"], False),
        ("ab?c", ["a"], False),
        ("(a|b)?c", ["c"], False),
        ("(a|b)(c|d)", ["a", "b"], False),
        ("ab{2}cde", ["cde"], False),
        ("[0-9]{11,}x", ["x"], False),
        ("[^]a]b", ["b"], False),
        ("(?:ab|cd)ef", ["ab", "cd"], False),
        ("a|b.*", ["a", "b"], False),
        ("a|.*", [], False),
        ("(?i)abc", [], False),
        (r"\x41bc", [], False),
        (r"\pLx", [], False),
        ("[a[b]c]x", [], False),
        ("(?<!ab)", [], False),
        ("(?=ab)", [], False),
    ],
)
def test_needed_words(pattern, words, exact):
    assert needed_words(pattern) == (words, exact)


PATTERNS = [
    p
    for rules in (catalogue.RUST_RULES, catalogue.SOLIDITY_RULES, catalogue.TEXT_RULES, catalogue.PAGE_RULES)
    for rule in rules
    for p in rule[3]
]
TRIGGERS = [re.sub(r"\.\*\?\(\?<!.*\)$", "", p) for p in PATTERNS]


@pytest.mark.parametrize("pattern", sorted(set(TRIGGERS)))
@settings(max_examples=40, deadline=None)
@given(data=st.data())
def test_needed_words_are_needed(pattern, data):
    """Whatever the pattern matches holds one of the words; exact words match alone."""
    words, exact = needed_words(pattern)
    text = data.draw(st.from_regex(pattern, fullmatch=False))
    if words:
        assert any(w in text for w in words)
    if exact:
        for word in words:
            assert re.search(pattern, word)


@pytest.mark.parametrize(
    "pattern, begins",
    [
        ("invoke", True), ("(buy|sell)now*", True), ("buy[0-9]|sell", True), ("(?:abc)+d?", True), (r"permit\(.*x", True),
        ("(abc)?defg", False), ("[a-z]+@[a-z]+", False), (r"\bword", False), ("^word", False), ("abcd*", True),
        ("ab.*longer", False), ("abc|xabc.", False), ("abc|abcd.", True), ("abc|.d", False), ("(?i)abc", False),
    ],
)
def test_matches_that_begin_with_a_needed_word(pattern, begins):
    """What stands before the first needed word may be cut off without a change of the answer."""
    assert begins_with_needed(pattern) == begins
    words, _ = needed_words(pattern)
    for line in ("xx abc abcd defg", "buy sell7 invoke word", "permit(permit(x", "ab longer abx longer", "a@b xabcd", "buynow", "abab"):
        places = [line.index(w) for w in words if w in line]
        if begins and places:
            assert bool(re.search(pattern, line)) == bool(re.search(pattern, line[min(places):]))
