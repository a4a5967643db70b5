"""Bracket classes against sets of code points, worked out in plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions.classes import ASCII_CLASSES, class_at, java_pattern
from auditloom.operators.rules import rejected_rules
from auditloom.operators.scan import scan_strict

ALL = frozenset(range(0x250))
SPACE = frozenset([9, 10, 11, 12, 13, 0x20, 0x85, 0xA0])


def category(*starts):
    return frozenset(c for c in ALL if unicodedata.category(chr(c)).startswith(starts))


WORD = category("L", "M", "Nd", "Nl", "Pc")
# Fixed values. What the named classes hold, as ASCII signs.
NAMED = {
    "alnum": str.isalnum, "alpha": str.isalpha, "ascii": lambda s: True, "blank": lambda s: s in " \t",
    "cntrl": lambda s: ord(s) < 32 or ord(s) == 127, "digit": str.isdigit, "graph": lambda s: 32 < ord(s) < 127,
    "lower": str.islower, "print": lambda s: 32 <= ord(s) < 127,
    "punct": lambda s: 32 < ord(s) < 127 and not s.isalnum(), "space": lambda s: s in " \t\n\x0b\x0c\r",
    "upper": str.isupper, "word": lambda s: s.isalnum() or s == "_", "xdigit": lambda s: s in "0123456789abcdefABCDEF",
}
NAMED = {name: frozenset(c for c in range(128) if test(chr(c))) for name, test in NAMED.items()}
SETS = [
    (r"\d", category("Nd")), (r"\D", ALL - category("Nd")), (r"\s", SPACE), (r"\S", ALL - SPACE), (r"\w", WORD),
    (r"\W", ALL - WORD), (r"\p{Lu}", category("Lu")), (r"\pN", category("N")), (r"\P{L}", ALL - category("L")),
    (r"\p{Letter}", category("L")), (r"\p{^Uppercase_Letter}", ALL - category("Lu")), (r"\p{gc=Sm}", category("Sm")),
    (r"\p{gc!=Sm}", ALL - category("Sm")), (r"\p{Any}", ALL), (r"\p{ascii}", frozenset(range(128))),
    (r"\p{White_Space}", SPACE),
    (r"\p{Greek}", frozenset()), (r"\p{sc=Latin}", frozenset(c for c in ALL if "LATIN" in unicodedata.name(chr(c), "") or c in (0xAA, 0xBA))),
]
SIGNS = [(s, ord(s)) for s in "aAzZm059_ @.,{}()|$*+?/=!<>:;éßİ"] + [
    (r"\]", 93), (r"\[", 91), (r"\\", 92), (r"\^", 94), (r"\-", 45), (r"\&", 38), (r"\~", 126), (r"\x41", 0x41), (r"\u{e9}", 0xE9),
    (r"\t", 9), (r"\n", 10), ("#", 35), (r"\x{7a}", 0x7A),
]


def made(rng, depth=0):
    """(text, signs) of a class made at random."""

    def union():
        text, signs = "", frozenset()
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.4:
                a = rng.choice(SIGNS)
                text, signs = text + a[0], signs | {a[1]}
            elif kind < 0.6:
                a, b = sorted(rng.choices(SIGNS, k=2), key=lambda s: s[1])
                text, signs = f"{text}{a[0]}-{b[0]}", signs | frozenset(range(a[1], b[1] + 1))
            elif kind < 0.75:
                name, no = rng.choice(sorted(NAMED)), rng.random() < 0.3
                text, signs = f"{text}[:{'^' * no}{name}:]", signs | (ALL - NAMED[name] if no else NAMED[name])
            elif kind < 0.88 or depth > 2:
                item = rng.choice(SETS)
                text, signs = text + item[0], signs | item[1]
            else:
                inner = made(rng, depth + 1)
                text, signs = text + inner[0], signs | inner[1]
        return text, signs

    text, signs = union()
    for _ in range(rng.choice([0, 0, 1, 2])):
        operator = rng.choice(["&&", "--", "~~"])
        more, others = union()
        text += operator + more
        signs = {"&&": signs & others, "--": signs - others, "~~": signs ^ others}[operator]
    no = rng.random() < 0.3
    lead = "-" * rng.choice([0, 0, 0, 1]) if not no else ""
    if lead:
        # A line in front stands for itself, and belongs to the first union.
        head, _, rest = text.partition("&&") if "&&" in text else (text, "", "")
        if any(op in text for op in ("&&", "--", "~~")):
            lead = ""
        else:
            signs = signs | {45}
    return f"[{'^' * no}{lead}{text}]", ALL - signs if no else signs & ALL


@pytest.mark.parametrize("seed", range(4))
def test_classes_hold_what_they_say(spark, seed):
    rng = random.Random(seed)
    classes = [made(rng) for _ in range(150)] + [
        ("[]a]", frozenset(map(ord, "]a"))), ("[^]a]", ALL - frozenset(map(ord, "]a"))), ("[a-]", frozenset(map(ord, "a-"))),
        ("[--]", None), ("[0-9--4]", frozenset(range(48, 58)) - {52}), ("[a-c&&]", frozenset()), ("[a&b]", frozenset(map(ord, "a&b"))),
        ("[[:^alpha:]]", ALL - NAMED["alpha"]), ("[a-z-9]", frozenset([*range(97, 123), 45, 57])), ("[ab[^c]]", ALL - {99}),
        ("[[]]", None), ("[a[:nosuch:]]", frozenset(map(ord, "a:nosuch"))), ("[^^]", ALL - {94}), ("[a^]", frozenset([97, 94])),
        ("[$]", frozenset([36])), (r"[\x{41}-C]", frozenset([65, 66, 67])),
    ]
    rows = []
    for i, (text, signs) in enumerate(classes):
        java, _ = java_pattern(text)
        if signs is None:
            continue
        assert java is not None, text
        rows.append((i, text, "(?dU)" + java))
    table = spark.createDataFrame(rows, "i int, text string, java string")
    codes = spark.createDataFrame([(c, chr(c)) for c in sorted(ALL)], "code int, sign string")
    found = table.crossJoin(codes).where(F.rlike("sign", F.col("java"))).groupBy("i").agg(F.collect_set("code").alias("codes"))
    got = {r.i: frozenset(r.codes) for r in found.collect()}
    for i, text, java in rows:
        assert got.get(i, frozenset()) == classes[i][1], (text, java, sorted(got.get(i, frozenset()) ^ classes[i][1])[:9])


@pytest.mark.parametrize("pattern", [
    "[a", "[z-a]", r"[\d-z]", r"[a-\w]", r"[\b]", r"\p{Nosuch}", r"\p{InGreek}", r"\p{javaLowerCase}", r"\p{sc=Nosuch}", "[]", "[^]",
    r"[\x{110000}]", r"\p{", "(?x)[a b]", r"[\p{age=3.0}]",
])
def test_what_cannot_be_read_is_rejected(spark, pattern):
    rules = spark.createDataFrame([(0, "R", "d", "low", [pattern], True, None)], schemas.RULES)
    assert [(r.state, r.problem) for r in rejected_rules(rules).collect()] == [("unsupported", "malformed")]


def test_plain_classes_keep_their_words():
    assert java_pattern("[A-Za-z0-9._%+-]+@[a-z]")[0] == r"[A-Za-z0-9\._%\+\-]+@[a-z]"
    assert java_pattern("[^a-z ]x")[0] == r"[^a-z\x{20}]x"
    assert java_pattern(r"\[not a class\]")[0] == r"\[not a class\]"
    assert all(java_pattern(f"[[:{name}:]]")[0] == f"[{ranges}]" for name, ranges in ASCII_CLASSES.items())


def test_classes_of_ranges_are_flat():
    """Java asks each part of a nested class about each sign, so that none is left where ranges are known."""
    assert java_pattern("[[:^alpha:]--[:^digit:]]{11}")[0] == "[0-9]{11}"
    assert java_pattern("[[:upper:]~~[:alpha:]]{18}")[0] == "[a-z]{18}"
    assert java_pattern("[[:print:]&&[^[:alnum:][:space:].,]]")[0] == r"[!-\+\-/:-@\[-`\{-\~]"
    assert java_pattern(r"[^\\[a-c][x&&y]]")[0] == r"[\x{0}-\[\]-`d-\x{10FFFF}]"
    assert java_pattern("[a&&b]")[0] == r"[^\x{0}-\x{10FFFF}]"
    assert java_pattern(r"[\w&&[a-f&&[^b]]]")[0] == r"[[\w]&&[ac-f]]"


@pytest.mark.parametrize("seed", range(2))
def test_flat_classes_hold_what_nested_ones_do(spark, seed):
    """Signs of all planes, in patterns that are blind to case as well: there parts widen before they are combined."""
    rng = random.Random(100 + seed)
    rows = [(i, made(rng)[0]) for i in range(60)] + [(60, "[a-z--[A-F]]"), (61, "[[:lower:]~~[:alpha:]]"), (62, "[^a[^K]]")]
    nested = [(i, blind, flags + class_at(text, 0, True)[0], flags + java_pattern(start + text)[0].removeprefix(start))
              for i, text in rows for blind, start in ((False, ""), (True, "(?i)"))
              for flags in ["(?dU)" + start]]
    assert all(old == new for _, blind, old, new in nested if blind)
    table = spark.createDataFrame(nested, "i int, blind boolean, old string, new string")
    codes = [*range(0x250), 0x2028, 0x3042, 0xD7FF, 0xE000, 0xFFFD, 0x10000, 0x1F600, 0x10FFFF]
    signs = spark.createDataFrame([(chr(c),) for c in codes], "sign string")
    apart = table.crossJoin(signs).where(F.rlike("sign", F.col("old")) != F.rlike("sign", F.col("new")))
    assert not apart.collect()
    assert any(old != new for _, blind, old, new in nested if not blind)


def test_scans_use_them(spark, sources):
    patterns = ["[[:^alpha:]]x", "[0-9--4]y", r"\p{Greek}", r"[\p{Letter}&&[^a-z]]z", "[[:print:]--[:alnum:]]q"]
    rules = spark.createDataFrame([(i, f"R{i}", "d", "low", [p], True, None) for i, p in enumerate(patterns)], schemas.RULES)
    code = "1x ax\nax\n4y\n5y\nλ\nl\naz\nÉz\naq\n-q\n\tq"
    found = {(r.rule_id, r.line_number) for r in scan_strict(sources(("a", code)), rules).collect()}
    assert found == {("R0", 1), ("R1", 4), ("R2", 5), ("R3", 8), ("R4", 10)}
