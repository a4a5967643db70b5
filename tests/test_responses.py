import json

import pytest

from auditloom import catalogue
from auditloom.operators.responses import (
    answer_findings,
    answer_rejects,
    chat_requests,
    distinct_sources,
    keyed,
    message_requests,
    parse_answers,
)

GOOD = {
    "rule_id": "R", "vuln_type": "v", "severity": "high", "message": "m", "line_number": 3, "code_snippet": "c",
}
CAMEL = {
    "ruleId": "R", "vulnType": "v", "severity": "low", "message": "m", "lineNumber": 0, "codeSnippet": "c",
    "mitigation": None, "filePath": "x.rs", "confidence": [1, 2],
}


def chat(text):
    return json.dumps({"id": 1, "choices": [{"message": {"content": text}}, {"message": {"content": "[]"}}]})


def message(text):
    return json.dumps({"content": [{"type": "text", "text": text}]})


def items(*values):
    return json.dumps(list(values))


CASES = [
    ("both styles", chat("Found " + items(GOOD, CAMEL) + " done"), None, 2),
    ("content style", message(items(CAMEL)), None, 1),
    ("fenced", chat("```json\n" + items(GOOD) + "\n```"), None, 1),
    ("empty list", chat("[]"), None, 0),
    ("no choice", json.dumps({"choices": []}), None, 0),
    ("no content", json.dumps({"content": []}), None, 0),
    ("no list", chat("nothing"), "no JSON list", 0),
    ("reversed", chat("] x ["), "no JSON list", 0),
    ("open list", chat("[" + json.dumps(GOOD)), "no JSON list", 0),
    ("text in between", chat(items(GOOD) + " and " + items(GOOD)), "no JSON list", 0),
    ("trailing comma", chat("[" + json.dumps(GOOD) + ",]"), "no JSON list", 0),
    ("missing member", chat(items({k: v for k, v in GOOD.items() if k != "severity"})), "malformed item", 0),
    ("null member", chat(items({**GOOD, "message": None})), "malformed item", 0),
    ("one bad item", chat(items(GOOD, {})), "malformed item", 0),
    ("scalar item", chat("[1]"), "malformed item", 0),
    ("text number", chat(items({**GOOD, "line_number": "3"})), "malformed item", 0),
    ("negative line", chat(items({**GOOD, "line_number": -3})), "malformed item", 0),
    ("broken line", chat(items({**GOOD, "line_number": 3.5})), "malformed item", 0),
    ("number as text", chat(items({**GOOD, "message": 5})), "malformed item", 0),
    ("list as optional", chat(items({**GOOD, "mitigation": ["x"]})), "malformed item", 0),
    ("not JSON", "{oops", "not a response", 0),
    ("no response", "{}", "not a response", 0),
    ("error body", json.dumps({"error": {"message": "quota"}}), "not a response", 0),
    ("null body", None, "not a response", 0),
    ("no text", json.dumps({"choices": [{"message": {}}]}), "not a response", 0),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, name, body) for i, (name, body, _, _) in enumerate(CASES)]
    return parse_answers(spark.createDataFrame(rows, "source_seq long, path string, body string")).cache()


def test_answers(spark, parsed):
    sources = spark.createDataFrame(
        [(i, "p", None, "") for i in range(len(CASES))], "source_seq long, program string, path string, code string"
    )
    problems = {r.path: r.reason for r in answer_rejects(parsed).collect()}
    assert problems == {name: problem for name, _, problem, _ in CASES if problem}
    found = answer_findings(parsed, sources).collect()
    for i, (name, _, _, count) in enumerate(CASES):
        assert sum(r.source_seq == i for r in found) == count, name
    first = sorted((r for r in found if r.source_seq == 0), key=lambda r: r.item_seq)
    assert [
        (r.analyzer, r.rule_id, r.vuln_type, r.severity, r.message, r.mitigation, r.line_number, r.code_snippet,
         r.file_path)
        for r in first
    ] == [
        ("model", "R", "v", "high", "m", None, 3, "c", None),
        ("model", "R", "v", "low", "m", None, 0, "c", "x.rs"),
    ]


def test_requests(spark, sources):
    code = 'fn a() {\n  "quoted \\ text" // é\n}\n'
    source = sources(("a.rs", code))
    body = json.loads(chat_requests(source, "the context").first().body)
    prompt = body["messages"][1]["content"]
    assert list(body) == ["model", "messages", "temperature", "max_tokens"]
    assert (body["temperature"], body["max_tokens"]) == (0.1, 2000)
    assert [m["role"] for m in body["messages"]] == ["system", "user"]
    assert f"```rust\n{code}\n```\n\nContext: the context\n" in prompt and prompt.endswith("the context\n")
    assert '  {\n    "rule_id": "S-XXXX",' in prompt
    other = json.loads(message_requests(source, "the context").first().body)
    assert list(other) == ["model", "max_tokens", "messages"]
    assert other["messages"] == [
        {"role": "user", "content": catalogue.MESSAGES_PREAMBLE + "\n\n" + prompt}
    ]


def test_answers_find_their_sources_in_another_run(spark, sources):
    """Numbers change with the files and the splits; keys do not."""
    asked = keyed(sources(("a.rs", "x"), ("b.rs", "y"), (None, "z")))
    requests = chat_requests(asked, "c").collect()
    bodies = [(r.source_key, r.path, chat(items({**GOOD, "message": r.path or "inline"}))) for r in requests]
    answers = spark.createDataFrame(bodies, "source_key string, path string, body string")
    later = sources(("new.rs", "n"), (None, "z"), ("b.rs", "y"), ("a.rs", "x"))
    found = answer_findings(parse_answers(answers), later).collect()
    assert sorted((r.source_seq, r.message) for r in found) == [(1, "inline"), (2, "b.rs"), (3, "a.rs")]


def test_equal_texts_share_one_answer(spark):
    """A hundred equal texts are asked about once, and each has the finding once, however often it is answered."""
    rows = [(i, "p", "a.rs", "same") for i in range(100)] + [(100, "p", "b.rs", "same"), (101, None, None, "other")]
    table = spark.createDataFrame(rows, "source_seq long, program string, path string, code string")
    asked = distinct_sources(table)
    requests = chat_requests(asked, "ctx").collect()
    assert len(requests) == 3 and len({r.source_key for r in requests}) == 3
    for times in (1, 3):
        answers = spark.createDataFrame(
            [(r.source_key, r.path, chat(items(GOOD))) for r in requests] * times, "source_key string, path string, body string"
        )
        found = answer_findings(parse_answers(answers), table).collect()
        assert sorted(r.source_seq for r in found) == list(range(102))
