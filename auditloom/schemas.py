"""Table schemas, as Spark DDL."""

RULES = (
    "rule_seq INT, id STRING, description STRING, severity STRING, "
    "patterns ARRAY<STRING>, enabled BOOLEAN, mitigation STRING"
)
SOURCES = "source_seq BIGINT, program STRING, path STRING, code STRING"
CODE_NODES = (
    "path STRING, node_seq BIGINT, kind STRING, name STRING, path_len INT, op STRING, "
    "line_number BIGINT, snippet STRING"
)
NODE_CHECKS = (
    "check_seq INT, kind STRING, key STRING, rule_id STRING, severity STRING, "
    "message STRING, mitigation STRING"
)

# One finding. ``item_seq`` orders the findings of one (source, analyzer, rule_seq).
FINDING_COLUMNS = [
    "program", "source_seq", "analyzer", "rule_seq", "item_seq", "rule_id", "vuln_type",
    "severity", "message", "mitigation", "line_number", "code_snippet", "file_path",
]

TREE = (
    "STRUCT<nodes: ARRAY<STRUCT<nodeType: STRING, name: STRING, nodes: ARRAY<STRUCT<"
    "nodeType: STRING, name: STRING, visibility: STRING, stateMutability: STRING, src: STRING, "
    "modifiers: ARRAY<STRUCT<modifierName: STRUCT<name: STRING>>>>>>>>"
)
ANSWER_BODY = (
    "STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>, "
    "content: ARRAY<STRUCT<text: STRING>>>"
)

ANALYZER_REGEX = "regex"
ANALYZER_TREE = "tree"
ANALYZER_MODEL = "model"
ANALYZERS = [ANALYZER_REGEX, ANALYZER_TREE, ANALYZER_MODEL]
