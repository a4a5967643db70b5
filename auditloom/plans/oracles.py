"""The queries once more, as SQL for DuckDB over the same tables.

Written from the meaning of each query, not from its Spark plan: scans are one SELECT per
rule over a table of lines, keep-first steps are ``row_number``, and contracts are checked
on the columns they were built from instead of their trees.
"""

import re

from auditloom import catalogue
from auditloom.operators.nodes import HEADERS, NO_CALLS, NO_OPERANDS
from auditloom.plans.inputs import CODE_WORDS, MANY_FORM, MANY_FORMS, MANY_PIECES, ODD_PATTERNS, PROJECT_ENDINGS, TEXTS_PER_FILE
from auditloom.plans.registry import CONTEXT_REACH

_WS = "\\t\\n\\x0b\\x0c\\r \\u0085\\u00a0\\u1680" + "".join(f"\\u{c:04x}" for c in range(0x2000, 0x200B)) + (
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)
TRIM_SET = "concat(" + ", ".join(f"chr({ord(c)})" for c in _WS.encode().decode("unicode_escape")) + ")"

PATH = (
    "concat('docs/', source, '/', doc_id, "
    "CASE doc_id % 4 WHEN 0 THEN '.sol' WHEN 1 THEN '.SOL' WHEN 2 THEN '.Json' ELSE '.rs' END)"
)
NL, CR = "chr(10)", "chr(13)"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _trim(column: str) -> str:
    return f"trim({column}, {TRIM_SET})"


def _re2(pattern: str) -> str:
    """A pattern with its classes spelled out over Unicode."""
    space = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    out = pattern.replace(r"\s", f"[{space}]")
    out = out.replace(r"\w", r"[\p{L}\p{M}\p{N}\p{Pc}]")
    return out.replace(r"\d", r"\p{Nd}")


def _code(column: str = "text") -> str:
    for word, piece in CODE_WORDS:
        column = f"replace({column}, {q(word)}, {q(piece)})"
    return column


def _sources(code: str) -> str:
    return (
        f"sources AS (SELECT doc_id AS source_seq, source AS program, {PATH} AS path, {code} AS code FROM documents)"
    )


TEXT_SOURCES = _sources("text")
CODE_SOURCES = _sources(_code())
PAGE_SOURCES = (
    "sources AS (SELECT page_id AS source_seq, CAST(NULL AS VARCHAR) AS program, url AS path, html AS code FROM pages)"
)
LINES = rf"""
pieces AS (
  SELECT program, source_seq, path, string_split_regex(code, '\r?\n') AS parts FROM sources WHERE code <> ''),
whole AS (
  SELECT program, source_seq, path,
         CASE WHEN parts[len(parts)] = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM pieces),
lines AS MATERIALIZED (
  SELECT program, source_seq, path, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_number FROM whole)
"""


def _rule_select(rule: tuple, condition: str, lines: str = "lines") -> str:
    id_, severity, _, _, description, mitigation = rule
    return (
        f"SELECT program, source_seq, 'regex' AS analyzer, {q(id_)} AS rule_id, {q(id_)} AS vuln_type, "
        f"{q(severity)} AS severity, {q(description)} AS message, CAST({q(mitigation)} AS VARCHAR) AS mitigation, "
        f"line_number, {_trim('line')} AS code_snippet, path AS file_path FROM {lines} WHERE {condition}"
    )


def _hits(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({column}, {q(_re2(pattern))})"


def _enabled(rules: list[tuple]) -> list[tuple]:
    return [r for r in rules if r[2] and r[3]]


def _strict(rules: list[tuple]) -> str:
    live = [r for r in _enabled(rules) if "(?<!" not in r[3][0]]
    return " UNION ALL ".join(_rule_select(r, _hits(r[3][0])) for r in live)


def _odd_scan() -> str:
    """Every brand's rule, by its number, over the lines of the texts."""
    brands = (
        "SELECT p_brand, count(*) AS parts FROM part GROUP BY p_brand "
        f"HAVING CAST(substr(p_brand, 7) AS INTEGER) % {len(ODD_PATTERNS)}"
    )
    return " UNION ALL ".join(
        "SELECT program, source_seq, 'regex' AS analyzer, p_brand AS rule_id, p_brand AS vuln_type, 'low' AS severity, "
        "'reads ${env:HOME} of ' || parts AS message, '${user.home}' AS mitigation, "
        f"CAST(line_number AS BIGINT) AS line_number, {_trim('line')} AS code_snippet, path AS file_path "
        f"FROM (SELECT * FROM lines WHERE regexp_matches(line, {q(re2)})), ({brands} = {i})"
        for i, (_, re2) in enumerate(ODD_PATTERNS)
    )


def _many_scan() -> str:
    """Every part's rule tried on every line; letters that stand in any hit go before the regex."""
    pieces = {k: v.replace(" div ", " // ") for k, v in MANY_PIECES.items()}
    forms = ", ".join(" || ".join(pieces.get(p, q(p)) for p in form) for form in MANY_FORMS)
    head, tail, a, b = (pieces[k] for k in ("head", "tail", "a", "b"))
    one = f"[{head} || {a}, {tail} || {a} || {b}, {tail} || {a}, {a} || {b} || {head}, {a} || {b}]"
    other = f"[{head} || {a}, {tail} || {a} || {b}, {head} || {b}, {a} || {b} || {head}, {a} || {b}]"
    return (
        f", rules AS MATERIALIZED (SELECT p_partkey, p_name, p_type, [{forms}][{MANY_FORM} + 1] AS pattern, "
        f"{one}[{MANY_FORM} + 1] AS one, {other}[{MANY_FORM} + 1] AS other FROM part WHERE p_size % 7 <> 0), "
        "met AS MATERIALIZED (SELECT * FROM lines JOIN rules ON contains(line, one) OR contains(line, other)) "
        "SELECT program, source_seq, 'regex' AS analyzer, 'M-' || p_partkey AS rule_id, 'M-' || p_partkey AS vuln_type, "
        "'low' AS severity, p_name AS message, p_type AS mitigation, CAST(line_number AS BIGINT) AS line_number, "
        f"{_trim('line')} AS code_snippet, path AS file_path FROM met WHERE regexp_matches(line, pattern)"
    )


def _all_patterns(rules: list[tuple]) -> str:
    selects = []
    for r in _enabled(rules):
        patterns = [p for p in r[3] if "(?<!" not in p]
        if patterns:
            selects.append(_rule_select(r, " OR ".join(_hits(p) for p in patterns)))
    return " UNION ALL ".join(selects)


def _parts(rule: tuple) -> tuple[str, str | None]:
    guarded = re.match(r"^(.*)\.\*\?\(\?<!(.*)\)$", rule[3][0])
    return (guarded.group(1), guarded.group(2)) if guarded else (rule[3][0], None)


def _guarded(rules: list[tuple]) -> str:
    selects = []
    for r in _enabled(rules):
        trigger, guard = _parts(r)
        condition = _hits(trigger) + (f" AND NOT {_hits(guard)}" if guard else "")
        selects.append(_rule_select(r, condition))
    return " UNION ALL ".join(selects)


def _context(rules: list[tuple]) -> str:
    frame = (
        f"OVER (PARTITION BY source_seq ORDER BY line_number "
        f"ROWS BETWEEN {CONTEXT_REACH} PRECEDING AND {CONTEXT_REACH} FOLLOWING)"
    )
    selects = []
    for r in _enabled(rules):
        trigger, guard = _parts(r)
        if guard is None:
            selects.append(_rule_select(r, _hits(trigger)))
            continue
        near = f"(SELECT *, max(CAST({_hits(guard)} AS INT)) {frame} AS guard_near FROM lines)"
        selects.append(_rule_select(r, f"{_hits(trigger)} AND guard_near = 0", near))
    return " UNION ALL ".join(selects)


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# Rules made from parts.

PART_RULES = r"""
part_rules AS (
  SELECT CAST(p_partkey AS INTEGER) AS rule_seq, 'P-' || (p_partkey % 1500) AS id, p_name AS description,
         CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
         CASE p_partkey % 8
           WHEN 0 THEN [] WHEN 1 THEN [p_brand] WHEN 2 THEN [p_type || '.*?(?<!' || p_brand || ')']
           WHEN 3 THEN ['(' || p_name] WHEN 4 THEN [p_name, p_brand] WHEN 5 THEN ['(' || p_type || ')\1']
           WHEN 6 THEN ['[(?=]' || p_size || '\\1'] ELSE ['(?>' || p_type || ')', p_name, p_brand] END AS patterns,
         p_size % 7 <> 0 AS enabled, CASE WHEN p_size % 5 <> 0 THEN p_type END AS mitigation,
         p_partkey % 8 AS form
  FROM part),
stated AS (
  SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN form = 0 THEN 'no pattern'
                 WHEN form IN (2, 3, 5, 7) THEN 'unsupported' ELSE 'live' END AS state
  FROM part_rules),
judged AS (
  SELECT *, CASE WHEN state = 'unsupported' THEN
           CASE form WHEN 2 THEN 'look-around' WHEN 3 THEN 'malformed' WHEN 5 THEN 'back-reference'
                     ELSE 'atomic group' END END AS problem
  FROM stated)
"""

# What a pattern is by the form of its rule: form 2 is a guarded trigger, 3 lacks a bracket,
# 5 has a back-reference, 7 an atomic group in its first pattern.
_PATTERN_STATES = """
, each AS (
  SELECT rule_seq, id, enabled, form, unnest(CASE WHEN len(patterns) = 0 THEN [NULL] ELSE patterns END) AS pattern,
         CASE WHEN len(patterns) = 0 THEN 0 ELSE unnest(range(1, greatest(len(patterns), 1) + 1)) END AS pattern_no FROM part_rules),
problems AS (
  SELECT *, CASE WHEN pattern_no <> 1 THEN NULL WHEN form = 2 THEN 'look-around' WHEN form = 3 THEN 'malformed'
                 WHEN form = 5 THEN 'back-reference' WHEN form = 7 THEN 'atomic group' END AS problem FROM each),
judged_both AS (SELECT *, CASE WHEN problem <> 'look-around' THEN problem END AS guarded_problem FROM problems)
SELECT rule_seq, id, CAST(pattern_no AS INTEGER) AS pattern_no, pattern,
  CASE WHEN NOT enabled THEN 'disabled' WHEN pattern IS NULL THEN 'no pattern' WHEN pattern_no > 1 THEN 'unused'
       WHEN problem IS NOT NULL THEN 'unsupported' ELSE 'live' END AS strict,
  CASE WHEN NOT enabled THEN 'disabled' WHEN pattern IS NULL THEN 'no pattern'
       WHEN problem IS NOT NULL THEN 'unsupported' ELSE 'live' END AS every,
  CASE WHEN NOT enabled THEN 'disabled' WHEN pattern IS NULL THEN 'no pattern' WHEN pattern_no > 1 THEN 'unused'
       WHEN guarded_problem IS NOT NULL THEN 'unsupported' ELSE 'live' END AS guarded, problem, guarded_problem
FROM judged_both
"""

# Syntax nodes.


def _check_rows() -> str:
    rows = [
        f"({seq}, {q(kind)}, {q(key)}, {q(rule)}, {q(severity)}, {q(message)}, {q(mitigation)})"
        for seq, (kind, key, rule, severity, message, mitigation) in enumerate(catalogue.NODE_CHECKS)
    ]
    return (
        f"checks AS (SELECT * FROM (VALUES {', '.join(rows)}) "
        "t(check_seq, kind, key, rule_id, severity, message, mitigation))"
    )


ITEM_NODES = """
code_nodes AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'src/hot.rs' ELSE 'src/o' || l_orderkey || '.rs' END AS path,
         (l_orderkey * 8 + l_linenumber) * 200000000 + l_partkey AS node_seq,
         CASE l_partkey % 10 WHEN 2 THEN 'method_call' WHEN 3 THEN 'binary' WHEN 4 THEN 'loop'
           WHEN 5 THEN 'while' WHEN 6 THEN 'for' WHEN 7 THEN 'fn' WHEN 8 THEN 'struct' ELSE 'call' END AS kind,
         ['invoke', 'invoke_signed', 'transfer', 'transfer_checked', 'try_from_slice', 'from_bytes',
          'create_program_address', 'other'][(l_partkey // 10) % 8 + 1] AS name,
         CASE WHEN l_partkey % 10 = 9 THEN 2 ELSE 1 END AS path_len,
         ['+', '-', '*', '/', '+=', '-='][(l_partkey // 10) % 6 + 1] AS op,
         CAST(l_quantity AS BIGINT) - 1 AS line_number,
         CASE l_suppkey % 20 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE 'stmt ' || (l_suppkey % 20) END AS snippet
  FROM lineitem)
"""
FOUND_NODES = """
found AS (
  SELECT n.path, CAST(c.check_seq AS INTEGER) AS check_seq, n.node_seq AS item_seq, c.rule_id, c.severity,
         c.message, c.mitigation, n.line_number, n.snippet AS code_snippet
  FROM code_nodes n JOIN checks c ON n.kind = c.kind AND (
       (n.kind = 'call' AND n.path_len = 1 AND n.name = c.key) OR (n.kind = 'method_call' AND n.name = c.key)
       OR (n.kind = 'binary' AND n.op = c.key) OR n.kind IN ('loop', 'while', 'for', 'fn', 'struct')))
"""
_L = r"\p{L}\p{M}\p{N}_"
_PARTS = (
    r"(?s)//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*.*" + r'|(?:br|cr|r)"[^"]*"|(?:b|c)?"(?:[^"\\]|\\.)*"?'
    r"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|.)|[^\\'\n])'" + rf"""|[{_L}]+|[^/"'{_L}]+|."""
)
_LEXEMES = rf"[{_L}]+|[ \t]+|->|=>|::|\.\.+=?|[-+*/%^!=<>&|]=|[^{_L} \t]"
_BREAKS = r"regexp_replace(t, '[^\n]', '', 'g')"


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


# Every sign of a line is a row; those beside it say what it is, and sums over the signs of
# a source what stands around it.
LEXICAL_NODES = rf"""
blanked AS (
  SELECT *, CASE WHEN regexp_matches(code, '[/"'']') THEN array_to_string(list_transform(
      regexp_extract_all(code, {q(_PARTS)}), lambda t: CASE
        WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN ' ' || {_BREAKS}
        WHEN regexp_matches(t, '^(?:br|cr|r|b|c)?#*"') THEN '""' || {_BREAKS}
        WHEN starts_with(t, '''') AND length(t) > 2 THEN '""' ELSE t END), '') ELSE code END AS live_code
  FROM sources WHERE code <> ''),
both_parts AS (
  SELECT path, source_seq, string_split_regex(code, '\r?\n') AS old, string_split_regex(live_code, '\r?\n') AS new FROM blanked),
live_lines AS (
  SELECT path, source_seq, unnest(old) AS line, unnest(new) AS live, unnest(range(1, len(old) + 1)) AS line_number FROM both_parts),
signs AS (
  SELECT path, source_seq, line, line_number, unnest(x) AS s, unnest(range(len(x))) AS pos
  FROM (SELECT *, regexp_extract_all(live, {q(_LEXEMES)}) AS x FROM live_lines)),
near AS (
  SELECT *, lag(s, 1) OVER w AS l1, lag(s, 2) OVER w AS l2, lag(s, 3) OVER w AS l3, lag(s, 4) OVER w AS l4,
         lag(s, 5) OVER w AS l5, lead(s, 1) OVER w AS n1, lead(s, 2) OVER w AS n2
  FROM signs WINDOW w AS (PARTITION BY source_seq, line_number ORDER BY pos)),
beside AS (
  SELECT *, CASE WHEN regexp_matches(l1, '^[ \t]') THEN l2 ELSE l1 END AS b,
         CASE WHEN regexp_matches(n1, '^[ \t]') THEN n2 ELSE n1 END AS a FROM near),
judged_signs AS (
  SELECT *, s IN ('fn', 'struct') AND coalesce(regexp_matches(a, '^[\p{{L}}_]'), false) AS defines,
         coalesce(b, '') NOT IN ('.', '::', ':', '!') AS bare,
         regexp_matches(s, '^[{_L}]') AND coalesce(a, '') = '(' AND NOT regexp_matches(s, '^[0-9]')
           AND NOT (s IN {_listed(NO_CALLS)} AND coalesce(b, '') NOT IN ('.', '::'))
           AND coalesce(b, '') NOT IN ('fn', 'struct') AS called,
         s IN ('+', '-', '*', '/')
           AND NOT (coalesce(regexp_matches(l1, '^[0-9_]+[eE]$'), false) AND s IN ('+', '-'))
           AND NOT (s = '+' AND (coalesce(a, '') IN ('''', '?') OR regexp_matches(coalesce(a, ''), '^[A-Z][A-Za-z0-9_]*[a-z]')))
           AND (regexp_matches(coalesce(b, ''), '^[{_L})\]?"]') AND coalesce(b, '') NOT IN {_listed(NO_OPERANDS)}
                OR b IS NULL AND s IN ('+', '/')) AS operates,
         s IN ('(', '[', '{{') AND (
           coalesce(b, '') = '#' OR coalesce(b, '') = '!' AND (coalesce(l2, '') = '#' OR regexp_matches(coalesce(l2, ''), '^[{_L}]'))
           OR regexp_matches(coalesce(l1, ''), '^[ \t]') AND coalesce(b, '') = '!' AND regexp_matches(coalesce(l3, ''), '^[{_L}]')
           OR coalesce(l4, '') = 'macro_rules' AND l3 = '!' OR coalesce(l5, '') = 'macro_rules' AND l4 = '!') AS opaque
  FROM beside),
named_signs AS (
  SELECT path, source_seq, line, (CAST(line_number AS BIGINT) << 32) + pos AS node_seq, CAST(line_number AS BIGINT) AS line_number,
         s, opaque, CASE WHEN defines THEN s
           WHEN s IN ('loop', 'while', 'for') AND bare AND coalesce(a, '') <> '<' THEN s
           WHEN called AND coalesce(b, '') = '.' THEN 'method_call' WHEN called THEN 'call' WHEN operates THEN 'binary' END AS kind,
         CASE WHEN defines THEN a ELSE s END AS word, CASE WHEN coalesce(b, '') = '::' THEN 2 ELSE 1 END AS parts_of_name,
         CASE WHEN s IN ('(', '[', '{{') THEN 1 WHEN s IN (')', ']', '}}') THEN -1 ELSE 0 END AS step,
         CASE WHEN s IN {_listed(HEADERS)} AND bare AND (s IN ('impl', 'extern') OR coalesce(regexp_matches(a, '^[\p{{L}}_]'), false))
           THEN s END AS header,
         s IN ('{{', '}}', ';') AS ends
  FROM judged_signs),
deep AS (
  SELECT *, sum(step) OVER (w ROWS UNBOUNDED PRECEDING) AS depth,
         coalesce(sum(ends::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM named_signs WHERE kind IS NOT NULL OR step <> 0 OR header IS NOT NULL OR ends
  WINDOW w AS (PARTITION BY source_seq ORDER BY node_seq)),
headed AS (
  SELECT *, first_value(header IGNORE NULLS) OVER (PARTITION BY source_seq, part ORDER BY node_seq ROWS UNBOUNDED PRECEDING) AS heads
  FROM deep),
opened AS (
  SELECT *, CASE WHEN opaque THEN 'opaque' WHEN s = '{{' AND heads IN ('impl', 'trait', 'extern') THEN 'members'
           WHEN step > 0 THEN 'plain' END AS opens, CASE WHEN step > 0 THEN depth ELSE depth - step END AS level FROM headed),
inside AS (
  SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY source_seq, level ORDER BY node_seq ROWS UNBOUNDED PRECEDING) AS around
  FROM opened),
hiding AS (
  SELECT *, coalesce(sum(CASE WHEN opaque THEN 1 WHEN step < 0 AND around = 'opaque' THEN -1 ELSE 0 END) OVER (
           PARTITION BY source_seq ORDER BY node_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hidden
  FROM inside),
code_nodes AS (
  SELECT path, node_seq, kind, CASE WHEN kind <> 'binary' THEN word END AS name, CASE WHEN kind = 'call' THEN parts_of_name END AS path_len,
         CASE WHEN kind = 'binary' THEN s END AS op, line_number, {_trim('line')} AS snippet
  FROM hiding
  WHERE kind IS NOT NULL AND hidden <= 0 AND NOT (kind = 'for' AND coalesce(heads, '') = 'impl')
    AND NOT (kind = 'fn' AND coalesce(around, '') = 'members'))
"""
FIRST_NODES = """
first_nodes AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY path, rule_id, line_number, code_snippet ORDER BY item_seq) AS rn
    FROM found WHERE line_number > 0 AND code_snippet NOT IN ('', 'unknown')) WHERE rn = 1)
"""
COLLAPSED_NODES = f"""
collapsed AS (
  SELECT path, check_seq, item_seq, rule_id, severity, message, mitigation,
         CAST({catalogue.PLACEHOLDER_LINE} AS BIGINT) AS line_number,
         '{catalogue.PLACEHOLDER_SNIPPET}' AS code_snippet
  FROM (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY item_seq) AS rn FROM found) WHERE rn = 1)
"""

# Contracts.

_FUNCTION = "'  function ' || name || '(uint256 x) ' || visibility || ' ' || state_mutability || ' {' || chr(10) || '    y = x;' || chr(10) || '  }' || chr(10)"
CONTRACTS = f"""
picked AS (
  SELECT p_partkey, p_name, p_brand,
         CASE WHEN p_partkey % 9 = 0 THEN '.JSON' ELSE '.sol' END AS ending, i,
         ['setFee', 'UpdateRate', 'sweep', 'configureX', 'GRANTRole', '', 'pause', 'setFrameConfig'][
           CASE i WHEN 1 THEN p_size % 8 WHEN 2 THEN p_partkey % 8 ELSE (p_partkey // 8) % 8 END + 1] AS name,
         ['public', 'external', 'internal', 'private'][(p_size + i) % 4 + 1] AS visibility,
         ['nonpayable', 'view', 'payable', 'pure'][(p_partkey // 3 + i) % 4 + 1] AS state_mutability,
         CASE (p_partkey // 5 + i) % 5 WHEN 1 THEN 'onlyOwner' WHEN 2 THEN 'lock,ONLYROLE'
           WHEN 3 THEN 'onlyOwners' ELSE '' END AS modifiers
  FROM part, (SELECT unnest([1, 2, 3]) AS i)),
texts AS (
  SELECT *, {_FUNCTION} AS text, '// ' || chr(252) || chr(8364) || ' ' || p_name || chr(10)
         || 'contract C' || p_partkey || ' {{' || chr(10) AS head FROM picked),
placed AS (
  SELECT *, 'contracts/' || p_partkey || ending AS path,
         strlen(head) + coalesce(sum(strlen(text)) OVER (
           PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS start
  FROM texts),
fns AS (
  SELECT *, CASE WHEN p_partkey % 11 = i THEN 'x:1:0'
                 ELSE CAST(start AS BIGINT) || ':' || (strlen(text) - 3) || ':0' END AS src FROM placed)
"""
_SETTER = next(r for r in catalogue.SOLIDITY_RULES if r[0] == catalogue.SETTER_RULE_ID)
SETTERS = f"""
SELECT p_brand AS program, p_partkey AS source_seq, 'tree' AS analyzer, '{_SETTER[0]}' AS rule_id,
       '{_SETTER[0]}' AS vuln_type, {q(_SETTER[1])} AS severity, {q(_SETTER[4])} AS message,
       {q(_SETTER[5])} AS mitigation, CAST(3 * i AS BIGINT) AS line_number,
       trim(text, ' ' || chr(10)) AS code_snippet, path AS file_path
FROM fns
WHERE ending = '.sol' AND p_partkey % 11 <> i AND name NOT IN ('', 'sweep')
  AND visibility IN ('public', 'external') AND state_mutability NOT IN ('view', 'pure')
  AND modifiers NOT IN ('onlyOwner', 'lock,ONLYROLE')
"""

SETTERS_DEFAULT = (
    f"SELECT * REPLACE ({q(catalogue.MISSING_RULE_SEVERITY)} AS severity, {q(catalogue.MISSING_RULE_MESSAGE)} AS message, "
    f"CAST(NULL AS VARCHAR) AS mitigation) FROM ({SETTERS})"
)

# Answers.

ANSWERS = """
turns AS (
  SELECT *, (conv_id + turn) % 7 AS form, ['critical', 'high', 'medium', 'low'][turn % 4 + 1] AS severity
  FROM conversations),
items AS (
  SELECT conv_id AS source_seq, conv_id, turn, 0 AS pos, 'M-' || turn AS rule_id, role AS vuln_type, severity,
         text AS message, CASE WHEN turn % 2 = 0 THEN 'review' END AS mitigation, conv_id + 1 AS line_number,
         left(text, 20) AS code_snippet, CAST(NULL AS VARCHAR) AS file_path
  FROM turns WHERE form IN (0, 1)
  UNION ALL
  SELECT conv_id, conv_id, turn, 1, 'M-' || turn, role, severity, text, NULL, conv_id + 2, right(text, 20),
         'conv/' || conv_id
  FROM turns WHERE form = 1),
answered AS (
  SELECT s.program, s.source_seq, 'model' AS analyzer, i.rule_id, i.vuln_type, i.severity, i.message, i.mitigation,
         i.line_number, i.code_snippet, i.file_path
  FROM items i JOIN sources s ON i.source_seq = s.source_seq)
"""

_ANSWER_REJECTS = (
    "SELECT 'answer' AS stage, 'conv/' || conv_id || '/' || turn AS path, "
    "CASE (conv_id + turn) % 7 WHEN 4 THEN 'malformed item' ELSE 'no JSON list' END AS reason "
    "FROM conversations WHERE (conv_id + turn) % 7 IN (2, 3, 4, 5)"
)

_STRICT_CODE = _strict(catalogue.RUST_RULES + catalogue.SOLIDITY_RULES)
_NODE_PART = """
SELECT s.program, s.source_seq, 'tree' AS analyzer, n.rule_id, n.rule_id AS vuln_type, n.severity, n.message,
       n.mitigation, n.line_number, n.code_snippet, n.path AS file_path
FROM {nodes} n JOIN sources s ON n.path = s.path
"""
_ALL = _with(CODE_SOURCES, LINES, LEXICAL_NODES, _check_rows(), FOUND_NODES, FIRST_NODES, ANSWERS) + (
    f", findings AS MATERIALIZED ({_strict(catalogue.RUST_RULES)} UNION ALL {_NODE_PART.format(nodes='first_nodes')} "
    "UNION ALL SELECT * FROM answered) "
)
_GUARDED_TEXT = _with(TEXT_SOURCES, LINES) + f", findings AS ({_guarded(catalogue.RUST_RULES)}) "
_PROGRAM_FILES = f"""
program_texts AS (
  SELECT 'program=' || source AS program, doc_id // {TEXTS_PER_FILE} AS block, doc_id, {_code()} AS code FROM documents),
sources AS (
  SELECT row_number() OVER () AS source_seq, program, program || '/' || block AS path,
         string_agg(code, {NL} ORDER BY doc_id) || {NL} AS code FROM program_texts GROUP BY program, block)
"""
_COLLECTION = _with(_PROGRAM_FILES, LINES, LEXICAL_NODES, _check_rows(), FOUND_NODES, COLLAPSED_NODES) + (
    f", findings AS ({_NODE_PART.format(nodes='collapsed')}) "
)
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in catalogue.SEVERITIES)
_PER_PROGRAM = f"""
files AS (SELECT program, count(*) AS files FROM sources GROUP BY program),
counts AS (SELECT program, count(*) AS findings, {_COUNTS} FROM findings GROUP BY program),
report AS (
  SELECT f.program, f.files, coalesce(c.findings, 0) AS findings,
         {', '.join(f'coalesce(c.{s}, 0) AS {s}' for s in catalogue.SEVERITIES)}
  FROM files f LEFT JOIN counts c ON f.program = c.program)
"""
_TEXT_SCAN = _with(TEXT_SOURCES, LINES) + _strict(catalogue.TEXT_RULES)


def _prompt(context: str) -> str:
    return " || ".join([
        q(catalogue.PROMPT_HEAD), "text", q(catalogue.PROMPT_MIDDLE + context + catalogue.PROMPT_TAIL),
    ])


def _requests() -> str:
    chat = (
        f"json_object('model', {q(catalogue.CHAT_MODEL)}, 'messages', json_array("
        f"json_object('role', 'system', 'content', {q(catalogue.CHAT_SYSTEM_TEXT)}), "
        f"json_object('role', 'user', 'content', {_prompt(catalogue.RUST_CONTEXT)})), "
        "'temperature', 0.1, 'max_tokens', 2000)"
    )
    preamble = q(catalogue.MESSAGES_PREAMBLE) + f" || {NL} || {NL} || "
    message = (
        f"json_object('model', {q(catalogue.MESSAGES_MODEL)}, 'max_tokens', 2000, 'messages', json_array("
        f"json_object('role', 'user', 'content', {preamble}{_prompt(catalogue.SOLIDITY_CONTEXT)})))"
    )
    return " UNION ALL ".join(
        f"SELECT doc_id AS source_seq, {PATH} AS path, CAST({body} AS VARCHAR) AS body, '{style}' AS style "
        "FROM documents"
        for style, body in [("chat", chat), ("message", message)]
    )


def all_sql() -> dict[str, str]:
    start = "CAST((doc_id * 7919) % length(text) AS INTEGER)"
    crlf = (
        f"concat(replace(replace(text, '. ', '.' || {CR} || {NL} || chr(9)), ', ', ',' || chr(160) || {NL}), "
        f"CASE doc_id % 3 WHEN 0 THEN {CR} || {NL} WHEN 1 THEN {CR} ELSE '' END)"
    )
    verdict = "CASE WHEN count(*) = 0 THEN 'none found' ELSE 'review and fix' END"
    rank = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END"
    return {
        "src_files": f"SELECT item_id // 1000 AS block, string_agg(text, {NL} ORDER BY item_id) || {NL} AS code "
        "FROM benchmark GROUP BY 1",
        # Root 0 is place 4 of c, root 1 is b, root 2 is a, root 4 is place 2 of c; the others lie inside those.
        "src_project": "WITH kept AS (SELECT *, ['a', 'b', 'c'][item_id % 3 + 1] AS dir, item_id % 8 AS place FROM benchmark) "
        "SELECT CASE dir WHEN 'b' THEN 1 WHEN 'a' THEN 2 ELSE CASE place WHEN 4 THEN 0 ELSE 4 END END AS root, dir, place, "
        f"[{', '.join(q(e) for e in PROJECT_ENDINGS)}][place % 4 + 1] AS ending, "
        f"string_agg(coalesce(text, ''), {NL} ORDER BY item_id) || {NL} AS code FROM kept "
        "WHERE place % 4 <> 3 AND (dir <> 'c' OR place IN (2, 4)) GROUP BY dir, place",
        "src_inline": "SELECT doc_id AS source_seq, 'stdin' AS source, text AS code FROM documents "
        f"WHERE {_trim('text')} <> ''",
        "src_ext_filter": f"SELECT doc_id AS source_seq, {PATH} AS path, doc_id % 4 <> 3 AS solidity, "
        "doc_id % 4 = 3 AS rust, doc_id % 4 = 2 AS json FROM documents",
        "src_dedup": """
            WITH delivered AS (
              SELECT doc_id * 2 + 1 - copy AS source_seq, text AS code,
                     CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '/docs/hot.sol'
                          ELSE '/docs/' || (doc_id % 300) || '.sol' END AS path
              FROM documents, (SELECT unnest([0, 1]) AS copy)),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source_seq) AS rn FROM delivered)
            SELECT source_seq, path, code FROM ranked WHERE path IS NULL OR rn = 1""",
        "out_json": _with(TEXT_SOURCES, LINES) + f", findings AS ({_strict(catalogue.TEXT_RULES)}) "
        'SELECT rule_id AS "ruleId", vuln_type AS "vulnType", severity, message, mitigation, '
        'line_number AS "lineNumber", code_snippet AS "codeSnippet", file_path AS "filePath" FROM findings',
        "out_ordered": _with(TEXT_SOURCES, LINES) + f", findings AS ({_strict(catalogue.TEXT_RULES)}) "
        "SELECT row_number() OVER (ORDER BY source_seq, "
        f"list_position([{', '.join(q(r[0]) for r in catalogue.TEXT_RULES)}], rule_id), line_number) AS ordinal, "
        "source_seq, rule_id, line_number, code_snippet FROM findings",
        "rules_load": _with(PART_RULES)
        + "SELECT rule_seq, id, description, severity, array_to_string(patterns, ' , ') AS patterns, enabled, "
        "mitigation FROM part_rules",
        "rules_toml": _with(PART_RULES)
        + "SELECT CAST(row_number() OVER (ORDER BY rule_seq) - 1 AS INTEGER) AS rule_seq, id, description, severity, "
        "array_to_string(patterns, ' , ') AS patterns, enabled, mitigation, true AS mode_regex, false AS mode_ast, "
        "true AS mode_llm FROM part_rules",
        "rules_patterns": _with(PART_RULES) + _PATTERN_STATES,
        "rules_active": _with(PART_RULES)
        + "SELECT rule_seq, id, description, severity, patterns[1] AS pattern, mitigation FROM judged "
        "WHERE state = 'live'",
        "rules_rejected": _with(PART_RULES) + "SELECT rule_seq, id, state, problem FROM judged WHERE state <> 'live'",
        "rules_lint": _with(PART_RULES)
        + "SELECT rule_seq, id, state, problem, CAST(greatest(len(patterns) - 1, 0) AS INTEGER) AS unused_patterns, "
        "CASE WHEN len(patterns) = 0 THEN 0 ELSE count(*) OVER (PARTITION BY patterns[1]) - 1 END AS same_pattern "
        "FROM judged",
        "rules_last": _with(PART_RULES)
        + "SELECT id AS rule_id, description, severity, mitigation FROM ("
        "SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule_seq DESC) AS rn FROM part_rules) WHERE rn = 1",
        "lines": _with(_sources(crlf), LINES)
        + f"SELECT source_seq, line_number, line, {_trim('line')} AS code_snippet FROM lines",
        "route_kind": f"WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {PATH} END AS path FROM documents) "
        "SELECT doc_id AS source_seq, path, CASE WHEN path IS NULL THEN 'no path' "
        "WHEN lower(path) LIKE '%.json' THEN 'JSON artifact' END AS tree_skip FROM s",
        "scan_text": _TEXT_SCAN,
        "scan_pages": _with(PAGE_SOURCES, LINES) + _all_patterns(catalogue.PAGE_RULES),
        "scan_strict": _with(CODE_SOURCES, LINES) + _STRICT_CODE,
        "scan_all_patterns": _with(CODE_SOURCES, LINES)
        + _all_patterns(catalogue.RUST_RULES + catalogue.SOLIDITY_RULES),
        "scan_guarded": _GUARDED_TEXT + "SELECT * FROM findings",
        "scan_guarded_code": _with(CODE_SOURCES, LINES) + _guarded(catalogue.RUST_RULES),
        "scan_context": _with(CODE_SOURCES, LINES) + _context(catalogue.RUST_RULES),
        "scan_all": _ALL + "SELECT * FROM findings",
        "audit_contracts": _with(
            CONTRACTS,
            "sources AS (SELECT p_brand AS program, p_partkey AS source_seq, path, "
            "any_value(head) || string_agg(text, '' ORDER BY i) || '}' || chr(10) AS code "
            "FROM fns GROUP BY p_brand, p_partkey, path)",
            LINES,
        ) + _strict(catalogue.SOLIDITY_RULES) + " UNION ALL " + SETTERS,
        "count_total": _ALL + f"SELECT count(*) AS findings, {verdict} AS verdict FROM findings",
        "count_by_analyzer": _ALL + "SELECT analyzer, count(*) AS findings FROM findings GROUP BY analyzer",
        "count_by_severity": _ALL + "SELECT severity, count(*) AS findings FROM findings GROUP BY severity",
        "count_by_source": _ALL
        + ", kinds_of AS (SELECT unnest(['regex', 'tree', 'model']) AS analyzer) "
        "SELECT s.source_seq, s.path AS source, k.analyzer, count(f.source_seq) AS findings "
        "FROM sources s CROSS JOIN kinds_of k "
        "LEFT JOIN findings f ON f.source_seq = s.source_seq AND f.analyzer = k.analyzer GROUP BY ALL",
        "report_matrix": _GUARDED_TEXT
        + f"SELECT program, source_seq, {_COUNTS}, ['critical', 'high', 'medium', 'low'][min({rank})] AS worst "
        "FROM findings GROUP BY program, source_seq",
        "report_rollup": _GUARDED_TEXT
        + "SELECT program, severity, count(*) AS findings FROM findings GROUP BY ROLLUP (program, severity)",
        "program_report": _COLLECTION + ", " + _PER_PROGRAM + " SELECT * FROM report",
        "program_totals": _COLLECTION + ", " + _PER_PROGRAM
        + " SELECT count(*) AS programs, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings FROM report",
        "program_rejects": f"SELECT DISTINCT 'read' AS stage, 'not UTF-8' AS reason, 'again-' || coalesce(lang, 'none') AS program, "
        f"doc_id // {TEXTS_PER_FILE} AS block FROM documents WHERE coalesce(lang, 'none') <> 'en'",
        "nodes_scan": _with(ITEM_NODES, _check_rows(), FOUND_NODES) + "SELECT * FROM found",
        "nodes_dedup": _with(ITEM_NODES, _check_rows(), FOUND_NODES, FIRST_NODES) + "SELECT * FROM first_nodes",
        "nodes_collapse": _with(ITEM_NODES, _check_rows(), FOUND_NODES, COLLAPSED_NODES) + "SELECT * FROM collapsed",
        "nodes_lexical": _with(CODE_SOURCES, LINES, LEXICAL_NODES) + "SELECT * FROM code_nodes",
        "sol_functions": _with(CONTRACTS)
        + "SELECT path, 'C' || p_partkey AS contract_name, CAST(i AS INTEGER) AS function_pos, name, visibility, "
        "state_mutability, src, modifiers FROM fns",
        "sol_setters": _with(CONTRACTS) + SETTERS,
        "sol_setters_default": _with(CONTRACTS) + SETTERS_DEFAULT,
        "sol_spans": f"SELECT doc_id AS source_seq, {PATH} AS path, "
        f"CAST(strlen(left(text, {start})) AS BIGINT) AS span_offset, "
        f"CAST(1 + length(left(text, {start})) - length(replace(left(text, {start}), {NL}, '')) AS BIGINT) "
        f"AS line_number, {_trim(f'substring(text, {start} + 1, 40)')} AS code_snippet FROM documents",
        "sol_spans_many": f"WITH cut AS (SELECT doc_id, {PATH} AS path, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS n "
        f"FROM (SELECT *, string_split(text, {NL}) AS p FROM documents)) SELECT doc_id AS source_seq, path, "
        "CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        f"AS BIGINT) AS span_offset, n AS line_number, {_trim('line')} AS code_snippet FROM cut",
        "scan_odd_rules": _with(TEXT_SOURCES, LINES) + _odd_scan(),
        "scan_many": _with(TEXT_SOURCES, LINES) + _many_scan(),
        "prompt_build": _requests(),
        "response_parse": _with(TEXT_SOURCES, ANSWERS) + "SELECT * FROM answered",
        "response_shared": "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'shared text of ' || source ELSE text END AS code "
        "FROM documents) SELECT CAST(NULL AS VARCHAR) AS program, doc_id AS source_seq, 'model' AS analyzer, 'M-1' AS rule_id, "
        "'shared' AS vuln_type, 'low' AS severity, left(code, 60) AS message, CAST(NULL AS VARCHAR) AS mitigation, "
        "CAST(1 AS BIGINT) AS line_number, left(code, 10) AS code_snippet, CAST(NULL AS VARCHAR) AS file_path FROM s",
        "response_rejects": _ANSWER_REJECTS,
        "rejects": f"SELECT 'tree' AS stage, {PATH} AS path, 'JSON artifact' AS reason FROM documents "
        f"WHERE doc_id % 4 = 2 UNION ALL SELECT 'tree', {PATH}, 'not a JSON object' FROM documents "
        f"UNION ALL {_ANSWER_REJECTS}",
        "stream_scan": _TEXT_SCAN,
        "stream_files": _with(
            "sources AS (SELECT CAST(NULL AS VARCHAR) AS program, doc_id // 50 AS source_seq, 'block=' || (doc_id // 50) AS path, "
            f"string_agg(text, {NL} ORDER BY doc_id) || {NL} AS code FROM documents GROUP BY doc_id // 50)", LINES,
        ) + f", findings AS ({_strict(catalogue.TEXT_RULES)}) SELECT file_path, rule_id, line_number, code_snippet FROM findings",
        "stream_dedup": "SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'users/hot' ELSE 'users/' || user_id END "
        "AS path, event_type AS code FROM events",
    }
