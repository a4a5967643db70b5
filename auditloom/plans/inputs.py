"""Audit inputs made from the given tables.

The tables hold prose, orders and web pages. Each function turns whole tables, row by row,
into one of the inputs of an audit; nothing is grouped, cut or left out.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.files import list_files, spread, table_sources

# Common words of the four languages, and the code that takes their place in code_sources.
CODE_WORDS = [
    (" the ", " unsafe { "),
    (" of ", " invoke("),
    (" and ", " f32 x * "),
    (" is ", " delegatecall ("),
    (" with ", " x.call {value: "),
    (" to ", " a.transfer("),
    (" that ", " if x.is_signer "),
    (" it ", " p::invoke_signed("),
    (" de ", " fn step"),
    (" la ", " setMinQuorum "),
    (" le ", " setFrame("),
    (" que ", " DOMAIN_SEPARATOR "),
    (" les ", " // reload( "),
    (" en ", " permit("),
    (" der ", " struct Item "),
    (" die ", " loop { "),
    (" und ", " while x "),
    (" von ", " from_bytes("),
]

PATH = (
    "concat('docs/', source, '/', doc_id, "
    "CASE doc_id % 4 WHEN 0 THEN '.sol' WHEN 1 THEN '.SOL' WHEN 2 THEN '.Json' ELSE '.rs' END)"
)


def _tasks(spark: SparkSession) -> int:
    """Tasks for a table that is a single file here."""
    return 2 * spark.sparkContext.defaultParallelism


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents_as(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"), _tasks(spark), "doc_id")
    return table_sources(
        documents, seq=F.col("doc_id"), code=F.expr(code), path=F.expr(PATH), program=F.col("source")
    )


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are; the program is the document source."""
    return _documents_as(spark, sf_dir, "text")


def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with common words replaced by code, so that code rules find something."""
    code = "text"
    for word, piece in CODE_WORDS:
        code = f"replace({code}, '{word}', '{piece}')"
    return _documents_as(spark, sf_dir, code)


def crlf_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with mixed line ends, white space at line ends, and some final ends."""
    code = (
        "concat(replace(replace(text, '. ', '.\\r\\n\\t'), ', ', ',\\u00a0\\n'), "
        "CASE doc_id % 3 WHEN 0 THEN '\\r\\n' WHEN 1 THEN '\\r' ELSE '' END)"
    )
    return _documents_as(spark, sf_dir, code)


# Fixed values. Patterns whose spelling is easily misread, by the number of a brand, and the
# same in the spelling of RE2.
ODD_PATTERNS = [
    (r"(the|of)\s", r"(the|of)[ \t\n\x0b\f\r]"),
    (r"\(?<div>", r"\(?<div>"),
    (r"(?P<word>on)[[:alpha:]]\.", r"(on)[[:alpha:]]\."),
    (r"\$\{env:HOME\}", r"\$\{env:HOME\}"),
    (r"([0-9]{1,3}\.){3}", r"([0-9]{1,3}\.){3}"),
    (r"@\<mail[0-9]\>", r"@mail[0-9]\b"),
    (r"[[:^alpha:]--[:^digit:]]{11}", r"[0-9]{11}"),
    (r"[[:upper:]~~[:alpha:]]{18}", r"[a-z]{18}"),
    (r"[[:print:]&&[^[:alnum:][:space:].,]]{3}", r"[!-+\-/:-@\[-`{-~]{3}"),
    (r"[a-z]\p{^Letter}{3}\p{Uppercase_Letter}", r"[a-z]\P{L}{3}\p{Lu}"),
]


def odd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every brand of the parts, with texts that must stay as they are."""
    number = "CAST(substring(p_brand, 7) AS INT)"
    patterns = F.array(*[F.lit(java) for java, _ in ODD_PATTERNS])
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    return brands.select(
        F.expr(number).alias("rule_seq"),
        F.col("p_brand").alias("id"),
        F.concat(F.lit("reads ${env:HOME} of "), "parts").alias("description"),
        F.lit("low").alias("severity"),
        F.array(F.get(patterns, F.expr(f"{number} % {len(ODD_PATTERNS)}"))).alias("patterns"),
        F.lit(True).alias("enabled"),
        F.lit("${user.home}").alias("mitigation"),
    )


# Pieces of a part's name and two letters by its number, as they stand in patterns.
MANY_PIECES = {
    "head": "left(p_name, 3)",
    "tail": "right(p_name, 3)",
    "a": "chr(CAST(97 + p_partkey % 26 AS INT))",
    "b": "chr(CAST(97 + (p_partkey div 26) % 26 AS INT))",
}
# Fixed values. Forms of these rules by the number of the part: as written, with a class
# inside, with two words, as written the other way round, and, seldom, without a long word.
MANY_FORMS = [
    ["head", "a"], ["tail", "a", "b", "[a-z]*", "[,.]"], ["(", "tail", "a", "|", "head", "b", ")", "[a-z]"], ["a", "b", "head"],
    ["a", "b", "[0-9]+"],
]
MANY_FORM = "CAST(CASE WHEN p_partkey % 500 = 0 THEN 4 ELSE p_partkey % 4 END AS INT)"


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every part; some thousand patterns, each of them in several rules."""
    forms = [
        "concat(" + ", ".join(MANY_PIECES.get(p, f"'{p}'") for p in form) + ")" for form in MANY_FORMS
    ]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("rule_seq"),
        F.expr("concat('M-', p_partkey)").alias("id"),
        F.col("p_name").alias("description"),
        F.lit("low").alias("severity"),
        F.expr(f"array(get(array({', '.join(forms)}), {MANY_FORM}))").alias("patterns"),
        F.expr("p_size % 7 <> 0").alias("enabled"),
        F.col("p_type").alias("mitigation"),
    )


def inline_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without paths, and a blank text beside every tenth of them."""
    documents = table(spark, sf_dir, "documents")
    blank = documents.where("doc_id % 10 = 0").withColumns({
        "doc_id": -1 - F.col("doc_id"), "text": F.lit(" \t\n\u2003"),
    })
    return table_sources(documents.unionByName(blank), seq=F.col("doc_id"), code=F.col("text"))


# Files that are renamed at a time.
RENAMES = 16


def _write_files(rows: DataFrame, folder: str, places: list[str], ending: Callable[[str], str] | None = None) -> None:
    """Texts as files, one for each place, with the texts of a place in the order of ``seq``.

    Spark's writers choose names and endings themselves, so that the files, a few of them
    however many texts there are, get their names afterwards; without ``ending`` they keep them.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(*places).sortWithinPartitions(*places, "seq")
    dealt.select("text", *places).write.partitionBy(*places).text(folder)
    if ending is None:
        return
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(path: str) -> None:
        place, name = path.rsplit("/", 2)[1:]
        end = ending(place) if name.startswith("part-") else ""
        if end and not store.rename(Path(path), Path(path + end)):
            raise OSError(f"{path} cannot be renamed")

    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(rename, [path for path, _ in list_files(spark, folder)]))


# Texts of one source file of a program.
TEXTS_PER_FILE = 500


def write_programs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The documents as code, as a collection of programs: a directory for every document source.

    Those of other languages than English stand there once more, by language, in files with a
    byte that is no UTF-8.
    """
    documents = table(spark, sf_dir, "documents")
    code = "text"
    for word, piece in CODE_WORDS:
        code = f"replace({code}, '{word}', '{piece}')"
    block = F.expr(f"doc_id div {TEXTS_PER_FILE}").alias("block")
    by_source = documents.select(F.col("source").alias("program"), block, F.col("doc_id").alias("seq"), F.expr(code).alias("text"))
    bad = F.expr("CAST(concat(CAST(text AS BINARY), unhex('FF')) AS STRING)")
    lang = F.coalesce("lang", F.lit("none"))
    by_language = documents.withColumn("lang", lang).where("lang <> 'en'").select(
        F.concat(F.lit("again-"), "lang").alias("program"), block, F.col("doc_id").alias("seq"), bad.alias("text")
    )
    _write_files(by_source.unionByName(by_language), folder, ["program", "block"], lambda place: ".rs")


# Fixed values. Endings of files by the number of their place.
PROJECT_ENDINGS = [".sol", ".SOL", ".Json", ".md"]


def write_project(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The benchmark items as files of a project: three directories with eight places each."""
    items = table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL").select(
        F.expr("element_at(array('a', 'b', 'c'), CAST(item_id % 3 AS INT) + 1)").alias("dir"),
        F.expr("item_id % 8").alias("place"), F.col("item_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"),
    )
    _write_files(items, folder, ["dir", "place"], lambda place: PROJECT_ENDINGS[int(place.partition("=")[2]) % 4])


def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as inline sources; every tenth of them has the text of its whole group."""
    text = "CASE WHEN doc_id % 10 = 0 THEN concat('shared text of ', source) ELSE text END"
    return table_sources(table(spark, sf_dir, "documents"), seq=F.col("doc_id"), code=F.expr(text))


def shared_answers(requests: DataFrame) -> DataFrame:
    """One well-formed answer to each request, with the start of its text as the message."""
    item = (
        "to_json(named_struct('rule_id', 'M-1', 'vuln_type', 'shared', 'severity', 'low', 'message', left(code, 60), "
        "'line_number', 1, 'code_snippet', left(code, 10)), map('ignoreNullFields', 'false'))"
    )
    content = f"concat('Found: [', {item}, ']')"
    body = f"to_json(named_struct('choices', array(named_struct('message', named_struct('content', {content})))))"
    return requests.select("source_key", "path", F.expr(body).alias("body"))


def deliver_files(spark: SparkSession, sf_dir: str, folder: str, delivery: int) -> None:
    """The documents as files that arrive in two deliveries, even and odd blocks of them.

    The second delivery brings every third block of the first one once more.
    """
    block = F.expr("doc_id div 50")
    documents = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        block.alias("block"), F.col("doc_id").alias("seq"), "text"
    )
    again = (F.col("block") % 2 == 0) & (F.col("block") % 3 == 0) & F.lit(delivery == 1)
    _write_files(documents.where((F.col("block") % 2 == delivery) | again), f"{folder}/delivery={delivery}", ["block"])


def write_rule_file(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The part rules as a rule file, mode included, in part files whose names keep their order."""

    def value(name: str) -> Column:
        # A string, list or boolean in JSON is one in TOML; an array of it alone has it between its brackets.
        alone = F.to_json(F.array(name))
        return F.substr(alone, F.lit(2), F.length(alone) - 2)

    def line(name: str) -> Column:
        return F.concat(F.lit(f"{name} = "), value(name))

    fields = [line(name) for name in ("id", "description", "severity", "patterns", "enabled")]
    mitigation = F.when(F.col("mitigation").isNotNull(), line("mitigation"))
    # A list without its nulls, joined by line ends; the writer ends the last line.
    text = F.concat_ws("\n", F.lit(""), F.lit("[[rules]]"), *fields, mitigation)
    rules = part_rules(spark, sf_dir).select(F.lit(1).alias("place"), "rule_seq", text.alias("text"))
    head = "\n".join(["[metadata]", 'name = "parts"', "", "[analysis_mode]", "regex = true", "ast = false", "llm = true"])
    first = spark.range(1).select(F.lit(0).alias("place"), F.lit(None).cast("int").alias("rule_seq"), F.lit(head).alias("text"))
    first.unionByName(rules).orderBy("place", "rule_seq").select("text").write.text(folder)


def redelivered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document twice, under paths that several documents share.

    A third of the documents goes to one path; every seventh comes without any.
    """
    documents = table(spark, sf_dir, "documents")
    both = documents.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    path = F.expr(
        "CASE WHEN doc_id % 7 = 0 THEN NULL "
        "WHEN doc_id % 3 = 0 THEN concat('file:///docs/', IF(copy = 1, './', '/'), 'hot.sol') "
        "ELSE concat('/docs', IF(copy = 1, '//', '/'), doc_id % 300, '.sol') END"
    )
    return table_sources(both, seq=F.expr("doc_id * 2 + 1 - copy"), code=F.col("text"), path=path)


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"), _tasks(spark), "page_id")
    return table_sources(pages, seq=F.col("page_id"), code=F.col("html"), path=F.col("url"))


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part, of all states, with ids that repeat."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("rule_seq"),
        F.expr("concat('P-', p_partkey % 1500)").alias("id"),
        F.col("p_name").alias("description"),
        F.expr("CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END")
        .alias("severity"),
        F.expr(
            "CASE p_partkey % 8 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) "
            "WHEN 1 THEN array(p_brand) "
            "WHEN 2 THEN array(concat(p_type, '.*?(?<!', p_brand, ')')) "
            "WHEN 3 THEN array(concat('(', p_name)) "
            "WHEN 4 THEN array(p_name, p_brand) "
            "WHEN 5 THEN array(concat('(', p_type, ')\\\\1')) "
            "WHEN 6 THEN array(concat('[(?=]', p_size, '\\\\\\\\1')) "
            "ELSE array(concat('(?>', p_type, ')'), p_name, p_brand) END"
        ).alias("patterns"),
        F.expr("p_size % 7 <> 0").alias("enabled"),
        F.expr("CASE WHEN p_size % 5 <> 0 THEN p_type END").alias("mitigation"),
    )


def item_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One syntax node per line item; a third of them in one file."""
    return spread(table(spark, sf_dir, "lineitem"), _tasks(spark), "l_orderkey").select(
        F.expr("IF(l_orderkey % 3 = 0, 'src/hot.rs', concat('src/o', l_orderkey, '.rs'))").alias("path"),
        F.expr("(l_orderkey * 8 + l_linenumber) * 200000000 + l_partkey").alias("node_seq"),
        F.expr(
            "CASE l_partkey % 10 WHEN 2 THEN 'method_call' WHEN 3 THEN 'binary' WHEN 4 THEN 'loop' "
            "WHEN 5 THEN 'while' WHEN 6 THEN 'for' WHEN 7 THEN 'fn' WHEN 8 THEN 'struct' ELSE 'call' END"
        ).alias("kind"),
        F.expr(
            "element_at(array('invoke', 'invoke_signed', 'transfer', 'transfer_checked', 'try_from_slice', "
            "'from_bytes', 'create_program_address', 'other'), CAST((l_partkey div 10) % 8 AS INT) + 1)"
        ).alias("name"),
        F.expr("IF(l_partkey % 10 = 9, 2, 1)").alias("path_len"),
        F.expr(
            "element_at(array('+', '-', '*', '/', '+=', '-='), CAST((l_partkey div 10) % 6 AS INT) + 1)"
        ).alias("op"),
        F.expr("CAST(l_quantity AS BIGINT) - 1").alias("line_number"),
        F.expr(
            "CASE l_suppkey % 20 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE concat('stmt ', l_suppkey % 20) END"
        ).alias("snippet"),
    )


_NAMES = "array('setFee', 'UpdateRate', 'sweep', 'configureX', 'GRANTRole', '', 'pause', 'setFrameConfig')"
_PICKS = ["p_size % 8", "p_partkey % 8", "(p_partkey div 8) % 8"]


def _part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contracts of three functions: source text, and where each function lies in it."""
    parts = table(spark, sf_dir, "part").withColumn(
        "head", F.expr("concat('// \\u00fc\\u20ac ', p_name, '\\ncontract C', p_partkey, ' {\\n')")
    )
    for i, pick in enumerate(_PICKS, start=1):
        parts = (
            parts.withColumn(f"name{i}", F.expr(f"element_at({_NAMES}, CAST({pick} AS INT) + 1)"))
            .withColumn(
                f"vis{i}",
                F.expr(f"element_at(array('public', 'external', 'internal', 'private'), (p_size + {i}) % 4 + 1)"),
            )
            .withColumn(
                f"mut{i}",
                F.expr(
                    "element_at(array('nonpayable', 'view', 'payable', 'pure'), "
                    f"CAST((p_partkey div 3 + {i}) % 4 AS INT) + 1)"
                ),
            )
            .withColumn(
                f"text{i}",
                F.expr(f"concat('  function ', name{i}, '(uint256 x) ', vis{i}, ' ', mut{i}, ' {{\\n    y = x;\\n  }}\\n')"),
            )
        )
    return parts.withColumn(
        "path", F.expr("concat('contracts/', p_partkey, IF(p_partkey % 9 = 0, '.JSON', '.sol'))")
    )


def contract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part_functions(spark, sf_dir)
    return table_sources(
        parts, seq=F.col("p_partkey"), code=F.expr("concat(head, text1, text2, text3, '}\\n')"),
        path=F.col("path"), program=F.col("p_brand"),
    )


def contract_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler trees of the contracts; some spans are malformed, some members absent."""
    parts = _part_functions(spark, sf_dir)
    functions = []
    for i in range(1, 4):
        before = " + ".join(["octet_length(head)"] + [f"octet_length(text{j})" for j in range(1, i)])
        functions.append(
            "named_struct('nodeType', 'FunctionDefinition', "
            f"'name', name{i}, 'visibility', vis{i}, 'stateMutability', mut{i}, "
            f"'src', IF(p_partkey % 11 = {i}, 'x:1:0', "
            f"concat({before} + 2, ':', octet_length(text{i}) - 3, ':0')), "
            f"'modifiers', CASE (p_partkey div 5 + {i}) % 5 "
            "WHEN 0 THEN CAST(array() AS ARRAY<STRUCT<modifierName: STRUCT<name: STRING>>>) "
            "WHEN 1 THEN array(named_struct('modifierName', named_struct('name', 'onlyOwner'))) "
            "WHEN 2 THEN array(named_struct('modifierName', named_struct('name', 'lock')), "
            "named_struct('modifierName', named_struct('name', 'ONLYROLE'))) "
            "WHEN 3 THEN array(named_struct('modifierName', named_struct('name', 'onlyOwners'))) END)"
        )
    variable = (
        "named_struct('nodeType', 'VariableDeclaration', 'name', 'y', 'visibility', 'public', "
        "'stateMutability', CAST(NULL AS STRING), 'src', '0:1:0', "
        "'modifiers', CAST(NULL AS ARRAY<STRUCT<modifierName: STRUCT<name: STRING>>>))"
    )
    members = f"array({variable}, {', '.join(functions)})"
    pragma = (
        "named_struct('nodeType', 'PragmaDirective', 'name', CAST(NULL AS STRING), "
        f"'nodes', filter({members}, f -> false))"
    )
    contract = f"named_struct('nodeType', 'ContractDefinition', 'name', concat('C', p_partkey), 'nodes', {members})"
    return parts.select("path", F.expr(f"to_json(named_struct('nodes', array({pragma}, {contract})))").alias("tree"))


def document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in place of trees, and an empty tree beside each."""
    documents = table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), "text")
    return documents.select("path", F.explode(F.array(F.lit(' {"nodes": []}'), "text")).alias("tree"))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One byte span per document, forty characters from somewhere inside it; that of an empty text is empty."""
    # Remainders come before the product, which would not hold every id, and an empty text leaves none.
    size = "nullif(length(text), 0)"
    start = f"CAST(coalesce((doc_id % {size}) * 7919 % {size}, 0) AS INT)"
    src = f"concat(octet_length(left(text, {start})), ':', octet_length(substring(text, {start} + 1, 40)), ':0')"
    # Spans are made where the texts are read, so that no text moves for them.
    return table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), F.expr(src).alias("src"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte span for every line of every document, its line end included."""
    documents = spread(table(spark, sf_dir, "documents"), _tasks(spark), "doc_id")
    pieces = "split(text, '\\n', -1)"
    cut = documents.select(F.expr(PATH).alias("path"), F.expr(f"transform({pieces}, x -> octet_length(x) + 1)").alias("sizes"))
    ends = "aggregate(sizes, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    placed = cut.select("path", "sizes", F.expr(ends).alias("starts"))
    return placed.select("path", F.posexplode("sizes").alias("pos", "size"), "starts").select(
        "path", F.expr("concat(starts[pos], ':', size, ':0')").alias("src")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a model answer: well formed in both styles, or broken."""
    turns = table(spark, sf_dir, "conversations")
    severity = "element_at(array('critical', 'high', 'medium', 'low'), CAST(turn % 4 AS INT) + 1)"
    snake = (
        "to_json(named_struct('rule_id', concat('M-', turn), 'vuln_type', role, "
        f"'severity', {severity}, 'message', text, 'mitigation', IF(turn % 2 = 0, 'review', NULL), "
        "'line_number', conv_id + 1, 'code_snippet', left(text, 20)), map('ignoreNullFields', 'false'))"
    )
    camel = (
        "to_json(named_struct('ruleId', concat('M-', turn), 'vulnType', role, "
        f"'severity', {severity}, 'message', text, 'lineNumber', conv_id + 2, "
        "'codeSnippet', right(text, 20), 'filePath', concat('conv/', conv_id), 'confidence', 0.5))"
    )
    no_severity = "to_json(named_struct('rule_id', 'M-0', 'vuln_type', role, 'message', text))"
    content = (
        "CASE (conv_id + turn) % 7 "
        f"WHEN 0 THEN concat('Found: [', {snake}, '] as asked') "
        f"WHEN 1 THEN concat('[', {snake}, ', ', {camel}, ']') "
        "WHEN 2 THEN 'nothing to report' "
        "WHEN 3 THEN '] no [' "
        f"WHEN 4 THEN concat('[', {snake}, ', ', {no_severity}, ']') "
        f"WHEN 5 THEN concat('[', {camel}, ',]') "
        "ELSE 'none: []' END"
    )
    body = (
        "IF(turn % 2 = 0, "
        f"to_json(named_struct('choices', array(named_struct('message', named_struct('content', {content}))))), "
        f"to_json(named_struct('content', array(named_struct('type', 'text', 'text', {content})))))"
    )
    return turns.select(
        F.expr("conv_id").alias("source_seq"),
        F.expr("concat('conv/', conv_id, '/', turn)").alias("path"),
        F.expr(body).alias("body"),
    )


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table as a stream, be it one file or a folder of them."""
    rows = table(spark, sf_dir, name)
    # A plain path would have to be a folder; a glob may be either.
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/{name}.parque[t]")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of deliveries from the events: one path per user, a third under one path."""
    return _arriving(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("arrived_at"),
        F.expr("IF(event_id % 3 = 0, 'users/hot', concat('users/', user_id))").alias("path"),
        F.col("event_type").alias("code"),
    )


def arriving_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of sources."""
    stream = _arriving(spark, sf_dir, "documents")
    return table_sources(
        stream, seq=F.col("doc_id"), code=F.col("text"), path=F.expr(PATH), program=F.col("source")
    )
