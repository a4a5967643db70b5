"""One query per operator, each over its whole table."""

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import (
    decontaminate,
    gnat_codes,
    hard_negatives,
    language_id,
    ngram_join,
    pii_bootstrap,
    quality_knn,
    rule_ledger,
    secret_scan,
    sentencepiece_codec,
    token_records,
    toxic_crf,
    url_filter,
)
from auditloom.llm.shared import held_out, scratch_path, stored, table

# Public vocabulary files, by name.
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
# Fixed value: the id that ends each document of op7.
END_ID = 1


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    classifier = quality_knn.fit(documents, labels)
    rows = quality_knn.classify(documents, classifier)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_codec.encode_and_decode(documents, vocabulary(PIECES))
    ids = F.array_join("ids", ",")
    return rows.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.sha2(F.coalesce(ids, F.lit("")), 256).alias("ids_sha256"), "same",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(documents.where(~held_out(F.col("doc_id"))), vocabulary(PIECES))
    rows = language_id.identify(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its own, and its source is the owner."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = secret_scan.scan_secrets(documents, repo="doc_id", owner="source")
    base = secret_scan.base_spans(F.col("candidates"))
    return rows.select(
        "doc_id",
        *[secret_scan.count_kind(F.col("candidates"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("findings")).alias("spans"),
        "n_live",
        "n_copied",
    )


# Fixed values. (host, path, verdict) of the url rules.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "by")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.join_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    documents = table(spark, sf_dir, "documents")
    token_records.write_records(documents, folder, vocabulary(WORDS).decode(), END_ID)
    return token_records.record_digests(spark, folder).withColumnRenamed("key", "doc_id")


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_bootstrap.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seeds = pii_bootstrap.seeds_of(F.col("spans"))
    return rows.select(
        "doc_id",
        *[pii_bootstrap.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii_bootstrap.span_text(seeds), 256).alias("base_sha256"),
        pii_bootstrap.span_text(F.col("spans")).alias("spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.scan_benchmark(documents, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words("spans")
    items = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rule_ledger.fails(rule_ledger.BASE).alias("base_failed"),
        (~rule_ledger.fails(rule_ledger.FULL)).alias("kept"),
        "fail_bits",
    )


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = gnat_codes.fit(vectors)
    coded = gnat_codes.encode(vectors, books).select("vec_id", "label", "code", "error")
    rows = gnat_codes.with_label_error(stored(coded, "codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(vectors, F.col("vec_id"), moved, "embedding")
    return hard_negatives.mine_negatives(rows, F.col("key") % 100 == 0)


def op13_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    rows = toxic_crf.tag(documents, toxic_crf.fit(documents, labels))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), spans.alias("spans"),
    )


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policies does, from a stored ledger of all documents."""
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = stored(rows.select("doc_id", "fail_bits"), "ledger")
    return rule_ledger.ablations(kept, [rule_ledger.BASE, rule_ledger.FULL])


# Fixed values. Hosts and paths of linked pages, by the number of a page.
LINKED_ENDS = ("net", "org", "example.com", "de", "fr", "example.net", "io")
LINKED_PATHS = ("/en/p", "/de/p", "/fr/p", "/x")
HUB = "https://hub.example.org/fr/hub"


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages under hosts of their own, with links by their numbers.

    Of four neighbours the second names the first as canonical and the third redirects to
    the second; some fourths redirect on to a later page; a fifth of all name one hub.
    """
    def url(number: str) -> str:
        ends, paths = (", ".join(f"'{x}'" for x in xs) for xs in (LINKED_ENDS, LINKED_PATHS))
        return (
            f"concat('https://h', {number}, '.', element_at(array({ends}), CAST(({number}) % {len(LINKED_ENDS)} AS INT) + 1), "
            f"element_at(array({paths}), CAST(({number}) div 3 % {len(LINKED_PATHS)} AS INT) + 1))"
        )

    canonical, refresh = "<link rel=\"canonical\" href=\"%s\">", "<meta http-equiv=refresh content=\"0; url=%s\">"
    link = (
        f"CASE WHEN page_id % 5 = 0 THEN format_string('{canonical}', '{HUB}') "
        f"WHEN page_id % 4 = 1 THEN format_string('{canonical}', {url('page_id - 1')}) "
        f"WHEN page_id % 4 = 2 THEN format_string('{refresh}', {url('page_id - 1')}) "
        f"WHEN page_id % 16 = 3 THEN format_string('{refresh}', {url('page_id + 13')}) ELSE '' END"
    )
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    return pages.select("page_id", F.expr(url("page_id")).alias("url"), F.expr(f"concat(coalesce(html, ''), {link})").alias("html"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links, judged by rules and, through their components, by those of their aliases."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = url_filter.filter_urls(linked_pages(spark, sf_dir), rules)
    return rows.select("page_id", "host", "path", "rule", "verdict", "by")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": op1_quality_knn,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_records": op7_token_records,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_decontaminate": op9_decontaminate,
    "op10_rule_ledger": op10_rule_ledger,
    "op11_gnat_codes": op11_gnat_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxic_crf": op13_toxic_crf,
    "url_aliases": url_aliases,
    "ledger_ablations": ledger_ablations,
}
