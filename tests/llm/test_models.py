"""Language, quality and token operators on odd rows and against plain versions."""

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import language_id, quality_knn, sentencepiece_codec, token_records
from auditloom.llm.queries import PIECES, WORDS, vocabulary


# Language.


def likelihood(word, known, unknown):
    """Sum over all segmentations of the marked word, one by one."""
    text = language_id.MARK + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(text[start:i])
                start = i
        parts.append(text[start:])
        value = 1.0
        for part in parts:
            value *= known.get(part, unknown if len(part) == 1 else 0.0)
        total += value
    return total


def test_forward_sums_all_segmentations():
    random = np.random.default_rng(1)
    texts = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "bb"]
    pieces = language_id.Pieces(texts)
    shares = random.random((pieces.count, 2))
    shares /= shares.sum(axis=0)
    words = ["a", "ab", "aba", "abba", "babab", "axb", "éa"]
    for at, codes in language_id.code_groups(words):
        sums = language_id.forward(pieces, shares, codes)
        for row, i in zip(sums, at):
            for column in range(2):
                known = {t: shares[n, column] for n, t in enumerate(texts)}
                assert np.isclose(row[column], np.log(likelihood(words[i], known, shares[-1, column])))


def test_expected_counts_add_up():
    texts = ["▁", "a", "b", "ab", "▁a"]
    pieces = language_id.Pieces(texts)
    shares = np.full(pieces.count, 1 / pieces.count)
    for _, codes in language_id.code_groups(["abab", "baba"]):
        counts = language_id.expected_counts(pieces, shares, codes, np.array([2.0, 3.0]))
        lengths = np.array([len(t) for t in texts] + [1])
        assert np.isclose((counts * lengths).sum(), 5 * 5)


def test_languages_of_odd_rows(documents, no_documents):
    model = language_id.learn(documents, vocabulary(PIECES))
    assert model.languages == ["en", "es", "fr", "la"]
    rows = language_id.identify(documents, model)
    assert set(documents.columns) <= set(rows.columns) and rows.columns.count("score") == 1
    found = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == documents.count()
    assert found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und"
    assert found[2].score == 0 and found[1].lang_pred == "en" and found[9].lang_pred == "fr"
    assert language_id.identify(no_documents, model).count() == 0
    nothing = language_id.learn(no_documents, vocabulary(PIECES))
    assert {r.lang_pred for r in language_id.identify(documents, nothing).collect()} == {"und"}


def test_a_very_long_word_has_a_likelihood():
    pieces = language_id.Pieces(["▁", "a"])
    for _, codes in language_id.code_groups(["a" * 3000]):
        assert np.isfinite(language_id.forward(pieces, np.full((3, 1), 1e-5), codes)).all()


def test_counts_of_a_very_long_word():
    pieces = language_id.Pieces(["▁", "a", "aa"])
    shares = np.array([0.2, 0.5, 0.2, 0.1])
    for _, codes in language_id.code_groups(["a" * 10_000]):
        counts = language_id.expected_counts(pieces, shares, codes, np.array([3.0]))
        assert np.isclose((counts * [1, 1, 2, 1]).sum(), 3 * 10_001)
        # Places of one and of two letters, as a chain of that length has them on average.
        assert counts[1] > counts[2] > 0


def test_counts_are_those_of_all_segmentations():
    texts = ["▁", "a", "b", "ab", "▁a", "aba"]
    pieces = language_id.Pieces(texts)
    shares = np.array([0.2, 0.2, 0.1, 0.3, 0.1, 0.05, 0.05])
    word = "abaxbaababab"
    value = likelihood(word, dict(zip(texts, shares)), shares[-1])
    for _, codes in language_id.code_groups([word]):
        counts = language_id.expected_counts(pieces, shares, codes, np.array([1.0]))
    step = 1e-6
    for i, text in enumerate(texts):
        more = dict(zip(texts, shares)) | {text: shares[i] * (1 + step)}
        assert np.isclose(counts[i], (likelihood(word, more, shares[-1]) - value) / (step * value), atol=1e-4)


def test_numerals_are_no_letters(spark):
    texts = ["½ ²", "Ⅷ ①", "12 34", "½ un texto", "x", "…\u00a0!", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labelled = spark.createDataFrame([(1, "some plain english text", "en"), (2, "un texto en otra lengua", "es")], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(rows, language_id.learn(labelled, vocabulary(PIECES))).collect()}
    assert [i for i in found if found[i].lang_pred == "und"] == [0, 1, 2, 5, 6, 7]
    assert all(found[i].score == 0 for i in (0, 1, 2, 5, 6, 7)) and found[3].lang_pred == "es"


# Quality.


def test_quality_of_odd_rows(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 1), (7, 1), (7, 0), (9, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    model = quality_knn.fit(documents, labels)
    assert len(model.labels) == 3
    rows = {r.doc_id: r.score for r in quality_knn.classify(documents, model).collect()}
    assert len(rows) == len({r.doc_id for r in documents.collect()})
    assert all(0 <= s <= 1 for s in rows.values())
    assert rows[1] > 0.9 and rows[9] < 0.1
    assert rows[2] == rows[3]
    assert quality_knn.classify(no_documents, model).count() == 0
    neutral = quality_knn.fit(no_documents, labels)
    assert {r.score for r in quality_knn.classify(documents, neutral).collect()} == {0.5}


def test_votes_are_exact_nearest_neighbours():
    random = np.random.default_rng(3)
    counts = random.poisson(1, (900, quality_knn.TERMS)).astype(np.float32)
    shares = random.random((900, quality_knn._STATISTICS)).astype(np.float32)
    rows = [{"terms": np.concatenate([np.log1p(c), s]).astype(np.float32).tobytes(), "label": i % 3 > 0} for i, (c, s) in enumerate(zip(counts[:200], shares[:200]))]
    model = quality_knn._decompose(rows)
    got = model.scores(counts, shares)
    latent = model.latent(counts, shares)
    for i in range(0, 900, 97):
        cosines = model.vectors @ latent[i]
        near = np.argsort(-cosines)[: quality_knn.NEIGHBOURS]
        weight = np.clip(cosines[near], 0, 1).astype(float) ** quality_knn.SHARPNESS
        assert np.isclose(got[i], (weight * model.labels[near]).sum() / weight.sum(), atol=1e-4)


# Pieces.

ODD = [
    "", " ", "  a  b   ", "é\n\tb", "日本語😀 x", "<s> x</s>", "▁▁a", "a▁b", "\u0000x", "x" * 3000, " " * 50, "ﬁ½ Ⅷ",
    "مرحبا بالعالم", "á é", "🏳️‍🌈" * 20, "\r\n", "<0x41>",
]


def test_parity_with_the_original():
    assert sentencepiece_codec.parity(vocabulary(PIECES), ODD) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_parity_and_round_trip_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert sentencepiece_codec.parity(vocabulary(PIECES), texts) == []


def varint(number):
    out = b""
    while number > 127:
        out += bytes([number & 127 | 128])
        number >>= 7
    return out + bytes([number])


def test_unigram_models_are_rebuilt():
    """A model file written here: unigram scores, byte fallback, extra spaces removed."""
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -2.5, 1), ("b", -3.0, 1), ("ab", -1.0, 1), ("a", -4.0, 1)]
    pieces += [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    data = b""
    for text, score, kind in pieces:
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(kind)
        data += b"\x0a" + varint(len(body)) + body
    trainer = b"\x18\x01" + varint(35 << 3) + b"\x01"
    data += b"\x12" + varint(len(trainer)) + trainer
    spec = b"\x18\x01\x20\x01\x28\x01"
    data += b"\x1a" + varint(len(spec)) + spec
    model = sentencepiece_codec.parse_model(data)
    assert (model.kind, model.byte_fallback, len(model.pieces)) == (1, True, 262)
    codec = sentencepiece_codec.Codec(data, threads=1)
    assert sentencepiece_codec.parity(data, ["ab ab", "  ab   b ", "é", "", "b a"]) == []
    assert codec.decode(codec.encode(["ab é"])) == ["ab é"]


def model_file(pieces, kind, suffix=False):
    data = b""
    for text, score, sort in pieces:
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(sort)
        data += b"\x0a" + varint(len(body)) + body
    trainer = b"\x18" + varint(kind) + (varint(24 << 3) + b"\x01" if suffix else b"")
    return data + b"\x12" + varint(len(trainer)) + trainer


def test_models_that_cannot_be_rebuilt_are_errors():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.0, 1), ("▁a", -1.5, 1)]
    sentencepiece_codec.Codec(model_file(pieces, 1))
    for odd, suffix in ((("ab", 0.0, 4), False), (("ab", 0.0, 5), False), (("b", -3.0, 1), True)):
        with pytest.raises(ValueError, match="read"):
            sentencepiece_codec.Codec(model_file([*pieces, odd], 1, suffix))


def test_odd_and_plain_texts_of_a_block_keep_their_order():
    import sentencepiece

    codec = sentencepiece_codec.Codec(vocabulary(PIECES))
    original = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECES))
    texts = [x for odd in ODD for x in (odd, "plain words here", odd)]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == original.encode(texts)
    assert codec.decode(ids) == [original.decode(x) for x in original.encode(texts)]


def test_encoding_of_odd_rows(documents, no_documents):
    rows = sentencepiece_codec.encode_and_decode(documents, vocabulary(PIECES)).collect()
    assert len(rows) == documents.count()
    for row in rows:
        assert row.same and (row.ids is None) == (row.text is None)
    assert sentencepiece_codec.encode_and_decode(no_documents, vocabulary(PIECES)).count() == 0


# Records.


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/records"


def test_records_of_odd_rows(spark, documents, folder):
    from tokenizers import Tokenizer

    token_records.write_records(documents, folder, vocabulary(WORDS).decode(), 1, part_bytes=50_000)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    expected = sorted(
        ((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in documents.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    got = [(r.key, r.ids) for r in token_records.read_records(spark, folder).orderBy("part", "position").collect()]
    assert got == expected
    digests = token_records.record_digests(spark, folder).orderBy("start").collect()
    assert [r.n_tokens for r in digests] == [len(ids) for _, ids in expected]
    assert [r.start for r in digests] == [0, *np.cumsum([len(ids) for _, ids in expected])[:-1].tolist()]
    # Any record is found by its entry in the index, in any order and as often as it is asked for.
    index = spark.read.parquet(f"{folder}/index")
    shuffled = index.unionByName(index).orderBy(F.xxhash64("part", "offset"))
    read = token_records.read_entries(spark, folder, shuffled).join(index.withColumnRenamed("key", "other"), ["part", "offset"])
    assert read.count() == 2 * len(expected) and read.where("NOT key <=> other").count() == 0
    assert sorted(map(str, (r.ids for r in read.collect()))) == sorted(str(ids) for _, ids in expected * 2)


def test_equal_rows_are_split_over_parts(spark, folder):
    rows = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same text again").alias("text"))
    token_records.write_records(rows, folder, vocabulary(WORDS).decode(), 1, part_bytes=10_000)
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/index").groupBy("part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / len(sizes) and len(sizes) >= 6
    digests = token_records.record_digests(spark, folder)
    assert [r.start for r in digests.orderBy("start").collect()] == list(range(0, 5 * 4000, 5))


def test_damage_is_an_error():
    record = token_records.frame(7, np.array([1, 2, 70_000], dtype=np.uint32)) + b"\n"
    key, ids, end = token_records.unframe(record)
    assert (key, ids.tolist(), end) == (7, [1, 2, 70_000], len(record))
    for at in range(len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_records.unframe(bytes(broken))


def test_no_records(spark, no_documents, folder):
    token_records.write_records(no_documents, folder, vocabulary(WORDS).decode(), 1)
    assert token_records.record_digests(spark, folder).count() == 0


ODD_WORDS = ["the", "THE!!", "don't.", "<|endoftext|>", "x<|ENDOFTEXT|>.", "<|endoftext|>|", "a..b,", "İ,", "ΑΣ.", "Ǆ!", "é́!", "1,", "|"]


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(ODD_WORDS)).map(" ".join)))
def test_words_are_encoded_as_whole_texts_are(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    encoder = token_records.encoder_of(vocabulary(WORDS).decode())
    whole = Tokenizer.from_file(public_tokenizers.path(WORDS)).encode(text, add_special_tokens=False).ids
    ids, offsets = encoder.encode(pa.array([text, "", text], pa.large_string()), 1)
    assert encoder.by_word and ids.tolist() == [*whole, 1, 1, *whole, 1]
    assert offsets.tolist() == [0, len(whole) + 1, len(whole) + 2, 2 * len(whole) + 3]


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    definition = vocabulary("byte_bpe_50k.json").decode()
    texts = ["The cat sat.", "", "two  words\n", "İ é́!"]
    encoder = token_records.Encoder(definition)
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()), 9)
    assert not encoder.by_word
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == [*Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids, 9]


def test_case_is_looked_up_once():
    """ASCII letters count as small ones, but for texts with marks and special words, where case may matter."""
    from tokenizers import Tokenizer

    encoder = token_records.Encoder(vocabulary(WORDS).decode())
    encoder.encode(pa.array(["Word word WORD wOrd, WORD,"], pa.large_string()), 1)
    assert len(encoder.parts.known) == 2
    texts = [
        "H̱ ẖ ẖ Å ÉT", "<|ENDOFTEXT|> <|endoftext|> a<|StartOfText|>B", "KK İI ΣAS ASΣ", "It'S DON'T 5TH",
    ]
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()), 1)
    whole = Tokenizer.from_file(public_tokenizers.path(WORDS))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text


def test_words_are_told_apart_without_the_signs_behind_them():
    """A stem is looked up once whatever signs end it; every small letter and sign is encoded as in whole texts."""
    from tokenizers import Tokenizer

    encoder = token_records.Encoder(vocabulary(WORDS).decode())
    encoder.encode(pa.array(["one one, One. two", "two. TWO, one"], pa.large_string()), 1)
    assert sorted(encoder.parts.known) == [",", ".", "one", "two"]
    letters, signs = token_records._LETTERS, token_records._TRAILING
    texts = [
        " ".join(f"{a}{b} {a}x{a}{b}{c} {b}{a}{c}" for a in letters for c in signs) for b in signs
    ] + ["", " ", ", ...", "x1, (y). é́! don't, É. straße;", " ".join(letters)]
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()), 1)
    whole = Tokenizer.from_file(public_tokenizers.path(WORDS))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text[:80]
