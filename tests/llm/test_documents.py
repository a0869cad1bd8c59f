"""Operators that look at one document at a time, and the classifier."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from plumbline.llm import quality_classifier, quality_rules, token_counts
from plumbline.llm.bpe import encoder
from plumbline.llm.quality_classifier import isotonic
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", "\n", " ", "a\n\na\n", "a b c d e a b c d e f", "a\r\na\r\n a", "é é\n\n\né é", None, "x", "  a  b ",
    "it's  \n\n x\t'll we''s don't", "a\xa0b \x85c\x1cd\x1e e ²½ ªº µ ", "日本語 テスト😀😀x", "<|endoftext|> <s> <0x0A> x",
    "▁a a▁b", "a" * 500, "ǅ ʰx ƻ Ȁ ñ’x “q”", "# * | < > & % $ " * 4, "one two three four five six " * 12,
]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").limit(120).collect()
    return [r.text for r in docs] + ODD


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, "no", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int").repartition(3)


def test_repetition_equals_brute_force(spark, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = [tuple(r[n] for n in names) for r in quality_rules.judge(frame(spark, texts)).collect()]
    assert brute.ordered(got) == brute.ordered(map(brute.repetition, texts))
    assert all(not (r.base_failed and r.kept) for r in quality_rules.judge(frame(spark, texts)).collect())


def test_repetition_chunks_do_not_matter(texts):
    import pyarrow as pa

    from plumbline.llm.texts import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seen = []
    for limit in (1, 5000, 1 << 21):
        parts = [quality_rules.measure(o, d, quality_rules.GRAM_SHARES) for _, _, o, d in chunks(batch, limit=limit)]
        seen.append({k: np.concatenate([p[k] for p in parts]).tolist() for k in parts[0]})
    assert seen[0] == seen[1] == seen[2]


def test_long_ngrams_fail_on_their_own(spark):
    random.seed(1)
    fresh = " ".join(f"w{random.random()}" for _ in range(400))
    again = " ".join(f"long{i}" * 60 for i in range(11))
    rows = [(1, fresh), (2, f"{fresh} {again} {fresh[:30]} {again}")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].base_failed and not got[2].kept


def test_token_counts_equal_the_library(spark, texts):
    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    wanted = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.count_tokens(frame(spark, texts)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(wanted)


def test_token_counts_without_byte_pieces_fuse_unknown_characters():
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("aba", -3.0)]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(vocabulary)
    random.seed(2)
    for _ in range(300):
        word = "▁" + "".join(random.choice("abxy") for _ in range(random.randint(1, 12)))
        assert counter.solve(word) == len(library.encode(word[1:], add_special_tokens=False).ids), word


def test_encoder_equals_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for text in texts:
        ids = np.frombuffer(encoder(path).text(text or ""), "<u4").tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids


def test_isotonic():
    assert isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]
    draw = np.random.default_rng(3)
    values, weights = draw.random(40), draw.integers(1, 5, 40).astype(float)
    fitted = isotonic(values, weights)
    assert (np.diff(fitted) >= 0).all()
    assert np.isclose((fitted * weights).sum(), (values * weights).sum())


def test_classifier_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.classify(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert found.count() == docs.count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_odd_inputs(spark, texts):
    df = frame(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.classify(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality_classifier.classify(df, labels).count() == len(texts)
    passed = quality_classifier.classify(df, labels, others=("text", "kept")).collect()
    assert sorted(str(r.text) for r in passed) == sorted(map(str, texts))
    assert not any(r.held_out for r in passed if r.doc_id is None)


def test_keys_named_like_results(spark):
    df = spark.createDataFrame([(4, "a b"), (None, None)], "N_tokens long, text string")
    got = token_counts.count_tokens(df, key="N_tokens")
    assert got.columns == ["key_N_tokens", "n_code_points", "n_tokens"]
    assert {(r[0], r[1]) for r in got.collect()} == {(4, 3), (None, 0)}
    got = quality_rules.judge(df.withColumnRenamed("N_tokens", "kept"), key="kept")
    assert got.columns[0] == "key_kept" and {(r[0], r.n_words) for r in got.collect()} == {(4, 2), (None, 0)}


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(empty).count() == 0
    assert token_counts.count_tokens(empty).count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0


def test_batches_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    got = quality_rules.judge(df).collect()
    assert [(r.n_words, r.n_dup_lines, r.base_failed, r.kept) for r in got] == [(0, 0, True, False)] * 2
    assert [r.n_tokens for r in token_counts.count_tokens(df).collect()] == [0, 0]
