import hashlib

import numpy as np
import pytest

from lotweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    None,
    "",
    "   ",
    "Hello, WORLD it's 12 o'clock",
    "a" * 5000 + "_" * 301,
    "é é ΣΑΣ İ ß",
    "x<|endoftext|>y <|startoftext|>",
    "tab\tnew\nline\x1cfs　wide\xa0",
    "日本語 ٣ ½ 😀👍🏽",
    "</w> <w>",
]


def test_matches_the_library(spark, library):
    df = spark.createDataFrame([(k, t, "extra", 1) for k, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, ids string, _k int")
    rows = {r.doc_id: r for r in bpe.encode(df, bpe.vocabulary()).collect()}
    assert len(rows) == len(TEXTS) + 1
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(np.frombuffer(rows[k].ids, "<u4")) == ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].decoded == library.decode(ids, skip_special_tokens=False)


def test_vocabulary_strings(library):
    b = bpe.WordBPE(bpe.vocabulary())
    for t in list(library.get_vocab())[::7]:
        t = t.replace("</w>", "")
        assert list(np.frombuffer(b.packed(t + t, bpe.Known()), "<u4")) == library.encode(t + t, add_special_tokens=False).ids


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_array_decode_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, "")], "doc_id long, text string")
    enc = bpe.encode(df, bpe.vocabulary(), decoded=False)
    rows = {r.doc_id: r for r in enc.withColumn("a", bpe.ids_array("ids")).collect()}
    assert rows[1].a == list(np.frombuffer(rows[1].ids, "<u4")) and rows[2].a == []
    assert {r.doc_id: r.decoded for r in bpe.decode(enc, bpe.vocabulary()).collect()} == {1: "hello</w> there</w>", 2: ""}
    assert bpe.encode(df.limit(0), bpe.vocabulary()).count() == 0


def test_texts_that_read_like_remembered_words(library):
    b, known = bpe.WordBPE(bpe.vocabulary()), bpe.Known()
    for t in ["the\uffff cat\uffff", "the, cat", "the cat", "\uffff", "thě\uffff thĂ\uffff é", "é thÄ\uffff"]:
        for _ in range(2):
            assert list(np.frombuffer(b.packed(t, known), "<u4")) == library.encode(t, add_special_tokens=False).ids, t


def test_all_code_points(library):
    """Each beside a letter and a digit, so that its class counts; of the large blocks without case (from U+3400) every 37th."""
    b, known = bpe.WordBPE(bpe.vocabulary()), bpe.Known()
    large = [(0x3400, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xF900), (0x20000, 0x110000)]
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 37 == 0 or not any(a <= c < z for a, z in large))]
    texts = [" ".join(f"a{c}7" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = np.frombuffer(b.packed(t, known), "<u4")
        assert np.array_equal(got, np.array(e.ids, np.uint32)), t[:40]
