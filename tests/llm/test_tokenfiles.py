import struct
import zlib

import duckdb
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from modelgraph.llm import tokenfiles

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'st 1,\n\t\r\x1c\x85 ᠎ 　﻿é🎉"), max_size=30))
def test_cut_texts_have_the_library_s_ids(text):
    encoder = test_cut_texts_have_the_library_s_ids.__dict__.setdefault("encoder", tokenfiles.WordEncoder(PATH, 2, most=50))
    (got,) = encoder.encode([text])
    assert list(struct.unpack(f"<{len(got) // 2}H", got)) == ids(text)[:-1]


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (3, ""), (None, "no id"), (None, None), (7, "long text, " * 20_000), (2, "twice"), (2, "twice"), (2, "other"), (-4, "<|endoftext|> é🎉"), (9, "y" * 5000)] + [(i, f"document {i}") for i in range(20, 60)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, shard string")
    folder = f"{tmp_path}/out"
    tokenfiles.write(docs, folder, PATH)
    got = sorted(tokenfiles.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted((str(i), struct.pack(f"<{len(ids(t))}I", *ids(t))) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    some = {r.doc_id: r for r in got if r.doc_id in (7, 33)}
    assert {r.doc_id: r for r in tokenfiles.read_documents(spark, folder, [7, 33, 1000, None]).collect()} == some
    assert tokenfiles.read_documents(spark, folder, [10**9]).collect() == []


def test_other_dictionary_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    tokenfiles.write(docs, f"{tmp_path}/a", PATH)
    data = spark.read.format("binaryFile").load(f"{tmp_path}/a/shards").select("content").first()[0]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.Shard(bytes(data), zstandard.ZstdCompressionDict(b"another one"))


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write(docs, f"{tmp_path}/a", PATH)
    assert tokenfiles.read(spark, f"{tmp_path}/a").collect() == []


def test_query(spark):
    start, want = 0, []
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall():
        x = ids(text)
        want.append((doc_id, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    assert sorted(map(tuple, tokenfiles.op13_token_files(spark, SF).collect())) == want


def test_signs_are_no_part_of_words():
    encoder = tokenfiles.WordEncoder(PATH, 2)
    text = "one word, word. word$$$ word\nword größe, größe"
    (got,) = encoder.encode([text])
    assert list(struct.unpack(f"<{len(got) // 2}H", got)) == ids(text)[:-1]
    assert set(encoder.young) == {"one".encode(), b" word", b",", b".", b"$$$", b"\nword", " größe".encode()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé×÷ß'st 1,.$\n\t\r\x1c\x85\xa0᠎ 　﻿…🎉́\x00\x7f"), max_size=20), max_size=8))
def test_texts_of_one_call_do_not_touch(texts):
    encoder = test_texts_of_one_call_do_not_touch.__dict__.setdefault("encoder", tokenfiles.WordEncoder(PATH, 2, most=50))
    got = encoder.encode(texts)
    assert [list(struct.unpack(f"<{len(g) // 2}H", g)) for g in got] == [ids(t)[:-1] for t in texts]
