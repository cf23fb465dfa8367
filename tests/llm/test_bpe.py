import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from modelgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "Hello world, it's 12345 o'clock!!  \n\n x", "ÖÄ éè ñandú " * 50, "a" * 3000, "ab" * 700,
    "\u0000\u0001 \U0001f600\U0001f600 <|endoftext|> 你好世界", " \t\r\n" * 40, "don't DON'T we'll" * 3, "=" * 200, "0123456789" * 30,
]


@pytest.fixture(scope="module")
def encoder():
    ranks = bpe.read_ranks(PATH)
    return bpe.PrefixEncoder(ranks, bpe.halves(ranks))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_pieces_match_the_library(encoder, library):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinorst élñ\n.,'0189xZ") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for w in words + [t for t in TEXTS if t]:
        got = [i for p in regex.findall(public_tokenizers.PATTERN, w) for i in encoder.piece(p.encode())]
        assert got == library.encode_ordinary(w)


def test_append_and_edit(encoder):
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"aabcdeinort ") for _ in range(rng.randint(0, 300)))
        last = encoder.extend(data, [])
        more = data + b"tionally"
        assert encoder.extend(more, list(last)) == encoder.extend(more, [])
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 5))
        new, tokens = encoder.edited(data, last, a, b, b"xyz"[: rng.randint(0, 3)])
        assert tokens == encoder.extend(new, [])
        assert encoder.decode(encoder.walk(tokens)) == new


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    enc = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    got = enc.collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_documents(enc, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_matches_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        ids = library.encode_ordinary(text)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), text.encode())]
        want.append((r.doc_id, len(ids), *digests))
    got = bpe.op6_bpe_prefix(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_texts(spark, library):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdeé'0 9", k=7)) for _ in range(40_000)), "x" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
