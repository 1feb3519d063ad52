import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlight.llm import bpe, packing

ODD = [None, "", " ", "\n\n", "a" * 30_000, "ab " * 20_000, "<|endoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "naïve Ünïcödé 日本語 🙂‍🙂 e\u0301", "tab\tnl\r\n\x1c\x85\xa0end", "don't they'll 12345 !!!,,,", "  two  spaces "]
TEXT = st.text(alphabet="abcdethé  \n\t'sßÀÉÿ÷日🙂.,!01<|>endoftx\u0301\x1c", max_size=60)


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(bpe.BYTE_BPE)


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(packing.WORD_BPE)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(text):
    ref = Tokenizer.from_file(bpe.BYTE_BPE) if not hasattr(test_bpe_equals_the_library, "ref") else test_bpe_equals_the_library.ref
    test_bpe_equals_the_library.ref = ref
    c = bpe.codec()
    ids = c.encode(text)
    want = ref.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and c.decode(ids) == ref.decode(want, skip_special_tokens=False)
    assert c.decimals(ids) == ",".join(map(str, want)).encode() or not want


def test_bpe_of_every_token(byte_bpe):
    c = bpe.codec()
    rng = random.Random(4)
    words = rng.sample([t for t in byte_bpe.get_vocab() if "Ġ" not in t and t.isascii()], 3000)
    for i in range(0, 3000, 3):
        text = "".join(words[i : i + 3])
        assert c.encode(text).tolist() == byte_bpe.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark, byte_bpe):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(1, "again", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()}
    want = set()
    for i, t, _ in rows:
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids
        text = byte_bpe.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    back = {(r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert bpe.digests(df.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(packing.WORD_BPE)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_equal_the_library(text):
    ref = getattr(test_words_equal_the_library, "ref", None) or Tokenizer.from_file(packing.WORD_BPE)
    test_words_equal_the_library.ref = ref
    assert np.frombuffer(packing.words().encode(text), np.uint16).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        g = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = packing.hilbert_key(g, bits)
        assert sorted(key) == list(range(len(g)))
        assert (np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(1) == 1).all()


def check_pieces(pieces, rows, ref, tokens):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ref.encode(t or "", add_special_tokens=False).ids + [packing.END_ID])
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i, docs in want.items():
        if len(docs) > 1:
            assert sum(p.length for p in by[i]) == sum(map(len, docs))
            continue
        at, ids = 0, np.array(docs[0], "<u4")
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == tokens or at < tokens and at & (at - 1) == 0
    assert by.keys() == want.keys()


@pytest.mark.parametrize("size", [10_000_000, 9_000])
def test_packing(spark, word_bpe, size, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", size)
    rows = list(enumerate(ODD)) + [(100 + i, f"copy of one text {'x y z ' * 40}") for i in range(60)] + [(7, "same id"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id bigint, text string, part int, hkey string")
    check_pieces(packing.pack(df, tokens=256).collect(), rows, word_bpe, 256)
    assert packing.pack(df.limit(0)).count() == 0
    ids = [x for p in packing.pack(df.where("doc_id = 10"), keep_ids=True).orderBy("start").collect() for x in p.ids]
    assert ids == word_bpe.encode(ODD[10], add_special_tokens=False).ids + [2]


def test_alike_documents_lie_together(spark):
    random.seed(8)
    topics = [[f"{chr(97 + t)}{i}" for i in range(30)] for t in range(3)]
    rows = [(i, " ".join(random.choices(topics[i % 3], k=200))) for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("sequence_id", "offset").collect()
    order = [p.doc_id % 3 for p in got if p.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) < 30  # by chance it would be about 60


def test_ranges_are_even_in_ids_not_in_documents(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(500)]
    rows = [(7 if i % 3 else i, " ".join(rng.choices(vocabulary[: 20 if i % 2 else 500], k=400 if i % 10 == 0 else 5))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).cache()
    monkeypatch.setattr(packing, "RANGE_BYTES", 50_000)
    monkeypatch.setattr(packing, "SAMPLE_DOCS", 500)
    cuts = packing.range_cuts(docs, "doc_id", "text", packing.WORD_BPE, 2)
    sized = packing.tokenize(docs, cuts=cuts).selectExpr("part", "length(ids) n").groupBy("part").sum("n").collect()
    n = [r[1] for r in sized]
    assert len(cuts) >= 8 and len(n) == len(cuts) + 1 and max(n) < 3 * sum(n) / len(n)
    docs.unpersist()
