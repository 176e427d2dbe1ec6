"""Encoding, token files and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagelake.llm import bpe, packing, pieces, token_files
from pagelake.llm.queries import QUERIES, tokenizer

BYTES, WORDS, PIECES = (tokenizer(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.01"


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_encoder_equals_library_on_random_texts(path):
    rnd = random.Random(5)
    letters = "ab 'strevmdlD12 \n\t!?’éÉ_ﬁ日 \xa0x²½İſ▁<>|\r\x00\x1c😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rnd.choice("ab' sre") for _ in range(900)), "ab" * 2000, "x" * 5000]
    lib = library(path)
    assert [g.tolist() for g in bpe.encoder(path).encode(texts)] == [lib(t) for t in texts]


def thue_morse(n, a="a", b="b"):
    """Two words of n letters, which any polynomial hash modulo 2**64 confuses from 2**10 letters on."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if o else a for o in odd), "".join(a if o else b for o in odd)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_equal_hash_are_told_apart(path, n):
    lib, pairs = library(path), [thue_morse(n), thue_morse(n, "e", "r")]
    assert len(set(bpe.span_hashes(np.array([ord(c) for t in pairs[0] for c in t]), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 1
    flat = [t for p in pairs for t in p]
    for texts in (flat, [" ".join(flat), " ".join(flat[::-1])], ["x " + flat[1], flat[0] + " x"]):
        one = bpe.PieceEncoder(path) if path == PIECES else bpe.FileEncoder(path)
        want = [lib(t) for t in texts]
        for _ in range(2):  # cold and cached
            assert [g.tolist() for g in one.encode(texts)] == want
        for t, w in zip(texts[::-1], want[::-1], strict=True):  # a chunk each
            assert [g.tolist() for g in one.encode([t])] == [w]
        assert one.other or texts is not flat


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
@pytest.mark.parametrize("seed", range(3))
def test_long_words_equal_library(path, seed):
    rnd = random.Random(seed)
    lib = library(path)
    kinds = ["ab", "aab", "=", "-=", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "enrstai", "the", "日本語中文字の是在", "ÃÂ", "_ ▁"]
    texts = ["".join(rnd.choice(k) for _ in range(rnd.choice([300, 1500, 6000]))) for k in kinds]
    words = [t for t in ("representation", "the", "straightforward", "ation", "ing", "aaa", "====", "tion", "ization")]
    texts += ["".join(rnd.choice(words) for _ in range(n)) for n in (50, 400, 2000)] + ["".join(rnd.choice(["a", "aa", "ab", "=", "--"]) * rnd.randint(1, 300) for _ in range(60))]
    assert [g.tolist() for g in bpe.encoder(path).encode(texts)] == [lib(t) for t in texts]


def test_cache_starts_anew_and_chunks_do_not_matter(monkeypatch, documents):
    monkeypatch.setattr(bpe, "CACHE", 500)
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    lib = library(BYTES)
    texts = [t for _, t in documents[:60]]
    assert [g.tolist() for g in bpe.FileEncoder(BYTES).encode(texts)] == [lib(t) for t in texts]


def test_op8_equals_library(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in QUERIES["op8_sentencepiece"](spark, SF).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        ids = model.encode(text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids))]
        r = got[doc_id]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *sha]


def test_pieces_on_odd_rows(spark, odd_docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r.doc_id, tuple(model.encode(r.text or "")), model.decode(model.encode(r.text or ""))) for r in odd_docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(odd_docs, PIECES, decoded=True).collect()) == want
    assert pieces.encode(no_docs, PIECES).collect() == []
    rows = spark.createDataFrame([(1, [0, 5, 200, 264]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(rows, PIECES).collect()} == {1: model.decode([0, 5, 200, 264]), 2: "", 3: ""}


def brute_tokens(documents, lib):
    start = 0
    for doc_id, text in documents:
        ids = [*lib(text), 2]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op5_equals_library(spark, documents):
    got = sorted(tuple(r) for r in QUERIES["op5_simple8b_files"](spark, SF).collect())
    assert got == list(brute_tokens(documents, library(BYTES)))


def test_token_files_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        token_files.write(docs, BYTES, str(tmp_path / name))
        got = token_files.read(spark, str(tmp_path / name), token_files.crc_column, "crc long").collect()
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        want = brute_tokens([(r.doc_id, r.text or "") for r in rows], library(BYTES))
        assert sorted(map(tuple, got), key=lambda r: r[1]) == list(want)


@pytest.mark.parametrize("seed", range(8))
def test_simple8b_round_trip(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(0, 5000))
    ids = rnd.integers(0, 1 << 63, n, dtype=np.uint64) >> rnd.integers(0, 64, n).astype(np.uint64)
    ids[rnd.random(n) < 0.5] = 0
    words, first, exceptions = token_files.pack_words(ids)
    assert (token_files.unpack_words(words, exceptions) == ids).all()
    assert len(exceptions) == (ids >= 1 << 60).sum()
    for b in range(len(first) - 1):
        assert (token_files.unpack_words(words[first[b] : first[b + 1]], exceptions) == ids[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]).all()


def test_shard_reads_any_range():
    ids = [np.arange(n, dtype=np.uint32) for n in (0, 5000, 1, 3000)]
    shard = token_files.Shard(token_files.write_shard([4, None, 6, 7], ids))
    assert shard.doc_ids == [4, None, 6, 7]
    flat = np.concatenate(ids)
    for a, b in ((0, 8001), (1023, 1025), (2048, 2048), (5000, 8001)):
        assert (shard.ids(a, b) == flat[a:b]).all()


def check_packing(rows, documents, lib, capacity=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(documents)
    for doc_id, text in documents:
        ids, at = [*lib(text), 2], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces_ in by_sequence.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_op1_packs_every_id_once(spark, documents):
    full = check_packing(QUERIES["op1_harmonic_packing"](spark, SF).collect(), documents, library(WORDS))
    assert full > 0.97


def test_packing_on_odd_rows(odd_docs, no_docs):
    single = odd_docs.dropDuplicates(["doc_id", "text"])
    rows = packing.pack(single, WORDS, capacity=64, with_ids=True).collect()
    check_packing(rows, [(r.doc_id, r.text or "") for r in single.collect()], library(WORDS), 64)
    assert all(len(r.ids) == r.length for r in rows)
    assert sum(r.length for r in packing.pack(odd_docs, WORDS).collect()) == sum(len(library(WORDS)(r.text or "")) + 1 for r in odd_docs.collect())
    assert packing.pack(no_docs, WORDS).collect() == []


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000, 1365, 1366, 2047, 2048, 2049, 3000, 4095, 4096, 4097, 20000])
def test_cut_keeps_every_id(n):
    got = packing.cut(n)
    assert sum(a for a, _ in got) == n
    assert all(a <= 4096 // k for a, k in got)


def test_first_fit_never_overfills():
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 100) for _ in range(500)]
    got, fill = packing.first_fit(lengths, 100), Counter()
    for n, (b, o) in sorted(zip(lengths, got, strict=True), key=lambda x: x[1]):
        assert fill[b] == o
        fill[b] += n
    assert max(fill.values()) <= 100
