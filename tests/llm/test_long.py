"""Very long texts, words and turns: every operator takes them whole."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_duplicates import brute_fingerprint, brute_removal
from test_native import brute_chat, brute_quality, brute_report
from test_tokens import BYTES, PIECES, WORDS, check_packing, library

from pagelake.llm import chat, language, packing, pieces, quality, secrets, simhash, substrings, token_files


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(2000)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    return [long, long[:200_000] + "\n" + long[-150_000:], "ab" * 40_000, "line of text\n" * 8_000, "deadbeef" * 5_000 + " token=" + "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "cast(null as string) as lang")


def test_tokens(spark, docs, texts, tmp_path):
    pairs = list(enumerate(texts))
    check_packing(packing.pack(docs, WORDS).collect(), pairs, library(WORDS))
    token_files.write(docs, BYTES, str(tmp_path / "t"))
    crc = {r.doc_id: r.crc for r in token_files.read(spark, str(tmp_path / "t"), token_files.crc_column, "crc long").collect()}
    assert crc == {i: zlib.crc32(np.array([*library(BYTES)(t), 2], "<u4").tobytes()) for i, t in pairs}
    assert {r.doc_id: list(r.ids) for r in pieces.encode(docs, PIECES).collect()} == {i: library(PIECES)(t) for i, t in pairs}


def test_duplicates(docs, texts):
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = Counter((i, *b) for i, b in enumerate(brute_removal(texts, 35)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.deduplicate(docs).collect()) == want


def test_native(spark, docs, texts):
    assert {tuple(r)[:7] for r in quality.scores(docs).collect()} == {(i, *brute_quality(t)) for i, t in enumerate(texts)}
    assert {tuple(r) for r in secrets.reports(docs).collect()} == {brute_report(i, t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(i // 2, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert {tuple(r)[:5] for r in chat.digests(rows).collect()} == brute_chat(rows.collect())


def test_languages(docs):
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}


def test_windows_whose_hashes_collide_are_kept(spark, monkeypatch):
    """Words of one hash make equal minimizers, but no equal window."""
    from pagelake.session import ROOT  # noqa: F401 - the workers import the patched package by path

    texts = ["a b c d e f g", "x a b c d e y", "p q r s t u v w", "a b c d e f h"]
    monkeypatch.setattr(substrings, "_WORDS", type("Same", (dict,), {"__missing__": lambda self, word: 5})())
    made = [substrings.paths(substrings.Text(t), 5, 3) for t in texts]
    assert len({int(x) for deal, *_ in made for x in deal}) == 1
    assert len({tuple(x) for _, content, *_ in made for x in content.tolist()}) == len({tuple(t.split()[f : f + c + 4]) for t, (_, _, first, count) in zip(texts, made, strict=True) for f, c in zip(first.tolist(), count.tolist(), strict=True)})
