"""The pipeline, stage by stage, against plain Python."""

import importlib.util
from collections import Counter

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

from pyspark.sql import functions as F

import corpus_pipeline
from pagelake.llm.queries import tokenizer
from test_duplicates import brute_components, brute_fingerprint, brute_removal
from test_native import brute_quality, brute_spans
from test_tokens import check_packing, library

from pagelake.llm import secrets

SF = "/root/testdata/sf0.01"


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        outs.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if len(outs) < 5:
            assert docs.columns == columns
    passed, single, cut, clean, pieces = outs
    failed = {d for d, r in now.items() if brute_quality(r.text)[-1]}
    assert not failed & {r.doc_id for r in passed} and all(r == now[r.doc_id] for r in passed)
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in passed]
    component = brute_components(fps)
    assert sorted(r.doc_id for r in single) == sorted({component[fp] for _, fp in fps})
    removed = brute_removal([r.text for r in single], 35)
    want = {r.doc_id: kept if gone else r.text for r, (_, gone, kept) in zip(single, removed, strict=True)}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    for r in clean:
        text, done, to = want[r.doc_id], "", 0
        for a, _, b in brute_spans(text, secrets.RULES):
            if a >= to:
                done += text[to:a] + "[SECRET]"
            to = max(to, b)
        assert r.text == done + text[to:]
    assert check_packing(pieces, [(r.doc_id, r.text) for r in clean], library(tokenizer("word_bpe_49k.json"))) > 0.9
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces)


CLASH = ("rules", "n_words", "n_removed", "__row", "__t", "row", "key", "fp", "kept", "id", "h", "start")


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Each stage on nulls, repeated rows and ids, and columns of its own names, against plain Python."""
    long = [" ".join(f"w{i}x{j}" for j in range(120)) + "." for i in range(4)]
    extra = [(50, long[0]), (50, long[1]), (51, long[0]), (52, long[0] + " " + long[2]), (None, long[2]), (None, long[3] + " token=abcdefgh1 x"), (53, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(c for c in CLASH if c not in docs.columns)))
    rows = docs.collect()
    key = lambda r: (r.doc_id, r.text)
    fps = {brute_fingerprint(r.text) for r in rows}
    component = brute_components([(i, brute_fingerprint(r.text)) for i, r in enumerate(rows)])
    least = {}
    for r in rows:
        c, own = component[brute_fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0)
        least[c] = min(own, least.get(c, own))
    removed = [r.text if not gone else kept for r, (_, gone, kept) in zip(rows, brute_removal([r.text for r in rows], 35), strict=True)]

    def masked(text):
        done, to = "", 0
        for a, _, b in brute_spans(text, secrets.RULES):
            done, to = done + (text[to:a] + "[SECRET]" if a >= to else ""), max(to, b)
        return None if text is None else done + text[to:]

    outs = [stage(spark, docs, SF) for _, stage in corpus_pipeline.STAGES]
    got = [out.collect() for out in outs]
    assert all(out.columns == docs.columns for out in outs[:4])
    assert all(tuple(r[c] for c in CLASH if c != "h") == tuple(rows[0][c] for c in CLASH if c != "h") for out in got[:4] for r in out)
    assert len(fps) > 5 and got[0] and not any(brute_quality(r.text)[-1] for r in got[0])
    assert set(map(key, got[0])) <= set(map(key, rows))
    assert sorted((component[brute_fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0)) for r in got[1]) == sorted(least.items())
    assert Counter(map(key, got[2])) == Counter(zip([r.doc_id for r in rows], removed, strict=True))
    assert Counter(map(key, got[3])) == Counter((r.doc_id, masked(r.text)) for r in rows)
    assert all(r.n_chars == len(r.text) for out in got[2:4] for r in out if r.text is not None)
    assert all(r.n_chars is None for out in got[2:4] for r in out if r.doc_id == 53)
    assert Counter(r.doc_id for r in got[4] if r.start == 0) == Counter(r.doc_id for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).collect() == []
