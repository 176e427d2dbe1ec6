"""SimHash links and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelake.llm import components, simhash, substrings
from pagelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest id reached, by all pairs of distinct fingerprints."""
    ids = defaultdict(list)
    for doc_id, fp in fps:
        ids[fp].append(doc_id)
    nodes = np.array(list(ids), np.uint64)
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, fp in enumerate(nodes.tolist()):
        for d in ids[fp]:
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
    return {fp: least.get(find(i)) for i, fp in enumerate(nodes.tolist())}


def test_op2_equals_brute_force(spark):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    component = brute_components(docs)
    got = sorted(tuple(r) for r in QUERIES["op2_simhash_variants"](spark, SF).collect())
    assert got == sorted((d, f"{fp:016x}", component[fp]) for d, fp in docs)
    assert len({c for _, _, c in got}) < len(got)


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.collect()]
    component = brute_components(docs)
    got = Counter(tuple(r) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == Counter((d, f"{fp:016x}", component[fp]) for d, fp in docs)
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_representatives_drop_no_unique_text(spark, odd_docs, no_docs, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    rows = [(1, texts[0], 5), (1, texts[1], 6), (2, texts[0], 7), (None, texts[2], 8), (None, texts[2], 8), (None, texts[3], 9), (3, texts[3], 9), (4, texts[4], 1), (4, texts[4], 1), (4, texts[4], 0), (0, texts[1], 2), (None, None, 3), (9, " ", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long").select("*", *(F.lit(i).alias(c) for i, c in enumerate(("row", "key", "fp", "root", "least", "n"))))
    got = sorted((tuple(r)[:3] for r in simhash.representatives(docs).collect()), key=str)
    assert got == sorted([(1, texts[0], 5), (0, texts[1], 2), (None, texts[2], 8), (3, texts[3], 9), (4, texts[4], 0), (9, " ", 4)], key=str)
    assert simhash.representatives(docs).columns == docs.columns
    component = brute_components([((r.doc_id is None, r.doc_id or 0), brute_fingerprint(r.text)) for r in odd_docs.collect()])
    kept = [(component[brute_fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0)) for r in simhash.representatives(odd_docs).collect()]
    assert sorted(c for c, _ in kept) == sorted(set(component.values())) and all(c == k for c, k in kept)
    assert simhash.representatives(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_close_fingerprints_connect(spark, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(12)] + [0]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)}
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.links(df)
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(found).collect()}
    want = brute_components([(f, f) for f in fps])
    groups = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[0][roots.get(f, f)].add(f)
        groups[1][want[f]].add(f)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))
    assert all((a ^ b).bit_count() <= 3 for a, b in ((r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(301)}


def brute_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((len(w), sum(gone), kept))
    return out


def test_op3_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, g, k) in zip(docs, brute_removal([t for _, t in docs], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_debruijn_substrings"](spark, SF).collect()}
    assert got == want
    assert sum(g for _, g, _ in want.values()) > 0


@pytest.mark.parametrize("seed", range(4))
def test_substrings_on_few_words(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "HOLD", 20)
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abc ") for _ in range(90)) for _ in range(4)]
    texts = [" ".join(rnd.choice([*shared, "x y z", "q " * 9]) for _ in range(rnd.randint(0, 6))) for _ in range(40)] + [shared[0]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window, kmer in ((5, 3), (8, 2), (6, 6)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.deduplicate(df, window, kmer).collect()}
        assert got == dict(enumerate(brute_removal(texts, window)))


def test_substrings_on_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute_removal([r.text for r in rows], 5), strict=True))
    out = substrings.deduplicate(odd_docs, 5, 3)
    clash = odd_docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("row", "n_words", "n_removed", "__row", "__text", "__places"))))
    kept = substrings.without_repeats(clash, 5, 3)
    assert kept.columns == clash.columns
    undone = Counter((*tuple(r)[:1], r.text if not b[1] else b[2], *tuple(r)[2:]) for r, b in zip(clash.collect(), brute_removal([r.text for r in rows], 5), strict=True))
    assert Counter(map(tuple, kept.collect())) == undone
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == want
    assert substrings.deduplicate(no_docs).collect() == []
