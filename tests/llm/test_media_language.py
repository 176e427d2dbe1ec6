"""Audio fingerprints, language codes and the pipeline."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelake.llm import audio, language
from pagelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tune(seed, notes=70):
    return audio.melody(np.random.default_rng(seed).uniform(-0.4, 0.4, notes))[0]


@pytest.fixture(scope="module")
def recordings():
    """Four tunes, and of the first: a copy, a later start, a noisy and a quieter version."""
    noise = np.random.default_rng(0).normal(0, 800, len(tune(1)))
    out = {20: tune(1), 21: tune(1), 22: tune(1)[audio.HOP * 20 :], 23: tune(1) + noise, 24: tune(1) * 0.3, 40: tune(2), 41: tune(3), 42: tune(4)}
    return {k: audio.write_wave(v) for k, v in out.items()}


def brute_align(p, q):
    """(shift, size, errors) of the best offset at which two recordings match, offset by offset; or None."""
    best = None
    move_p, move_q = ([i == 0 or x[i] != x[i - 1] for i in range(len(x))] for x in (p, q))
    for shift in range(1 - len(q), len(p)):
        low = max(0, shift)
        size = min(len(p), len(q) + shift) - low
        a, b = p[low : low + size], q[low - shift : low - shift + size]
        errors = int(np.bitwise_count(a ^ b).sum())
        if errors > audio.ERRORS * 32 * size:
            continue
        whole = size == min(len(p), len(q))
        changes = min(sum(move_p[low : low + size]), sum(move_q[low - shift : low - shift + size]))
        same = a == b
        votes = sum(s and x and y for s, x, y in zip(same.tolist(), move_p[low : low + size], move_q[low - shift : low - shift + size], strict=True))
        long = size >= audio.WIDTH and (whole or changes >= audio.VOTES)
        if long or votes >= audio.VOTES or whole and int(same.sum()) >= min(audio.VOTES, size):
            rank = (errors - 16 * size, abs(shift), shift)
            if best is None or rank < best[0]:
                best = rank, shift, size, errors
    return best and best[1:]


def brute_search(prints, asks):
    """Class of each recording, and of each linked pair of classes (a < b where both ask, else a asks) its alignment."""
    classes = {}
    for k, p in sorted(prints.items()):
        classes.setdefault(p.tobytes(), []).append(k)
    own = {ks[0]: np.frombuffer(p, np.uint32) for p, ks in classes.items()}
    asking = {ks[0] for ks in classes.values() if any(asks(k) for k in ks)}
    links = {}
    for a in asking:
        for b in own:
            if a != b and len(own[a]) and len(own[b]) and not (b in asking and b < a) and (got := brute_align(own[a], own[b])):
                links[a, b] = got
    return {k: ks[0] for ks in classes.values() for k in ks}, links


def check_search(rows, prints, asks):
    own, links = brute_search({r.id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}, asks)
    each = defaultdict(list)
    for (a, b), (shift, size, errors) in links.items():
        each[a].append((errors / size, b, shift, errors, size))
        each[b].append((errors / size, a, -shift, errors, size))
    for k, r in rows.items():
        best = min(each[own[k]], default=(None,) * 5)
        assert (r.class_id, r.n_links, r.best_id, r["shift"], r.bit_errors, r.frames) == (own[k], len(each[own[k]]), *best[1:])
    return links


def test_op6_operator_aligns_recordings(spark, recordings):
    df = spark.createDataFrame([*recordings.items(), (30, b"no wave"), (31, None), (32, audio.write_wave(np.zeros(100)))], "id long, media binary")
    prints = audio.fingerprints(df, "id", "media")
    rows = {r.id: r for r in audio.search(prints, "id", "id % 20 = 0").collect()}
    check_search(rows, prints, lambda k: k % 20 == 0)
    assert rows[22].best_id == 20 and rows[22]["shift"] == -20 and rows[23].best_id == 20 and rows[23]["shift"] == 0
    assert rows[42].n_links == 0 and rows[30].n_frames == 0 and rows[21].class_id == 20
    assert audio.search(prints.limit(0), "id", "id % 20 = 0").collect() == []


def test_op6_equals_brute_force(spark):
    """The query itself, over every vector of a small table."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    prints = audio.fingerprints(vectors, "vec_id", "embedding", audio.melody).withColumnRenamed("vec_id", "id")
    rows = {r.vec_id: r for r in QUERIES["op6_chroma_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == vectors.count() and check_search(rows, prints, lambda k: k % 20 == 0)


def brute_print(samples):
    """Every filter by plain sums over its rectangles."""
    frames = audio.chroma(samples, audio.RATE)
    wide = np.hstack([frames, frames])
    out = []
    for t in range(len(frames) - audio.WIDTH + 1):
        x = 0
        for kind, p, h, w in audio.bank():
            f = wide[t : t + w]
            m, q, third = w // 2, p + h // 2, w // 4
            if kind == 0:
                a, b = f[:, p : p + h].sum() * (12 - h) / h, f[:, :12].sum() - f[:, p : p + h].sum()
            elif kind == 1:
                a, b = f[:, p:q].sum() * (h - h // 2) / max(h // 2, 1), f[:, q : p + h].sum()
            elif kind == 2:
                a, b = f[:m, p : p + h].sum(), f[m:, p : p + h].sum()
            elif kind == 3:
                a, b = f[:m, p:q].sum() + f[m:, q : p + h].sum(), f[m:, p:q].sum() + f[:m, q : p + h].sum()
            else:
                a, b = f[third : w - third, p : p + h].sum(), f[:third, p : p + h].sum() + f[w - third :, p : p + h].sum()
            level = sum(math.log((a + 0.1) / (max(b, 0) + 0.1)) >= step for step in audio.STEPS)
            x = x << 2 | (level ^ level >> 1)
        out.append(x)
    return np.array(out, np.uint32)


@pytest.mark.parametrize("seed", range(3))
def test_filters_equal_plain_sums(seed):
    samples = tune(seed, 30) + np.random.default_rng(seed).normal(0, 300, len(tune(seed, 30)))
    got, want = audio.fingerprint(samples, audio.RATE), brute_print(samples)
    assert len(got) == len(want) and np.bitwise_count(got ^ want).sum() <= 2  # a sum that lies on a step may round to either side


def test_op6_recall_on_recordings(spark):
    """Noisy, later and shorter versions of tunes among strangers; of at least 0.9 the original is found."""
    rng = np.random.default_rng(5)
    out, truth = {}, {}
    for i in range(25):
        t = tune(100 + i, 80)
        out[1000 * i] = t
        versions = [t + rng.normal(0, 1500, len(t)), np.r_[rng.normal(0, 300, audio.HOP * 37 + 100), t], t[len(t) // 3 :], t[: len(t) // 2] * 0.2, t[audio.RATE :][: 6 * audio.RATE] + rng.normal(0, 500, 6 * audio.RATE)]
        for k, v in enumerate(versions, 1):
            out[1000 * i + k] = v
            truth[1000 * i + k] = 1000 * i
    rows = {r.id: r for r in audio.search(audio.fingerprints(spark.createDataFrame([(k, audio.write_wave(v)) for k, v in out.items()], "id long, media binary"), "id", "media"), "id", "id % 1000 = 0").collect()}
    recall = sum(rows[k].best_id == a for k, a in truth.items()) / len(truth)
    assert recall >= 0.9, recall


def test_a_long_recording_is_taken_whole(spark):
    t = tune(9, 4000)  # over eight minutes
    rows = {r.id: r for r in audio.search(audio.fingerprints(spark.createDataFrame([(0, audio.write_wave(t)), (1, audio.write_wave(t[len(t) - 20 * audio.RATE :]))], "id long, media binary"), "id", "media"), "id", "id = 0").collect()}
    assert rows[1].best_id == 0 and rows[0].n_frames > 5000 and abs(rows[1]["shift"] + (len(t) - 20 * audio.RATE) / audio.HOP) <= 1


def test_integral_image_equals_plain_sums():
    samples = tune(5, 30)
    frames = audio.chroma(samples, audio.RATE)
    prints = audio.fingerprint(samples, audio.RATE)
    kind, p, h, w = audio.bank()[2]
    assert kind == 2
    wide = np.hstack([frames, frames])
    for t in (0, 3, len(prints) - 1):
        a, b = wide[t : t + w // 2, p : p + h].sum(), wide[t + w // 2 : t + w, p : p + h].sum()
        level = int(np.digitize(np.log((a + 0.1) / (b + 0.1)), audio.STEPS))
        assert int(prints[t]) >> 2 * (audio.FILTERS - 1 - 2) & 3 == level ^ level >> 1


def test_op9_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_output_codes"](spark, SF).collect()]
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.25
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def brute_language(rows):
    """The same classifier, text by text and n-gram by n-gram."""
    def buckets(text):
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in b" " + text.encode() + b" ")
        return [((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> (32 - language.BITS) for i in range(len(raw) - 2)]

    fold = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 5
    counts = defaultdict(Counter)
    for k, text, lang in rows:
        if fold(k) and text is not None and lang is not None:
            counts[lang].update(buckets(text))
    names = sorted(counts)
    words = language.codewords(len(names))
    totals = {n: sum(counts[n].values()) + language.SMOOTH * language.BUCKETS for n in names}
    weight = {}
    out = []
    for k, text, _ in rows:
        if not names or text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
            out.append((k, fold(k) == 0, "und", 0.0))
            continue
        sums = [0.0] * words.shape[1]
        got = buckets(text)
        for b in got:
            if b not in weight:
                rate = [(counts[n][b] + language.SMOOTH) / totals[n] for n in names]
                parts = [([r for r, w in zip(rate, words[:, j]) if w > 0], [r for r, w in zip(rate, words[:, j]) if w < 0]) for j in range(words.shape[1])]
                weight[b] = [math.log(sum(x) / len(x) / (sum(y) / len(y))) if x and y else 0.0 for x, y in parts]
            sums = [s + w for s, w in zip(sums, weight[b])]
        loss = [sum(math.exp(-4 * w * s / len(got)) for w, s in zip(word, sums)) / len(sums) for word in words]
        near = [1 / x**2 for x in loss]
        best = loss.index(min(loss))
        out.append((k, fold(k) == 0, names[best], near[best] / sum(near)))
    return out


def test_op9_equals_brute_force(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").unionByName(odd_docs, allowMissingColumns=True)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.identify(docs).collect()), key=str)
    want = sorted(brute_language([(r.doc_id, r.text, r.lang) for r in docs.collect()]), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-4)


def test_letters_and_label_values(spark, monkeypatch):
    assert [language.has_letter(t) for t in ("²½Ⅷ", "_1 ٣", "٣a", "日", "", "ª")] == [False, False, True, True, False, True]
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, "abc " * (i + 1), lang) for i, lang in enumerate(["a", "b", "a", "c", "b", "a"] * 5)]
    names, table = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["a", "b"] and table.shape[0] == language.BUCKETS


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(changed).collect()))


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"en"}
    assert language.identify(no_docs).collect() == []
    unlabelled = odd_docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 6, 40])
def test_codewords_differ_and_correct_errors(classes):
    words = language.codewords(classes)
    apart = min(int((words[i] != words[j]).sum()) for i in range(classes) for j in range(i))
    assert apart >= {2: 1, 3: 2, 4: 4, 5: 8}.get(classes, 5)
    for c in range(classes):
        margins = words[c].copy()
        margins[: (apart - 1) // 2] *= -1
        assert language.decode(margins, words)[0] == c


def test_ambiguity_is_flagged():
    words = language.codewords(4)
    assert language.decode(np.zeros(words.shape[1]), words)[2]
    assert not language.decode(words[1], words)[2]
