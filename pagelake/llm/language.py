"""Language identification by error-correcting output codes.

Every language has a codeword; each of its bits is told by a binary classifier over hashed byte
n-grams, and the language whose codeword has the least loss against all bits' margins is chosen, so
a few wrong bits are corrected. Up to five languages get the exhaustive code (every way to part
them in two), more get seeded random words with distinct columns and a checked distance.

A bit's classifier is linear: the log ratio of an n-gram's rate in the languages with the bit set
and in the others, each language weighing the same. Rates come from counts over all training rows,
added up in each task and then by Spark: BUCKETS numbers a language, however large the corpus.

At most LANGUAGES values are learned, the most frequent ones (ties: the smaller value); a label column
with more holds something else than languages.

A text that is null or has no letter (Unicode category L) is "und" with score 0, as are all texts when
nothing was learned. Rows with a null id are predicted, but not learned from. Repeated rows count each
and are predicted alike. Of languages of equal loss the first by name is taken, and the text is flagged
as ambiguous. An empty table gives no rows. Texts of any length are taken whole. Only the id, the text
and the labels are read, so further columns may have any name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.arrow import map_rows

ORDER = 3
BITS = 15
BUCKETS = 1 << BITS
#: Bits of a random code.
LENGTH = 31
SMOOTH = 0.5
#: Loss of the second best over the best, under which a text is ambiguous.
CLEAR = 1.15
#: Label values that are learned at most.
LANGUAGES = 128
#: N-grams whose weights are added up at once.
SLICE = 1 << 16
#: What may be a letter; numbers such as superscripts match too.
_WORD = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(raw: bytes) -> np.ndarray:
    """Bucket of each n-gram: letters in lower case, all else a space."""
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    code = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def codewords(classes: int) -> np.ndarray:
    """A word of -1 and 1 for each class."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rnd = np.random.default_rng(11)
    best, distance = None, -1
    for _ in range(200):
        words = rnd.choice([-1.0, 1.0], (classes, max(LENGTH, 4 * int(np.ceil(np.log2(classes))))))
        words = words[:, np.abs(words.sum(axis=0)) < classes]
        apart = min(int((words[i] != words[i + 1 :]).sum(axis=1).min()) for i in range(classes - 1))
        if apart > distance:
            best, distance = words, apart
    return best


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and a weight for each bucket and bit, from all rows with both columns."""

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    names = sorted(r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    place = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (k := place.get(name)) is not None:
                    sums[k] += np.bincount(grams(t.as_py().encode()), minlength=BUCKETS)
        for k, b in np.argwhere(sums).tolist():
            yield k, b, int(sums[k, b])

    # a row for each language and bucket at most
    counts = map_rows(rows, count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(names), BUCKETS), SMOOTH)
    table[counts["lang"].to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return names, weights(table)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def margins(got: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams for each bit."""
    total = np.zeros(table.shape[1])
    for i in range(0, len(got), SLICE):
        total += table[got[i : i + SLICE]].sum(axis=0, dtype=float)
    return total / len(got)


def weights(table: np.ndarray) -> np.ndarray:
    """A weight for each bucket and bit, from the counts of each language's n-grams."""
    words = codewords(len(table))
    rates = table / table.sum(axis=1, keepdims=True)
    out = np.zeros((BUCKETS, words.shape[1]), np.float32)
    for b in range(words.shape[1]) if len(table) > 1 else ():
        out[:, b] = np.log(rates[words[:, b] > 0].mean(axis=0) / rates[words[:, b] < 0].mean(axis=0))
    return out


def decode(told: np.ndarray, words: np.ndarray) -> tuple[int, float, bool]:
    """Nearest codeword by exponential loss, its share of all words' inverse losses, and if it is ambiguous."""
    loss = np.exp(-4 * words * told).mean(axis=1)
    best = int(loss.argmin())
    near = 1 / loss**2
    rest = np.delete(loss, best)
    return best, float(near[best] / near.sum()), bool(len(rest) and rest.min() < CLEAR * loss[best])


def predict(docs: DataFrame, names: list[str], table: np.ndarray, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept columns, lang_pred, score and ambiguous for every row."""
    model = docs.sparkSession.sparkContext.broadcast(table)
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (id_column, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = codewords(len(names))
        for batch in batches:
            for *row, t in zip(*batch.columns, strict=True):
                row = [x.as_py() for x in row]
                s = t.as_py()
                if not names or s is None or not has_letter(s):
                    yield *row, "und", 0.0, True
                    continue
                best, score, ambiguous = decode(margins(grams(s.encode()), model.value), words)
                yield *row, names[best], score, ambiguous

    return map_rows(docs.select(id_column, *keep, text), run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; rows of one fold in `folds` are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text", F.when(fold != 0, F.col("lang")).alias("lang"))
    names, table = train(rows)
    return predict(rows, names, table, keep=("held_out",))
