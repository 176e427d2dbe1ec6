"""Chroma audio fingerprints and their alignment.

A recording becomes frames of 12 pitch-class energies. Filters over an integral image of the frames
(rectangles of time by pitch, compared by the log ratio of their sums) are quantised to two bits of
Gray code each; FILTERS of them are packed in one 32-bit integer a frame. The bits that two recordings
share are counted at all their offsets (by correlation, exact after rounding), and they match at one
whose share of differing bits over the frames in common is small enough. Of such offsets they align at
the one with most equal bits beyond half.

Under WIDTH frames in common, or where a recording stands still, few differing bits are chance: there
an offset also needs VOTES equal integers that differ from the one before. A recording that lies whole
in the other needs no change, and under WIDTH frames VOTES equal integers or all it has.

Recordings of equal fingerprints are one class, searched once, so a group of copies of any size
costs one search. Stated queries alone ask; queries and classes meet in blocks, each with each.

A null, empty or undecodable recording, and one shorter than a filter, has an empty fingerprint and
no links. Repeated rows belong to one class; a null id is kept. Of equally good offsets the smallest
shift counts, of equally good partners the smallest id. An empty table gives no rows; long recordings
are taken whole. Only the id and the recording are read, so further columns may have any name.
"""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pagelake.llm.arrow import map_rows
from pagelake.session import staged

RATE = 5512
FRAME, HOP = 2048, 512
LOWEST, OCTAVES = 110.0, 5
WIDTH = 16
FILTERS = 16
#: Log ratios between which two bits tell.
STEPS = (-0.25, 0.0, 0.25)
#: Equal integers that two recordings need at an offset that chance may reach, and their share of differing bits at most.
VOTES = 3
ERRORS = 0.25
#: Classes of a block.
BLOCK = 64


def read_wave(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mean of channels) and rate of 16-bit PCM; nothing for what is no such file."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), RATE
            data = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
            return data[: len(data) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), RATE


def write_wave(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def melody(values: np.ndarray | None, seconds: float = 0.125) -> tuple[np.ndarray, int]:
    """A vector sounded as one note a number, for tables without recordings: higher is higher."""
    v = np.nan_to_num(np.asarray(values if values is not None else [], float))
    notes = np.clip(np.rint(v * 30), -18, 18)
    n = int(RATE * seconds)
    phase = np.cumsum(np.repeat(2 * np.pi * 330 * 2 ** (notes / 12) / RATE, n))
    return 8000 * (np.sin(phase) + 0.3 * np.sin(2 * phase)), RATE


@functools.lru_cache(maxsize=8)
def _classes(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, bins within range, and their pitch classes as a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    inside = np.flatnonzero((hertz >= LOWEST) & (hertz < LOWEST * 2**OCTAVES))
    pitch = np.rint(12 * np.log2(hertz[inside] / LOWEST)).astype(int) % 12
    return np.hanning(FRAME), inside, np.eye(12)[pitch]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by 12 energies, each frame of length one (silence: zeros)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    window, inside, to_class = _classes(rate)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * window, axis=1)[:, inside]) ** 2 @ to_class
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, size, out=np.zeros_like(energy), where=size > 1e-9)


@functools.cache
def bank() -> list[tuple[int, int, int, int]]:
    """(kind, pitch, height, width): all kinds in turn, over pitches and sizes that grow with the turn."""
    return [(i % 5, (5 * i) % 12, 3 + i % 4, WIDTH // (1 + i % 2)) for i in range(FILTERS)]


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """An integer for each start of a filter."""
    frames = chroma(samples, rate)
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), axis=0), axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in bank():
        whole, m, q = area(0, w, p, p + h), w // 2, p + h // 2
        if kind == 0:  # against all other pitches
            a, b = whole * (12 - h) / h, area(0, w, 0, 12) - whole
        elif kind == 1:  # lower and upper pitches
            a = area(0, w, p, q) * (h - h // 2) / max(h // 2, 1)
            b = area(0, w, q, p + h)
        elif kind == 2:  # earlier and later
            a, b = area(0, m, p, p + h), area(m, w, p, p + h)
        elif kind == 3:  # both, crossed
            a, b = area(0, m, p, q) + area(m, w, q, p + h), area(m, w, p, q) + area(0, m, q, p + h)
        else:  # middle and ends
            third = w // 4
            a, b = area(third, w - third, p, p + h), area(0, third, p, p + h) + area(w - third, w, p, p + h)
        level = np.digitize(np.log((a + 0.1) / (np.maximum(b, 0) + 0.1)), STEPS).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(media: DataFrame, id_column: str, column: str, load: Callable = read_wave) -> DataFrame:
    """(id, prints): load turns the column's value into samples and their rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                yield key.as_py(), fingerprint(*load(value.as_py())).view(np.int32)

    schema = StructType([media.schema[id_column], StructField("prints", ArrayType(IntegerType(), False), False)])
    return map_rows(media.select(id_column, column), run, schema)


def _moved(p: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(p), 1), bool), p[:, 1:] != p[:, :-1]])


#: Frames up to which single precision counts bits exactly: sums stay under 2 ** 14, and their error under a tenth.
SINGLE = 512


def _spectra(p: np.ndarray, width: int, single: bool) -> np.ndarray:
    """Of each bit as 1 or -1 over time: frequency by recording by bit."""
    signs = ((p[:, :, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.float32 if single else float) * 2 - 1
    return np.ascontiguousarray(np.fft.rfft(signs, width, axis=1).transpose(1, 0, 2))


class Spectra:
    """Spectra of the blocks that a task met last, by the block's name and the width."""

    def __init__(self, most: int = 64):
        self.most, self.known = most, {}

    def of(self, name: object, p: np.ndarray, width: int, single: bool) -> np.ndarray:
        key = (name, width, single)
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = _spectra(p, width, single)
        return self.known[key]


def align(p: np.ndarray, q: np.ndarray, spectra: Spectra | None = None, names: tuple[object, object] = (0, 1)) -> tuple[np.ndarray, ...]:
    """Of recordings of one length (rows of p) and of another (rows of q): row in p, row in q, shift, size, errors of each pair that matches.

    spectra: keeps those of blocks by names, for the blocks that are met next."""
    m, n = p.shape[1], q.shape[1]
    width, single, keep = m + n, min(m, n) <= SINGLE, spectra or Spectra()
    product = keep.of(names[0], p, width, single) @ keep.of(names[1], q, width, single).conj().transpose(0, 2, 1)
    sums = np.fft.irfft(product, width, axis=0)
    # place r holds shift r, or from m on r - width; at m itself the recordings have no frame in common
    shifts = np.where(np.arange(width) < m, np.arange(width), np.arange(width) - width)
    lows = np.maximum(0, shifts)
    sizes = np.minimum(m, n + shifts) - lows
    # equal bits less differing ones, an even number: at most so large a share differs
    least = np.where(sizes > 0, 32 * sizes * (1 - 2 * ERRORS) - 1, np.inf).astype(sums.dtype)
    k, i, j = np.nonzero(sums > least[:, None, None])
    errors = np.rint(16 * sizes[k] - sums[k, i, j].astype(float) / 2).astype(int)
    ok = errors <= ERRORS * 32 * sizes[k]
    k, i, j, errors = k[ok], i[ok], j[ok], errors[ok]
    shift, low, size = shifts[k], lows[k], sizes[k]
    mp, mq, whole = _moved(p), _moved(q), size == min(m, n)
    cp, cq = (np.hstack([np.zeros((len(x), 1), int), np.cumsum(x, axis=1)]) for x in (mp, mq))
    changes = np.minimum(cp[i, low + size] - cp[i, low], cq[j, low - shift + size] - cq[j, low - shift])
    sure = (size >= WIDTH) & (whole | (changes >= VOTES))
    votes, equal = np.zeros(len(k), int), np.zeros(len(k), int)
    at, t = np.flatnonzero(~sure), 0
    while len(at):
        a, b = low[at] + t, low[at] - shift[at] + t
        same = p[i[at], a] == q[j[at], b]
        equal[at] += same
        votes[at] += same & mp[i[at], a] & mq[j[at], b]
        t += 1
        at = at[size[at] > t]
    ok = np.flatnonzero(sure | (votes >= VOTES) | (whole & (equal >= np.minimum(VOTES, size))))
    pair = i[ok] * len(q) + j[ok]
    order = ok[np.lexsort((shift[ok], np.abs(shift[ok]), errors[ok] - 16 * size[ok], pair))]
    first = order[np.unique(i[order] * len(q) + j[order], return_index=True)[1]]
    return i[first], j[first], shift[first], size[first], errors[first]


def _block(ids: pa.Array, prints: pa.Array) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and fingerprints as a matrix, for each length."""
    flat, ends, names = prints.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.cumsum(prints.value_lengths().to_numpy()), ids.to_pylist()
    lengths = np.diff(np.r_[0, ends])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield [names[r] for r in rows], flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    spectra = Spectra()
    for batch in batches:
        for row in range(len(batch)):
            left, right = (list(_block(x.field("class_id"), x.field("p"))) for x in (batch.column(0)[row].values, batch.column(1)[row].values))
            for ids_a, p in left:
                for ids_b, q in right:
                    step = max(1, (1 << 16) // (p.shape[1] + q.shape[1]))  # spectra and sums stay small
                    for x in range(0, len(p), step):
                        for y in range(0, len(q), step):
                            for i, j, *told in zip(*(c.tolist() for c in align(p[x : x + step], q[y : y + step], spectra, (("p", ids_a[x], len(p) - x), ("q", ids_b[y], len(q) - y)))), strict=True):
                                yield ids_a[x + i], ids_b[y + j], *told


def search(prints: DataFrame, id_column: str, query: str) -> DataFrame:
    """One row a recording: id, class_id, n_frames, n_links, best_id, shift, bit_errors, frames.

    query: SQL over the id for the recordings that search all others. Links are between classes, of
    which one has a query at least; n_links counts a class's, best_id is the linked class with the
    smallest share of bit errors (ties: smaller id). shift: frames by which the best starts later.
    """
    rows = staged(prints.select(F.col(id_column).alias("id"), "prints", F.expr(query).alias("asks"), F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256).alias("h")), "prints")
    own = rows.groupBy("h").agg(F.min("id").alias("class_id"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"), F.min_by("prints", "id").alias("p"))
    classes = staged(own.select("class_id", "asks", F.coalesce("p", F.expr("cast(array() as array<int>)")).alias("p"), "h"), "classes")
    counts = classes.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    full = classes.where("class_id is not null and size(p) > 0")

    def blocks(of: DataFrame, n: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-n // BLOCK))))
        return of.groupBy(block.alias("k")).agg(F.collect_list(F.struct("class_id", "p")).alias(name)).select(name)

    asked, all_ = blocks(full.where("asks"), counts["asks"], "left"), blocks(full, counts["n"], "right")
    kind = StructType([StructField("a", classes.schema["class_id"].dataType), StructField("b", classes.schema["class_id"].dataType), *(StructField(c, LongType()) for c in ("shift", "size", "errors"))])
    met = map_rows(all_.repartition(48).crossJoin(F.broadcast(asked)).select("left", "right"), _aligned, kind)
    asks = classes.select(F.col("class_id").alias("b"), F.col("asks").alias("b_asks"))
    links = staged(met.where("a <> b").join(asks, "b").where("not (b_asks and b < a)").select("a", "b", "shift", "size", "errors"), "links")
    each = links.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "shift", "size", "errors").unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("other"), (-F.col("shift")).alias("shift"), "size", "errors"))
    first = F.min(F.struct((F.col("errors") / F.col("size")).alias("share"), "other", "shift", "errors", "size"))
    summed = each.groupBy("class_id").agg(F.count("*").alias("n_links"), first.alias("f"))
    named = classes.select("h", "class_id", F.size("p").alias("n_frames")).join(summed, "class_id", "left")
    out = rows.select("id", "h").join(named, "h")
    return out.select(
        F.col("id").alias(id_column), "class_id", F.col("n_frames").cast("long"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("f.other").alias("best_id"), F.col("f.shift").cast("long").alias("shift"), F.col("f.errors").cast("long").alias("bit_errors"), F.col("f.size").cast("long").alias("frames"),
    )
