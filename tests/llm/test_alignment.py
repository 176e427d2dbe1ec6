"""Matches of fingerprints at all offsets."""

import numpy as np
import pytest

from pagelake.llm import audio


def noisy(p, share, rng):
    """A fingerprint with so large a share of its bits turned over."""
    bits = np.unpackbits(p.astype("<u4").view(np.uint8))
    bits[rng.choice(len(bits), int(len(bits) * share), replace=False)] ^= 1
    return np.packbits(bits).view("<u4")


def found(spark, prints):
    df = spark.createDataFrame([(k, p.astype(np.uint32).view(np.int32).tolist()) for k, p in prints.items()], "id long, prints array<int>")
    return {r.id: r for r in audio.search(df, "id", "id % 1000 = 0").collect()}


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2, 0.24])
def test_recall_at_all_offsets(spark, share):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 32, 68, dtype=np.uint32)
    prints, shifts = {0: base}, {}
    for k, s in enumerate(range(-52, 53), 1):  # 16 frames in common at least
        other = rng.integers(0, 1 << 32, 68, dtype=np.uint32)
        low, size = max(0, s), 68 - abs(s)
        other[low - s : low - s + size] = noisy(base[low : low + size], share, rng)
        prints[k], shifts[k] = other, s
    rows = found(spark, prints)
    assert sum(rows[k].best_id == 0 and rows[k]["shift"] == -s for k, s in shifts.items()) >= 0.9 * len(shifts)
    strangers = {k: rng.integers(0, 1 << 32, 68, dtype=np.uint32) for k in range(100)}
    assert all(r.n_links == 0 for r in found(spark, strangers).values())


def test_short_recordings_that_lie_whole_in_others(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, 68, dtype=np.uint32)
    still = np.repeat(base[:1], 30)
    rows = found(spark, {0: base, 1: base[40:41], 2: base[10:12], 3: np.r_[still, base], 1000: still, 5: np.zeros(0, np.uint32)})
    assert (rows[1].best_id, rows[1]["shift"]) == (0, -40)
    assert rows[2].n_links == 1 and rows[2].best_id == 0
    assert rows[1000].best_id == 3 and rows[1000].bit_errors == 0 and rows[5].n_links == 0


def test_align_equals_plain_counts():
    rng = np.random.default_rng(9)
    p, q = rng.integers(0, 4, (5, 40), dtype=np.uint32), rng.integers(0, 4, (6, 23), dtype=np.uint32)
    for i, j, s, size, errors in zip(*audio.align(p, q), strict=True):
        low = max(0, s)
        assert size == min(40, 23 + s) - low and errors == np.bitwise_count(p[i, low : low + size] ^ q[j, low - s : low - s + size]).sum()
