"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within DISTANCE = 3 bits differ by at most one bit in one of two 32-bit segments.
Each distinct fingerprint is indexed under the 32 one-wildcard variants of both segments; an
equality shuffle on the variant brings candidates together, and their whole distance verifies
them. A variant fixes 31 bits, so its run holds one in 2 ** 31 of the distinct fingerprints and the near
ones; copies of a text, however many, are one fingerprint. A run of equal variants yields a spanning forest of its links, not its pairs: a link
between two fingerprints of one run is a path of verified links in it.

A text without words (null, empty, white space only) has fingerprint zero and links like any
other. Repeated rows share a fingerprint. A null doc_id is kept, and its component is the
smallest doc_id reached, if there is one; of ties the smallest id names the component. An empty
table gives no rows. Texts of any length are taken whole. Only the id and the text are read, or the
row is carried in one struct, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagelake.llm.arrow import map_rows, only
from pagelake.llm.components import components
from pagelake.session import small, staged

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows to drop (8 bytes each) that are broadcast at most.
FEW = 400_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if over half the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(lens) - 1
    start = end - lens + 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = [np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)]
    return int.from_bytes(np.packbits(np.concatenate(ones) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    schema = StructType([docs.schema[id_column], StructField("fp", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                yield key.as_py(), _signed(fingerprint(text.as_py(), shingle))

    return map_rows(only(docs, id_column, text_column), run, schema)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links within the distance that connect all that such links connect; one fewer than nodes at most."""
    left, links = fps.copy(), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                front += list(found)
                left = left[~near]
    return links


def _runs(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    # an equal segment is met under all its variants: the first alone needs to look at it
    wildcard, half = (keys >> 32) & 31, keys >> 37
    bit = (fps >> (half * 32 + wildcard).astype(np.uint64)) & np.uint64(1)
    mixed = np.minimum.reduceat(bit, starts) != np.maximum.reduceat(bit, starts)
    todo = (sizes > 1) & (mixed | (wildcard[starts] == 0))
    two = starts[todo & (sizes == 2)]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
    yield from zip(fps[two[near]].tolist(), fps[two[near] + 1].tolist(), strict=True)
    for s, n in zip(starts[todo & (sizes > 2)].tolist(), sizes[todo & (sizes > 2)].tolist(), strict=True):
        yield from forest(fps[s : s + n], distance)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): verified links among distinct fingerprints (column fp); they connect all that is linked."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments leave at most one differing bit in one only up to distance 3")

    # a variant: the segment's place, the wildcard bit, and the segment with that bit cleared
    variants = fps.selectExpr(
        "fp",
        "explode(transform(sequence(0, 63), i -> shiftleft(cast(i as bigint), 32) | "
        "((shiftrightunsigned(fp, (i div 32) * 32) & 4294967295L) & ~shiftleft(1L, i % 32)))) as variant",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # of a run that goes on over batches the parts are joined once, when it ends
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or held[0][0][0] != keys[-1]):
                held.append((keys[:cut], values[:cut]))
                yield from _runs(*(np.concatenate(x) for x in zip(*held, strict=True)), distance)
                held = []
            elif cut:
                yield from _runs(keys[:cut], values[:cut], distance)
            held.append((keys[cut:], values[cut:]))
        if held:
            yield from _runs(*(np.concatenate(x) for x in zip(*held, strict=True)), distance)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for a, b in run(batches):
            yield _signed(int(a)), _signed(int(b))

    dealt = variants.select("variant", "fp").repartition("variant").sortWithinPartitions("variant")
    return map_rows(dealt, signed, "a long, b long")


def _roots(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root) of distinct fingerprints: equal roots are linked."""
    roots = components(links(nodes.select("fp"), distance))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = staged(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min(id_column).alias("least")), "nodes")
    of = staged(_roots(nodes, distance), "roots")
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs, as it is, for each group of linked texts: the one of smallest id (null last).

    Rows are told apart by a hash of id and text, so two texts of one id are judged each by its own
    group. Of equal rows one stays (of rows that differ in other columns alone, the smallest)."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.withColumn("h", F.xxhash64(F.col(f"row.`{id_column}`").cast("string"), F.lit("\x1f"), F.col(f"row.`{text_column}`")))
    told = fingerprints(row.select(F.struct(F.col(f"row.`{id_column}`").alias("id"), "h").alias("key"), F.col(f"row.`{text_column}`").alias("text")), "key", "text", shingle)
    told = staged(told.groupBy("key", "fp").agg(F.count("*").alias("n")), "fingerprints")
    order = F.struct(F.col("key.id").isNull().alias("none"), F.col("key.id").alias("id"), F.col("key.h").alias("h"), "n")
    nodes = staged(told.groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    first = staged(_roots(nodes, distance).groupBy("root").agg(F.min("least").alias("least")).select("least.h", "least.n"), "representatives")
    # far fewer rows go than stay, and those that go are named by 8 bytes each
    losers = told.select("key.h").distinct().join(first.select("h"), "h", "left_anti")
    gone = staged(losers.unionByName(first.where("n > 1").select("h")), "gone")
    once = row.join(small(gone, FEW), "h", "left_anti").select("row")
    many = first.where("n > 1").select("h")
    if many.limit(1).count() == 0:  # the texts aren't even looked through for them
        return once.select("row.*")
    again = row.join(small(many, FEW), "h", "left_semi").groupBy("h", F.col(f"row.`{id_column}`").alias("id")).agg(F.min("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
