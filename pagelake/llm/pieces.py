"""SentencePiece encoding and decoding (BPE models) by vectorised merge rounds.

Nulls: a null text encodes as an empty one and decodes to an empty string. An empty text has no
ids. Repeated rows give repeated results; a null id is kept; an empty table gives no rows. Of pairs of
equal rank in a word the leftmost merges first, as in the library. Texts and words of any length are
taken whole. Only the id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagelake.llm.arrow import map_rows, only
from pagelake.llm.bpe import encoder


@functools.lru_cache(maxsize=2)
def _surfaces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Bytes of all pieces in one array, their starts and lengths, and the library's model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    first = m.piece_to_id("<0x00>")
    texts = [
        bytes([i - first]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace("▁", " ").encode()
        for i in range(m.get_piece_size())
    ]
    lens = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens, lens, m


def decode_flat(path: str, ids: list[np.ndarray]) -> list[str]:
    """What the library's decode gives for each array of ids."""
    octets, start, size, model = _surfaces(path)
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
    lens = size[flat]
    ends = np.cumsum(lens)
    out = octets[np.repeat(start[flat] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    got, at = [], 0
    upto = np.r_[0, ends]
    for a in ids:
        raw = out[upto[at] : upto[at + len(a)]]
        at += len(a)
        try:
            if len(a) and (a == model.unk_id()).any():
                raise ValueError
            text = raw.decode()
            got.append(text[1:] if text[:1] == " " else text)
        except ValueError:  # ids that no valid text has
            got.append(model.decode(a.tolist()))
    return got


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", *, decoded: bool = False) -> DataFrame:
    """(id, ids) for each row; with decoded=True also the text that the ids decode to."""
    fields = [docs.schema[id_column], StructField("ids", ArrayType(IntegerType(), False), False)]
    schema = StructType([*fields, StructField("decoded", StringType(), False)] if decoded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _blocks(batches):
            ids = list(encoder(model_path).encode(part.column(1).to_pylist()))
            back = decode_flat(model_path, ids) if decoded else None
            for k, key in enumerate(part.column(0).to_pylist()):
                yield (key, ids[k].astype(np.int32), back[k]) if decoded else (key, ids[k].astype(np.int32))

    return map_rows(only(docs, id_column, text_column, text=text_column), run, schema)


def decode(rows: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) from ids; null ids decode to an empty text."""
    schema = StructType([rows.schema[id_column], StructField("text", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _blocks(batches):
            ids = [np.array(x or [], np.uint32) for x in part.column(1).to_pylist()]
            yield from zip(part.column(0).to_pylist(), decode_flat(model_path, ids), strict=True)

    return map_rows(only(rows, id_column, ids_column), run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    got = encode(docs, model_path, decoded=True)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
