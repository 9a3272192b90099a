"""Token-ID files: documents in ascending doc_id order, their ids in the segments of `idcoder`, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm import idcoder
from eventloom.llm.common import stored
from eventloom.llm.tokens import encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Texts that are encoded at once.
TEXTS = 500
FILE = "part int, before long, n_ids long, segment binary"


def written_segments(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The file's rows (part, ids before it in the part, its ids, segment), in the shared folder.

    Documents are range-partitioned and sorted by doc_id (nulls first, repeated ids by text), so parts and the segments
    in them are in ascending order. A null text has the end id only. No part gathers more than a range of documents,
    no segment more than SEGMENT ids and one document.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encode, end = encoder(path, keeps_space=True).encode, END_ID.to_bytes(4, "little")
        ready: list[idcoder.Segment] = []
        ids: list[bytes] = []
        docs_: list[int | None] = []
        held = 0

        def close() -> None:
            nonlocal before, held, ids, docs_
            lengths = np.array([len(x) // 4 for x in ids])
            nulls = sum(d is None for d in docs_)
            ready.append(idcoder.Segment(np.array([d or 0 for d in docs_], np.int64), lengths, before, np.frombuffer(b"".join(ids), "<u4"), nulls))
            before += held
            held, ids, docs_ = 0, [], []

        def rows() -> pa.RecordBatch:
            coded = idcoder.packed_segments(ready)
            columns = [pa.array([part] * len(ready), pa.int32()), pa.array([s.before for s in ready], pa.int64()), pa.array([len(s.ids) for s in ready], pa.int64()), pa.array(coded, pa.binary())]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "before", "n_ids", "segment"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc, found in zip(some.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids.append(found + end)
                    docs_.append(doc)
                    held += len(found) // 4 + 1
                    if held >= idcoder.SEGMENT:
                        close()
                if sum(len(s.ids) for s in ready) >= idcoder.LANES * idcoder.FRAME:
                    yield rows()
        if ids:
            close()
        if ready:
            yield rows()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return stored(ordered.mapInArrow(made, FILE), "token-file")


def read_documents(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the file's segments; broken ones raise ValueError."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, coded = batch.column("part").to_pylist(), batch.column("segment")
            for at in range(0, len(parts), idcoder.LANES * idcoder.FRAME // idcoder.SEGMENT):
                some = coded.slice(at, idcoder.LANES * idcoder.FRAME // idcoder.SEGMENT).to_pylist()
                for part, s in zip(parts[at : at + len(some)], idcoder.unpacked_segments(some), strict=True):
                    starts = np.concatenate([[0], np.cumsum(s.lengths)])
                    data = memoryview(s.ids.tobytes())
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    ids = pa.array(s.doc_ids, pa.int64(), mask=np.arange(len(s.doc_ids)) < s.nulls)
                    columns = [pa.array(np.full(len(sums), part, np.int32)), ids, pa.array(starts[:-1] + s.before, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    # One row per part: at most as many as the file has partitions.
    totals = file.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_offset"))
    rows = file.select("part", "segment").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = rows.join(F.broadcast(offsets), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("at") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")
