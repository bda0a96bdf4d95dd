"""Token ids in Arrow's file format: fixed-size lists, so that any sequence is read at its place without a copy.

A shard holds a range of doc_ids: its documents' ids run on without gaps, each document closed by an end id, and are cut
into rows of ROW ids. `ids` and `mask` (true: an id, false: padding after the shard's last) are fixed-size lists. Beside a shard
lies its index, `doc_id` and `n_tokens` of its documents in order. Shards in order are the corpus in ascending doc_id order.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, parallelism, small_batches, table, texts, to_arrow, workspace
from granary.llm.tokens import encoder, forget

VOCABULARY = "word_bpe_49k.json"
END = 2
ROW = 2048
#: Rows in a record batch.
ROWS = 256


def schema(dtype: np.dtype, row: int = ROW) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), row)), ("mask", pa.list_(pa.bool_(), row))])


class ShardWriter:
    """Writes one shard under a name of its own and renames it when it is whole, so that a task can be run again."""

    def __init__(self, folder: str, shard: int, attempt: int, dtype: np.dtype, row: int = ROW):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.part = f"{root}/shard-{shard:06d}", f"{root}/.shard-{shard:06d}-{attempt}"
        self.dtype, self.row, self.schema = dtype, row, schema(dtype, row)
        self.sink = self.fs.open_output_stream(self.part + ".arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.doc_ids: list = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= ROWS * self.row:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        while len(flat) >= ROWS * self.row or last and len(flat):
            now, flat = flat[: ROWS * self.row], flat[ROWS * self.row :]
            full = -(-len(now) // self.row) * self.row
            ids, mask = np.zeros(full, self.dtype), np.zeros(full, bool)
            ids[: len(now)], mask[: len(now)] = now, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.row) for x in (ids, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting, self.n_waiting = [flat], len(flat)

    def close(self) -> tuple[int, int]:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.lengths, pa.int64())})
        with self.fs.open_output_stream(self.part + ".index") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        for kind in (".index", ".arrow"):
            self.fs.move(self.part + kind, self.final + kind)
        return len(self.doc_ids), sum(self.lengths)


class ShardReader:
    """Random access to a shard. On a local file the arrays are views of the mapped file."""

    def __init__(self, folder: str, shard: int):
        filesystem, root = pafs.FileSystem.from_uri(folder)
        opened = [(pa.memory_map if isinstance(filesystem, pafs.LocalFileSystem) else filesystem.open_input_file)(f"{root}/shard-{shard:06d}{kind}") for kind in (".arrow", ".index")]
        self.file, index = pa.ipc.open_file(opened[0]), pa.ipc.open_file(opened[1]).read_all()
        self.row = self.file.schema.field("ids").type.list_size
        self.doc_ids, self.lengths = index["doc_id"].to_pylist(), index["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self._batch: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row."""
        batch, at = self.file.get_batch(row // ROWS), row % ROWS
        ids, mask = batch.column(0)[at].values, batch.column(1)[at].values
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def _flat(self, batch: int) -> np.ndarray:
        if self._batch[0] != batch:
            self._batch = batch, self.file.get_batch(batch).column(0).flatten().to_numpy()
        return self._batch[1]

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document, end id included."""
        begin, end, size = int(self.starts[k]), int(self.starts[k + 1]), ROWS * self.row
        pieces = [self._flat(b)[max(begin - b * size, 0) : end - b * size] for b in range(begin // size, -(-end // size))]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, row: int = ROW) -> list[tuple[int, int, int]]:
    """Encodes every text (null: empty) and writes the shards. Returns (shard, documents, ids) of each, in order: as many entries as there are shards.

    Rows with a null doc_id come first; rows that share a doc_id follow one another, shorter text first, then by text. An empty table
    writes no shard.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs)
    ordered = rows.repartitionByRange(parallelism(rows), "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    out = to_arrow(docs.sparkSession, "shard int, n_docs long, n_ids long")

    def run(batches):
        from pyspark import TaskContext

        context, writer, tokens = TaskContext.get(), None, encoder(vocabulary)
        for b in batches:
            ids = tokens.encode(b.column(1).to_pylist())
            writer = writer or ShardWriter(folder, context.partitionId(), context.taskAttemptId(), tokens.dtype, row)
            for doc_id, x in zip(b.column(0).to_pylist(), ids, strict=True):
                writer.add(doc_id, np.append(x, tokens.dtype.type(end)))
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((context.partitionId(), *writer.close()), out, strict=True)], schema=out)

    return sorted(tuple(r) for r in ordered.mapInArrow(lean(run, lambda: forget(vocabulary)), "shard int, n_docs long, n_ids long").collect())


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and place (shard, row, column) of every document, from the files."""
    bases = accumulate((n for _, _, n in shards), initial=0)
    todo = spark.createDataFrame([(s, b) for (s, _, _), b in zip(shards, bases, strict=False)], "shard int, base long")
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, row long, col int"
    out = to_arrow(spark, ddl)

    def run(batches):
        for b in batches:
            for shard, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader = ShardReader(folder, shard)
                n = len(reader.doc_ids)
                for k in range(0, n, 4096):
                    part = range(k, min(n, k + 4096))
                    starts, lengths = reader.starts[part.start : part.stop], reader.lengths[part.start : part.stop]
                    crc = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in part]
                    columns = (reader.doc_ids[part.start : part.stop], starts + base, lengths, crc, np.full(len(part), shard), starts // reader.row, starts % reader.row)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return todo.repartition(max(1, len(shards))).mapInArrow(run, ddl)


def op5_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "arrow-ids")
    return read_shards(spark, folder, write_shards(table(spark, sf_dir, "documents"), folder))
