"""Token-id output: Arrow files of fixed-size-list batches.

The documents' ids, each document closed by an end id, form one stream in
ascending document order.  A range partition of the documents becomes one
Arrow IPC file in which the stream is cut into sequences of equal length with
a mask of the same shape (0 where the last sequence is padded).  Every batch
but a file's last has the same number of sequences, so sequence i lies in
batch i // batch_sequences and is reached by address alone, without copying.

Rows with the same doc_id (or a null one) are documents of their own, in the
order of their texts; a null text is an empty one and gives the end id alone.
An empty table gives no files.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .encoding import encoder

INDEX = "shard int, doc_id long, shard_start long, n_tokens long"


def file_schema(length: int, narrow: bool) -> pa.Schema:
    ids = pa.uint16() if narrow else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Cuts a stream of ids into sequences and writes them; the file takes its name when it is complete."""

    def __init__(self, folder: str, shard: int, length: int, batch_sequences: int, narrow: bool, attempt: int):
        self.fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(top, recursive=True)
        self.final, self.temporary = f"{top}/shard-{shard:06d}.arrow", f"{top}/.shard-{shard:06d}-{attempt}"
        self.length, self.schema = length, file_schema(length, narrow)
        self.kind = np.uint16 if narrow else np.uint32
        self.room = length * batch_sequences * 4
        self.held, self.n = bytearray(), 0
        self.sink = self.fs.open_output_stream(self.temporary)
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def _batch(self, raw: bytes, filled: int) -> None:
        ids = pa.array(np.frombuffer(raw, np.uint32).astype(self.kind))
        mask = np.arange(len(ids)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (ids, pa.array(mask))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: bytes) -> int:
        """Appends ids and returns the place where they start."""
        at = self.n
        self.held += ids
        self.n += len(ids) // 4
        while len(self.held) >= self.room:
            self._batch(bytes(self.held[: self.room]), self.room // 4)
            del self.held[: self.room]
        return at

    def close(self) -> None:
        if self.held:
            filled = len(self.held) // 4
            padded = bytes(self.held) + bytes(4 * (-filled % self.length))
            self._batch(padded, filled)
        self.out.close()
        self.sink.close()
        # A repeated task replaces the file with an equal one; not every store lets a move do that.
        if self.fs.get_file_info(self.final).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random access to a shard without reading the rest of it."""

    def __init__(self, folder: str, shard: int):
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{top}/shard-{shard:06d}.arrow"
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_sequences = len(self.file.get_batch(0)) if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, as a view of the file, and mask of sequence i."""
        batch = self.file.get_batch(i // self.batch_sequences)
        k = (i % self.batch_sequences) * self.length
        ids, mask = (batch.column(c).values.slice(k, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)  # a bit mask has no numpy view

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that together hold the n ids from `start` on."""
        per = self.batch_sequences * self.length
        while n:
            values = self.file.get_batch(start // per).column(0).values.to_numpy()
            view = values[start % per : start % per + n]
            yield view
            start, n = start + len(view), n - len(view)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 1024, batch_sequences: int = 256
) -> DataFrame:
    """Writes the files below `folder` and returns their index, one row per document."""

    def shard(batches):
        enc, end, out = encoder(tokenizer), np.uint32(end_id).tobytes(), None
        narrow = max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16
        context = TaskContext.get()
        for b in batches:
            starts, sizes = [], []
            for text in b.column("text"):
                if out is None:
                    out = ShardWriter(folder, context.partitionId(), length, batch_sequences, narrow, context.taskAttemptId())
                ids = enc.ids(text.as_py()) + end
                starts.append(out.add(ids))
                sizes.append(len(ids) // 4)
            numbers = [pa.array(np.full(len(sizes), context.partitionId(), np.int32)), b.column("doc_id")]
            numbers += [pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(numbers, names=["shard", "doc_id", "shard_start", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shared.shuffle_width(docs.sparkSession), "doc_id")
    return shared.written(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(shard, INDEX))


def placed(index: DataFrame) -> DataFrame:
    """The index with `start`: the ids of all documents before, over all shards."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each file
    return index.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files themselves."""

    def check(batches):
        shard, reader = None, None
        for b in batches:
            sums = []
            for s, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "shard_start", "n_tokens"))):
                if s != shard:
                    shard, reader = s, ShardReader(folder, s)
                crc = 0
                for view in reader.span(at, n):
                    crc = zlib.crc32(view.astype(np.uint32), crc)
                sums.append(crc)
            rows = [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(index).mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
