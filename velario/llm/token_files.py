"""Token-id files whose document boundaries are Elias-Fano coded.

``write_tokens`` range-partitions documents by ``doc_id`` and writes one binary
file per shard: all ids of the shard back to back, the end of each document as an
Elias-Fano sequence, and the ids of the documents as another. ``read_tokens``
reads the files back with Spark's ``binaryFile`` source.

A file is a line of ASCII (magic, task, shard, documents, documents without id,
ids, id width), padded to 64 bytes, then the sections, then one byte ``\\n``. An
Elias-Fano section of n values below u takes n * (log2(u / n) + 2) bits and a
32-bit count for each 256 values: no table of 64-bit offsets is kept, and
``EliasFano.select`` finds any offset from one count and at most a few words.

Cases: a null or empty text is a document of the end id alone; documents without
``doc_id`` come first; repeated rows and equal ids are separate documents; an
empty table gives no file and no row; other columns are not read.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velario.llm.shared import ready, rows_of, texts
from velario.llm.word_encoder import encoder, with_ids

MAGIC = b"VTOK1"
HEAD = 64
SHARD_IDS = 1 << 20          # a shard is closed at the first document that reaches this many ids
_SAMPLE = 256                # values between two counts of the select structure


class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, n, low_bits, low, high, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        rest = (values & np.uint64((1 << low_bits) - 1)).astype("<u8")
        bits = np.unpackbits(rest.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits]
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(n, low_bits, low, np.packbits(marks, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: a sampled position, then a scan to the wanted one-bit."""
        place, need = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = place >> 3
        first = np.unpackbits(self.high[byte:byte + 1], bitorder="little")[place & 7:]
        if need < first.sum():
            one = place + int(np.flatnonzero(first)[need])
        else:
            need -= int(first.sum())
            byte += 1
            while True:       # 64 bytes at a time
                window = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
                if need < window.sum():
                    one = byte * 8 + int(np.flatnonzero(window)[need])
                    break
                need -= int(window.sum())
                byte += 64
        start = i * self.low_bits
        piece = int.from_bytes(self.low[start >> 3:(start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (one - i) << self.low_bits | piece >> (start & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """The whole sequence at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        wide = np.zeros((self.n, 64), np.uint8)
        wide[:, :self.low_bits] = bits
        low = np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, data, at):
        """The sequence that starts at a byte, and the byte after it."""
        n, low_bits, low, high, samples = struct.unpack_from("<qqqqq", data, at)
        at += 40
        parts = (np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                 np.frombuffer(data, "<u4", samples, at + low + high))
        return cls(n, low_bits, *parts), at + low + high + 4 * samples


def pack_shard(task, shard, doc_ids, pieces, width) -> bytes:
    """One file's bytes; ``pieces`` are the ids of each document, end id included."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(p) // width for p in pieces], dtype=np.int64)
    head = b"%s %d %d %d %d %d %d" % (MAGIC, task, shard, len(pieces), len(pieces) - len(known), int(ends[-1]), width)
    return b"".join([head.ljust(HEAD - 1) + b"\n", struct.pack("<q", base), EliasFano.build(ends).to_bytes(),
                     EliasFano.build([d - base for d in known]).to_bytes(), *pieces])


class Shard:
    """A file read back: ids and boundaries of its documents."""

    def __init__(self, data):
        magic, self.task, self.shard, self.n_docs, nulls, self.n_ids, width = bytes(data[:HEAD]).split()
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.task, self.shard, self.n_docs, self.n_ids = (int(self.task), int(self.shard), int(self.n_docs),
                                                          int(self.n_ids))
        base, = struct.unpack_from("<q", data, HEAD)
        self.ends, at = EliasFano.from_buffer(data, HEAD + 8)
        known, at = EliasFano.from_buffer(data, at)
        self.doc_ids = [None] * int(nulls) + [base + int(v) for v in known.all()]
        self.ids = np.frombuffer(data, f"<u{int(width)}", self.n_ids, at)

    def bounds(self, i):
        """First and last-plus-one position of a document's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)


def write_tokens(docs: DataFrame, path: str, tokenizer="word_bpe_49k.json", end_id=1, shard_ids=SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write the files in ``doc_id`` order.

    The only shuffle is the range partitioning by ``doc_id``; a task holds one
    batch of texts and one open shard. One text is never cut across files.
    """
    ready(docs.sparkSession)
    schema = pa.schema([("blob", pa.binary())])

    def encode(batches):
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        ids, pieces, size, shard = [], [], 0, 0
        for batch, found in with_ids(batches, "text", coder):
            for doc_id, piece in zip(batch.column("doc_id").to_pylist(), found):
                ids.append(doc_id)
                pieces.append(piece + end)
                size += len(piece) // width + 1
                if size >= shard_ids:
                    yield rows_of({"blob": [pack_shard(task, shard, ids, pieces, width)]}, schema)
                    ids, pieces, size, shard = [], [], 0, shard + 1
        if pieces:
            yield rows_of({"blob": [pack_shard(task, shard, ids, pieces, width)]}, schema)

    # The cast keeps every byte; the text writer puts one row, so one shard, in a file.
    (texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(encode, "blob binary").select(F.col("blob").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(path))


def read_tokens(spark: SparkSession, path: str, with_ids=False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document in the files.

    Starts are the shard's own plus the ids of all shards before: summed first
    over the shards of a task, then over the tasks (one row each).
    """
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    field = F.split(F.substring("content", 1, HEAD).cast("string"), " ")
    heads = files.select(field[1].cast("bigint").alias("task"), field[2].cast("bigint").alias("shard"),
                         field[5].cast("bigint").alias("n_ids"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = heads.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(
        F.sum("n").over(before.orderBy("task")), F.lit(0)).alias("task_start"))
    starts = heads.select("task", "shard", F.coalesce(
        F.sum("n_ids").over(before.partitionBy("task").orderBy("shard")), F.lit(0)).alias("inside")).join(
        tasks, "task").select("task", "shard", (F.col("task_start") + F.col("inside")).alias("shard_start"))

    names = ["task", "shard", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                shard = Shard(data.as_buffer())
                ends = shard.ends.all().astype(np.int64).tolist()
                out = {n: [] for n in names}
                start = 0
                for doc_id, end in zip(shard.doc_ids, ends):
                    own = shard.ids[start:end].astype("<u4").tobytes()
                    row = (shard.task, shard.shard, doc_id, start, end - start, zlib.crc32(own), own)
                    for name, value in zip(names, row):
                        out[name].append(value)
                    start = end
                yield rows_of(out, schema)

    rows = files.mapInArrow(decode, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names))
    return rows.join(starts, ["task", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("local")).alias("start"), *names[4:])
