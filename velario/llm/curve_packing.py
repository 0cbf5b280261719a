"""Packing documents into fixed-length sequences along a Hilbert curve.

A document's token ids are hashed into a vector, projected to a few dimensions and
placed on a Hilbert curve, so that documents of like wording get keys near each
other. Spark range-sorts by key, and each task lays its documents end to end and
cuts every ``length`` ids: neighbours on the curve share sequences and nothing is
padded. What is left at the end of a task becomes sequences whose lengths are
powers of two.

Copies have one key; the range sort goes on to ``doc_id``, so that a group of
copies is shared by many tasks.

Cases: a null or empty text is the end id alone; rows without ``doc_id`` and
repeated rows are documents of their own; an empty table gives no row; other
columns are not read.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from velario.llm.shared import ready, rows_of, saved, small, texts
from velario.llm.word_encoder import encoder, with_ids

LENGTH = 2048
SLOTS = 1024
DIMENSIONS = 4
BITS = 10                    # of each dimension in the key


@lru_cache(maxsize=1)
def _projection():
    return np.random.default_rng(20).standard_normal((SLOTS, DIMENSIONS)).astype(np.float32)


def places(ids: list) -> np.ndarray:
    """The points of some documents, given their ids: each coordinate in [0, 2**BITS)."""
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    hashed = (np.concatenate(ids).astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(22)
    counts = np.bincount(row * SLOTS + hashed, minlength=len(ids) * SLOTS).reshape(-1, SLOTS)
    vectors = np.log1p(counts.astype(np.float32))
    # one row after another: a point must not depend on the batch its document came in
    points = np.stack([v @ _projection() for v in vectors]) / (np.sqrt(np.square(vectors).sum(1, keepdims=True)) + 1e-9)
    return np.minimum((1 << BITS) / (1 + np.exp(-1.7 * points)), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits=BITS) -> np.ndarray:
    """Hilbert keys of points with non-negative integer coordinates (Skilling, 2004)."""
    x = np.array(points, np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:                              # undo the rotations, from the largest cells down
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):                       # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):           # interleave
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _encoded(docs, tokenizer, end_id) -> DataFrame:
    """``(doc_id, place, ids)`` with the end id in place."""
    def run(batches):
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch, found in with_ids(batches, "text", coder):
            ids = [piece + end for piece in found]
            keys = hilbert(places([np.frombuffer(i, coder.dtype) for i in ids]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(ids, pa.binary())],
                                             names=["doc_id", "place", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, place bigint, ids binary")


class Packer:
    """Lays documents end to end; gives out sequences as they fill."""

    def __init__(self, length, first_id):
        self.length, self.next_id, self.open, self.size = length, first_id, [], 0

    def add(self, document, n):
        """Pieces ``(document, start, length, sequence, offset)`` of filled sequences."""
        start, out = 0, []
        while start < n:
            take = min(n - start, self.length - self.size)
            self.open.append((document, start, take))
            self.size += take
            start += take
            if self.size == self.length:
                out += self._close(self.open)
                self.open, self.size = [], 0
        return out

    def finish(self):
        """The rest, in sequences whose lengths are powers of two."""
        out, rest = [], self.size
        pieces = self.open[::-1]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            own = []
            while room:
                document, start, n = pieces.pop()
                if n > room:
                    pieces.append((document, start + room, n - room))
                    n = room
                own.append((document, start, n))
                room -= n
            out += self._close(own)
        self.open, self.size = [], 0
        return out

    def _close(self, pieces):
        at, out = 0, []
        for document, start, n in pieces:
            out.append((document, start, n, self.next_id, at))
            at += n
        self.next_id += 1
        return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length=LENGTH, tokenizer="word_bpe_49k.json", end_id=1, with_ids=False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` of each piece."""
    ready(docs.sparkSession)
    names = _NAMES + ["ids"] * with_ids
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def run(batches):
        dtype = encoder(tokenizer).dtype
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def rows(pieces):
            out = {n: [] for n in names}
            for (doc_id, ids), start, n, sequence, offset in pieces:
                own = ids[start:start + n].astype("<u4").tobytes()
                for name, value in zip(names, (doc_id, start, n, zlib.crc32(own), len(ids), sequence, offset, own)):
                    out[name].append(value)
            return rows_of(out, schema)

        for batch in small(batches):
            pieces = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                pieces += packer.add((doc_id, ids), len(ids))
            yield rows(pieces)
        yield rows(packer.finish())

    encoded = saved(_encoded(docs, tokenizer, end_id), "encoded")
    return (encoded.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
            .mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)))
