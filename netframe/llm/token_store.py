"""Operator 4: token ids in binary files with Elias-Fano document boundaries.

A store is a folder of shards; each holds a range of doc_ids in ascending order (nulls first),
and the shards' names ascend likewise:

    ids       n_tokens little-endian unsigned integers of 2 or 4 bytes (as the vocabulary needs)
    bounds    Elias-Fano list of n_docs + 1 numbers: where each document starts, and the end
    doc ids   Elias-Fano list of doc_id - least for the documents with one
    footer    JSON: counts, width, places of the lists
    tail      8-byte length of the footer, 8-byte mark "NFTOKEN1"

A manifest (Parquet, one row for each shard) gives each shard the ids before it.  A boundary
costs 2 + log2(mean length) bits; select finds one, or a run of them, from the nearest sample without
a table of 64-bit offsets, and is what all readers use.

Writing: documents are dealt by ranges of doc_id and sorted; each task streams its shard under
another name and renames it when whole, so a repeated task does no harm.  Files are opened
through pyarrow's file systems, on whatever storage spark.checkpoint.dir names.  Shards are about
shard_bytes of text, and larger where there would be more than MOST_SHARDS: the ranges come from a
sample on the driver that grows with their number.

Cases: ids are whole numbers; a null text is an empty one and has the end id alone; documents with one
doc_id, repeated rows too, stand next to each other, in the order of a hash of their texts, and may be
dealt to several shards; null ids stand first and are dealt likewise; a very long text is encoded in one
task; an empty table makes a store without shards; extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import row_ranges, text_bytes, trim

MARK = b"NFTOKEN1"
SAMPLE = 256
SHARD_BYTES = 32 << 20
MOST_SHARDS = 20_000
#: Places of the set bits of each byte.
_ONES = np.array([[k for k in range(8) if b >> k & 1] + [0] * (8 - b.bit_count()) for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing list of numbers below `universe`, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        places = (values >> bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u4" if not n or places[-1] < 1 << 32 else "<u8"))

    def dump(self) -> bytes:
        head = struct.pack("<QBBQQQ", self.n, self.bits, self.samples.itemsize, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, bits, size, low, high, samples = struct.unpack_from("<QBBQQQ", data)
        at = struct.calcsize("<QBBQQQ")
        return cls(n, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, f"<u{size}", samples, at + low + high))

    def _low(self, i: int) -> int:
        first, last = i * self.bits, (i + 1) * self.bits
        word = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return (word >> first % 8) & ((1 << self.bits) - 1)

    def select(self, i: int) -> int:
        """Number i: from the nearest sample the set bits are counted on, a byte at a time."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        byte = int(self.high[at]) & (0xFF << place % 8) & 0xFF
        while (ones := byte.bit_count()) <= need:
            need -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(need):
            byte &= byte - 1
        place = 8 * at + (byte & -byte).bit_length() - 1
        return ((place - i) << self.bits) | self._low(i)

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """Numbers lo to hi - 1: bytes between the nearest samples are counted, the bits of each looked up."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.int64)
        place, after = int(self.samples[lo // SAMPLE]), -(-hi // SAMPLE)
        first, last = place // 8, int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        data = self.high[first:last].copy()
        data[0] &= (0xFF << place % 8) & 0xFF
        upto = np.cumsum(np.bitwise_count(data), dtype=np.int64)
        nth = np.arange(lo, hi) - lo // SAMPLE * SAMPLE
        at = np.searchsorted(upto, nth, side="right")
        before = np.where(at > 0, upto[at - 1], 0)
        values = (8 * (first + at) + _ONES[data[at], nth - before] - np.arange(lo, hi)) << self.bits
        if self.bits:
            start = lo * self.bits // 8
            low = np.unpackbits(self.low[start : -(-hi * self.bits // 8)], bitorder="little")[lo * self.bits - 8 * start :][: (hi - lo) * self.bits]
            values |= low.reshape(hi - lo, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return values

    def count_upto(self, lo: int, limit: int) -> int:
        """The largest k > lo whose number is at most limit, but lo + 1 at least; by select and halving."""
        k, end = lo + 1, self.n - 1
        while k < end:
            mid = (k + end + 1) // 2
            if self.select(mid) <= limit:
                k = mid
            else:
                end = mid - 1
        return k


def _write_shard(uri: str, parts) -> dict:
    """parts: (doc_ids list, ids, ends) in order.  Returns the footer."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.part"
    counts, doc_ids, nulls, width = [], [], 0, None
    with store.open_output_stream(other) as out:
        for ids_of, ids, ends, width in parts:
            nulls += sum(i is None for i in ids_of)
            doc_ids.append(np.array([i for i in ids_of if i is not None], np.int64))
            counts.append(np.diff(ends, prepend=0))
            out.write(ids.astype(f"<u{width}").tobytes())
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        own = np.concatenate(doc_ids) if doc_ids else np.zeros(0, np.int64)
        least = int(own[0]) if len(own) else 0
        bounds, names = EliasFano.of(np.concatenate([[0], np.cumsum(counts)])).dump(), EliasFano.of(own - least).dump()
        foot = {"n_docs": len(counts), "n_tokens": int(counts.sum()), "nulls": nulls, "least": least, "width": width or 4, "bounds": len(bounds), "doc_ids": len(names)}
        text = json.dumps(foot).encode()
        out.write(bounds + names + text + struct.pack("<Q", len(text)) + MARK)
    store.move(other, path)
    return foot


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"{uri} is no token shard")
        (n,) = struct.unpack("<Q", tail[:8])
        self.foot = json.loads(self.file.read_at(n, size - 16 - n))
        at = self.foot["n_tokens"] * self.foot["width"]
        self.bounds = EliasFano.load(self.file.read_at(self.foot["bounds"], at))
        self.names = EliasFano.load(self.file.read_at(self.foot["doc_ids"], at + self.foot["bounds"]))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        w = self.foot["width"]
        return np.frombuffer(self.file.read_at((hi - lo) * w, lo * w), f"<u{w}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of document k of this shard, found by select."""
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))

    def documents(self, most: int):
        """(doc_ids, bounds in this shard) of runs of documents with about `most` ids together; bounds by select."""
        lo, n, nulls = 0, self.foot["n_docs"], self.foot["nulls"]
        while lo < n:
            hi = self.bounds.count_upto(lo, self.bounds.select(lo) + most)
            own = self.names.select_range(max(0, lo - nulls), max(0, hi - nulls)) + self.foot["least"]
            yield [None] * (max(nulls, lo) - lo if hi > nulls else hi - lo) + own.tolist(), self.bounds.select_range(lo, hi + 1)
            lo = hi

    def close(self) -> None:
        self.file.close()


def write_store(docs: DataFrame, uri: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode docs and write a store at uri; path is a tokenizers file."""
    shards = min(MOST_SHARDS, max(1, -(-text_bytes(docs, text_col) // shard_bytes)))

    def run(batches):
        shard = TaskContext.get().partitionId()
        name = f"{uri}/shard-{shard:08d}.tok"
        e = encoder(path)
        width = 2 if max(e.vocab_size, end_id + 1) <= 1 << 16 else 4

        def parts():
            for batch in batches:
                sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for lo, hi in row_ranges(sizes, 1 << 23):
                    ids, ends, _ = e.encode(batch.column(1).slice(lo, hi - lo))
                    out = np.full(len(ids) + len(ends), end_id, np.uint32)
                    out[np.arange(len(ids)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = ids
                    yield batch.column(0).slice(lo, hi - lo).to_pylist(), out, ends + np.arange(1, len(ends) + 1), width

        foot = _write_shard(name, parts())
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([foot["n_docs"]]), pa.array([foot["n_tokens"]])], names=["shard", "file", "n_docs", "n_tokens"])

    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("nf_text"))
    order = F.col(id_col).asc_nulls_first(), F.xxhash64("nf_text")  # rows with one id, or none, may need several shards
    dealt = base.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long").write.parquet(f"{uri}/manifest")


def read_store(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids binary) of every document in the store at uri.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers.
    """
    manifest = spark.read.schema("shard int, file string, n_docs long, n_tokens long").parquet(f"{uri}/manifest").where("n_docs > 0")
    # one row for each shard: a sum over them needs one task, whatever they hold
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for batch in batches:
            for uri_, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri_)
                for names, bounds in shard.documents(1 << 21):
                    ids = shard.ids(int(bounds[0]), int(bounds[-1]))
                    offsets = ((bounds - bounds[0]) * 4).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), data], names=["doc_id", "start", "n_tokens", "ids"])
                shard.close()

    spread = manifest.select("file", before.alias("base")).repartition(manifest.select("file").count() or 1, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
