"""Operator 1: exact substring dedup by level-wise doubling.

A window of W words (13) that also starts in a document with a smaller doc_id is a
repeat, and every word under a repeat goes.  Windows are compared at lengths that double up to
W (4, 7 and 13 words; the halves of the last two overlap by a word), and only what repeats at one
length is extended to the next:

1.  Documents are dealt by doc_id and text into blocks of about block_bytes of text.
2.  Lengths 4 and 7: of the short windows inside each 13-word window that is still a candidate the
    one with the least hash stands for it.  Equal 13-word windows choose equal short windows, so a
    13-word window can only repeat if its short window occurs in two documents.  Each block sends each
    value once; a candidate whose value is nowhere else is out.
3.  Length 13: the candidates left are sent themselves, with the smallest doc_id of the block.
4.  What comes back to a block is one bit for each value it sent.

Each exchange holds a value at most once for each block (pre-aggregated before the
shuffle), so a passage found in a third of all documents costs a bucket one entry a block;
groups of copies never meet in one task.  Short values are 32 bits inside a bucket (a false match
there costs work only).  13-word windows are told apart by two hashes of their words, of 64 bits and
of 32 besides the bucket; the second does not build on the first.  The documents are shuffled once; all
levels reuse that exchange.

A block sends each bucket one row a level.  Blocks grow with the square root of the corpus (8 MB up to a
terabyte, 64 MB at 100) and there are BLOCKS_A_BUCKET times fewer buckets, so that a row still holds about
twenty values at 100 TB.

Cases: a null text has no words; an empty text gives an empty kept text; ids are whole numbers; a null doc_id
has no order, so such a row neither loses words nor makes others lose them; rows with one
doc_id never make each other lose words, and are spread over blocks by their texts; a very long text is
handled whole, in one block; an empty table has an empty result; extra columns pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, text_bytes, trim

WINDOW = 13
#: The shortest windows that are compared have more than half of it.
SHORTEST = 4
BLOCK_BYTES, LARGEST_BLOCK = 8 << 20, 64 << 20
BLOCKS_A_BUCKET, FEWEST_BUCKETS = 16, 64
#: Windows of a block that are hashed together; their arrays are short-lived.
STRETCH = 1 << 17
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_SENT = "bucket int, block int, kind int, keys binary, docs binary"
#: Kinds of rows: values or the answers to them, windows or the answers to them, a block's candidates (sent to itself).
_SHORT, _FULL, _OWN = 0, 1, 2


def levels(window: int) -> list[int]:
    """Lengths at which windows are compared; each is at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _M3
    h = (h ^ (h >> _U(29))) * _M3
    return h ^ (h >> _U(32))


def _join(a: np.ndarray, b: np.ndarray, salt: np.uint64 = _M1) -> np.ndarray:
    """Hash of the window that a's and b's windows make up together."""
    return _mix(a * salt + (b ^ (b >> _U(31))) * _M2)


def _double(h: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of windows of `to` words (length < to <= 2 * length) from those of length words."""
    step = to - length
    return _join(h[:-step], h[step:], _M1 + _U(2 * to))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each width neighbours of x, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


class _Block:
    """Words of one block of documents, in doc_id order, rows without an id last."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten()
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.greater(pc.binary_length(words), 0)
        if not pc.all(full, min_count=0).as_py():  # white space at an end leaves an empty word
            words, self.doc = words.filter(full), self.doc[full.to_numpy(zero_copy_only=False)]
        named = words.dictionary_encode()
        distinct = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), _U, len(distinct))
        self.words, self.hash = words, own[named.indices.to_numpy()] if len(words) else np.empty(0, _U)
        self.ids, self.window, self.n, self.n_docs = ids, window, len(words), len(texts)
        self.counts = np.bincount(self.doc, minlength=len(texts))
        if self.n < window:
            self.whole = np.zeros(0, bool)
            return
        ends = np.cumsum(self.counts)[self.doc[: self.n - window + 1]]
        self.whole = (ends >= np.arange(window, self.n + 1)) & (self.doc[: self.n - window + 1] < len(ids))

    def grams(self, length: int, lo: int, hi: int) -> np.ndarray:
        """Hashes of the windows of that length that start at lo to hi - 1, whether they cross documents or not."""
        h, have = self.hash[lo : hi + length - 1], 1
        while have < length:
            to = min(2 * have, length)
            h, have = _double(h, have, to), to
        return h

    def stretches(self, starts: np.ndarray):
        """(lo, hi, those of the sorted starts from lo to hi - 1, where they stand), of which there are some."""
        for lo in range(0, self.n - self.window + 1, STRETCH):
            hi = min(lo + STRETCH, self.n - self.window + 1)
            a, b = np.searchsorted(starts, (lo, hi))
            if a < b:
                yield lo, hi, starts[a:b], slice(a, b)

    def least(self, length: int, starts: np.ndarray) -> np.ndarray:
        """Of the windows at starts the least hash of a window of that length inside."""
        out, inside = np.empty(len(starts), _U), self.window - length
        for lo, hi, some, at in self.stretches(starts):
            out[at] = _sliding(self.grams(length, lo, hi + inside), inside + 1, np.minimum)[some - lo]
        return out

    def short_keys(self, length: int, candidates: np.ndarray, buckets: int):
        """Unique values as bucket << 32 | low bits; which of them two documents here share; each candidate's value."""
        at = np.flatnonzero(candidates)
        least = self.least(length, at)
        doc = self.doc[at]
        # neighbouring windows mostly have one value
        head = np.ones(len(at), bool)
        head[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        g, ids, runs = least[head], self.ids[doc[head]], np.diff(np.flatnonzero(head), append=len(at))
        del at, least, doc, head
        keys, first, back = np.unique(((g >> _U(32)) * _U(buckets) >> _U(32)) << _U(32) | (g & _U(0xFFFFFFFF)), return_index=True, return_inverse=True)
        last = np.zeros(len(keys), np.int64)
        last[back] = np.arange(len(g))  # the last one written stays
        return keys, ids[first] != ids[last], np.repeat(back, runs)

    def full_keys(self, starts: np.ndarray, buckets: int):
        """(bucket, h1, h2) of the windows at starts: order, group heads, and the sorted arrays."""
        h1, h2 = np.empty(len(starts), _U), np.zeros(len(starts), _U)
        for lo, hi, some, at in self.stretches(starts):
            h1[at] = self.grams(self.window, lo, hi)[some - lo]
            for k in range(self.window):
                h2[at] = _mix((h2[at] + self.hash[some + k]) * _M2 + _M1)
        bucket = ((h2 >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        h2 = h2 & _U(0xFFFFFFFF)
        order = np.lexsort((h2, h1, bucket))  # stable: doc_id stays in order inside a key
        bucket, h1, h2 = bucket[order], h1[order], h2[order]
        head = np.ones(len(order), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (bucket[1:] != bucket[:-1])
        return order, head, bucket, h1, h2

    def kept(self, gone: np.ndarray) -> pa.Array:
        """The documents' words that stay, one space between."""
        stay = np.bincount(self.doc[~gone], minlength=self.n_docs)
        words = self.words.filter(pa.array(~gone)) if gone.any() else self.words
        offsets = np.concatenate([[0], np.cumsum(stay)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")


def _load(table: pa.Table, id_col: str, text_col: str, window: int) -> tuple[_Block, np.ndarray]:
    """The block, and the row numbers of its documents."""
    ids = table.column(id_col).combine_chunks()
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.drop_null().to_numpy().astype(np.int64)
    order = np.argsort(values, kind="stable")
    rows = np.concatenate([np.flatnonzero(valid)[order], np.flatnonzero(~valid)])
    texts = table.column(text_col).combine_chunks().take(pa.array(rows))
    return _Block(values[order], texts.cast(pa.string()), window), rows


def _cuts(buckets_of: np.ndarray):
    """(bucket, lo, hi) of each run in a sorted array."""
    if not len(buckets_of):
        return []
    edge = np.flatnonzero(np.concatenate([[True], buckets_of[1:] != buckets_of[:-1], [True]]))
    return [(int(buckets_of[lo]), int(lo), int(hi)) for lo, hi in zip(edge[:-1], edge[1:])]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of x with equal bytes of the items side by side, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sent(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "block", "kind", "keys", "docs"])


def _bits(table: pa.Table, kind: int, keys_bucket: np.ndarray) -> np.ndarray:
    """The answers of one kind, put in the order in which the keys were sent."""
    out = np.zeros(len(keys_bucket), bool)
    at = {b: (lo, hi) for b, lo, hi in _cuts(keys_bucket)}
    for b, k, bits in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("keys").to_pylist()):
        if k == kind:
            lo, hi = at[b]
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _told(table: pa.Table, n: int) -> np.ndarray:
    """The candidates among n windows that a block has sent itself."""
    for kind, bits in zip(table.column("kind").to_pylist(), table.column("keys").to_pylist()):
        if kind == _OWN:
            return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return np.zeros(n, bool)


def _short_answers(table: pa.Table) -> pa.Table:
    """For each value whether two blocks sent it."""
    rows, parts = [], []
    for b, me, kind, keys in zip(*(table.column(c).to_pylist() for c in ("bucket", "block", "kind", "keys"))):
        if kind == _OWN:
            rows.append((b, me, _OWN, keys, None))
        else:
            parts.append((b, me, np.frombuffer(keys, np.uint32)))
    if parts:
        _, back, times = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True, return_counts=True)
        twice, at = (times > 1)[back], 0
        for b, me, part in parts:
            rows.append((b, me, _SHORT, np.packbits(twice[at : at + len(part)]).tobytes(), None))
            at += len(part)
    return _sent(rows)


def _full_answers(table: pa.Table) -> pa.Table:
    """For each window whether another block has it in a document with a smaller id."""
    rows, parts = [], []
    for b, me, kind, keys, docs in zip(*(table.column(c).to_pylist() for c in ("bucket", "block", "kind", "keys", "docs"))):
        if kind == _OWN:
            rows.append((b, me, _OWN, keys, None))
            continue
        n = len(keys) // 12
        parts.append((b, me, np.frombuffer(keys, _U, n), np.frombuffer(keys, np.uint32, n, 8 * n), _from_planes(docs, np.int64)))
    if parts:
        h1, h2, least = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        order = np.lexsort((h2, h1))
        a, b2 = h1[order], h2[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b2[1:] != b2[:-1])]))
        lowest = np.repeat(np.minimum.reduceat(least[order], head), np.diff(np.append(head, len(order))))
        later = np.empty(len(order), bool)
        later[order] = lowest < least[order]
        at = 0
        for b, me, part, _, _ in parts:
            rows.append((b, me, _FULL, np.packbits(later[at : at + len(part)]).tobytes(), None))
            at += len(part)
    return _sent(rows)


@dataclass(frozen=True)
class _Steps:
    """What the tasks of one call do."""

    window: int
    id_col: str
    text_col: str
    own: int
    buckets: int

    def load(self, table: pa.Table) -> tuple[_Block, np.ndarray]:
        return _load(table, self.id_col, self.text_col, self.window)

    def candidates(self, block: _Block, lengths: list[int], answers: pa.Table | None) -> np.ndarray:
        """The windows left after the comparisons at these lengths, the last of which the answers are to."""
        if not lengths:
            return block.whole
        left = block.whole.copy() if len(lengths) == 1 else _told(answers, len(block.whole))
        keys, here, back = block.short_keys(lengths[-1], left, self.buckets)
        left[left] = (_bits(answers, _SHORT, (keys >> _U(32)).astype(np.int64)) | here)[back]
        return left

    def sent(self, table: pa.Table, answers: pa.Table | None, before: list[int], length: int) -> pa.Table:
        """What a block sends to be compared at that length, after the lengths before it."""
        if not table.num_rows:
            return _sent([])
        block, _ = self.load(table)
        me = table.column(self.own)[0].as_py()
        left = self.candidates(block, before, answers)
        if not left.any():
            return _sent([])
        # what this block knows now travels along, so that the next step need not ask again
        rows = [(me % self.buckets, me, _OWN, np.packbits(left).tobytes(), None)] if before or length == self.window else []
        if length != self.window:
            keys, _, _ = block.short_keys(length, left, self.buckets)
            low = (keys & _U(0xFFFFFFFF)).astype(np.uint32)
            return _sent(rows + [(b, me, _SHORT, low[lo:hi].tobytes(), None) for b, lo, hi in _cuts((keys >> _U(32)).astype(np.int64))])
        starts = np.flatnonzero(left)
        order, head, bucket, h1, h2 = block.full_keys(starts, self.buckets)
        least = block.ids[block.doc[starts[order[head]]]]
        h1, h2 = h1[head], h2[head].astype(np.uint32)
        return _sent(rows + [(b, me, _FULL, h1[lo:hi].tobytes() + h2[lo:hi].tobytes(), _planes(least[lo:hi])) for b, lo, hi in _cuts(bucket[head])])

    def first(self, length: int):
        return lambda table: self.alone(table, None, [], length)

    def next(self, before: list[int], length: int):
        return lambda table, answers: self.alone(table, answers, before, length)

    def alone(self, *of) -> pa.Table:
        """sent, with the worker's memory given back before and after."""
        let_go()
        out = self.sent(*of)
        trim()
        return out

    def gone(self, block: _Block, answers: pa.Table) -> np.ndarray:
        """Which words lie under a repeat."""
        starts = np.flatnonzero(_told(answers, len(block.whole)))
        if not len(starts):
            return np.zeros(block.n, bool)
        order, head, bucket, _, _ = block.full_keys(starts, self.buckets)
        elsewhere = _bits(answers, _FULL, bucket[head])
        group = np.cumsum(head) - 1
        ids = block.ids[block.doc[starts[order]]]
        marked = starts[order][elsewhere[group] | (ids > ids[head][group])]
        edge = np.zeros(block.n + 1, np.int64)
        np.add.at(edge, marked, 1)
        np.add.at(edge, marked + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _exchanges(docs: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int | None) -> tuple[_Steps, DataFrame, str, list[DataFrame], DataFrame]:
    """(steps, docs with their block, the name of that column, what is sent at each length, the last answers)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    total = text_bytes(docs, text_col)
    block_bytes = block_bytes or min(LARGEST_BLOCK, max(BLOCK_BYTES, int((64 * total) ** 0.5)))
    blocks = max(1, -(-total // block_bytes))
    name = free_name(docs, "nf_block")
    dealt = docs.withColumn(name, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int"))
    steps = _Steps(window, id_col, text_col, dealt.columns.index(name), max(min(blocks, FEWEST_BUCKETS), -(-blocks // BLOCKS_A_BUCKET)))
    lengths, out, answers = levels(window), [], None
    for k, length in enumerate(lengths):
        if answers is None:
            sent = dealt.groupBy(name).applyInArrow(steps.first(length), _SENT)
        else:
            sent = dealt.groupBy(name).cogroup(answers.groupBy("block")).applyInArrow(steps.next(lengths[:k], length), _SENT)
        out.append(sent)
        answers = sent.groupBy("bucket").applyInArrow(_full_answers if length == window else _short_answers, _SENT)
    return steps, dealt, name, out, answers


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """docs with n_words long, n_removed long and kept_text string (kept words, one space between).

    These names get underscores in front where docs has such a column.
    """
    names = [free_name(docs, x) for x in ("n_words", "n_removed", "kept_text")]
    steps, dealt, block_col, _, answers = _exchanges(docs, window, id_col, text_col, block_bytes)
    keep = [i for i in range(len(dealt.columns)) if i != steps.own]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        let_go()
        out = table.select(keep)
        added = [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.string())]
        if table.num_rows:
            block, rows = steps.load(table)
            gone, back = steps.gone(block, answers), np.argsort(rows)
            removed = np.bincount(block.doc[gone], minlength=block.n_docs)
            added = [pa.array(block.counts[back].astype(np.int64)), pa.array(removed[back].astype(np.int64)), block.kept(gone).take(pa.array(back))]
        trim()
        return pa.table([*out.columns, *added], names=[*out.column_names, *names])

    return dealt.groupBy(block_col).cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def candidates_by_length(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(length int, candidates long): the windows that are still looked at when a length is compared, but the first."""

    def count(length: int):
        def run(batches):
            for batch in batches:
                n = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for k, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if k == _OWN]
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(n), pa.int32()), pa.array(n, pa.int64())], names=["length", "n"])

        return run

    sent = _exchanges(docs, window, id_col, text_col, block_bytes)[3]
    each = [x.mapInArrow(count(length), "length int, n long") for length, x in zip(levels(window), sent)][1:]
    whole = each[0]
    for more in each[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("length").agg(F.sum("n").alias("candidates"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with repeated words cut out of the text (and chars_col set anew); untouched texts stay as they are."""
    n_words, n_removed, kept = (free_name(docs, x) for x in ("n_words", "n_removed", "kept_text"))
    out = repeated_words(docs, window, id_col, text_col)
    out = out.withColumn(text_col, F.when(F.col(n_removed) > 0, F.col(kept)).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(n_removed) > 0, F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(docs.columns)
