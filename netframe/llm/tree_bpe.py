"""Operator 6: BPE encoding and decoding by tree concatenation.

A text of more than LEAF characters is cut into leaves wherever the count falls; the leaves
of one text are encoded as separate rows, so halves of a long text are worked on in parallel.
Neighbours are then joined in a tree.  At each join a window of tokens around it is encoded
anew and grown until both sides agree with it; what lies outside stays.

Agreement on a side means one of two things, each of which makes the joined ids exact:
* the window and the side start a pre-token at the same place, far enough from an edge that
  nothing beyond it can change that start (the splitting rule looks ahead only); or
* the side's whole part in the window lies in one pre-token that goes on beyond the window,
  and the AGREE outermost tokens are equal.  (A token sequence is a BPE encoding if each
  neighbouring pair is.)
A window that has grown over both sides is the encoding itself.

Shorter texts are encoded at once.  Decoding concatenates the tokens' bytes and reads UTF-8.

Cases: a null text is an empty one and has no tokens; rows are kept one for one, repeated and
null ids included; an empty table has an empty result; extra columns are not read.  The leaves of one text
meet in one task, and those of repeated rows of one long text with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Decoder, encoder
from .common import row_ranges, trim

LEAF = 1 << 15
AGREE = 4
#: Characters next to an edge in which a pre-token's start is not relied upon.
MARGIN = 24


class Piece:
    """A stretch of text with its tokens: ids, character starts, and which tokens begin a pre-token."""

    __slots__ = ("text", "ids", "starts", "heads")

    def __init__(self, text, ids, starts, heads):
        self.text, self.ids, self.starts, self.heads = text, ids, starts, heads

    @classmethod
    def of(cls, tokenizer, text: str, special: set[int] = frozenset()) -> Piece:
        e = tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        starts = np.array([s for s, _ in e.offsets], np.int64)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        heads = np.ones(len(ids), bool)
        heads[1:] = words[1:] != words[:-1]
        if special:
            own = np.isin(ids, list(special))
            heads[own] = True
            heads[1:][own[:-1]] = True
        return cls(text, ids, starts, heads)

    def clean(self, k: int) -> bool:
        """Token k begins at a character boundary of its own."""
        return k == 0 or k == len(self.ids) or self.starts[k] > self.starts[k - 1]


def join(left: Piece, right: Piece, encode) -> Piece:
    """The tokens of left.text + right.text; encode(text) gives a Piece."""
    if not len(left.ids) or not len(right.ids):
        return encode(left.text + right.text) if left.text and right.text else (left if left.text else right)
    k, n, m, border = 16, len(left.ids), len(right.ids), len(left.text)
    while True:
        a, b = max(0, n - k), min(m, k)
        while not left.clean(a):
            a -= 1
        while not right.clean(b):
            b += 1
        first = int(left.starts[a])
        last = int(right.starts[b]) if b < m else len(right.text)
        window = encode(left.text[first:] + right.text[:last])
        if a == 0 and b == m:
            return window
        at = window.starts + first  # places in the joined text
        low = _left(left, window, a, at, border)
        high = _right(right, window, b, at, border, last)
        if low and high and low[1] <= high[1]:
            (i, x), (j, y) = low, high
            return Piece(
                left.text + right.text,
                np.concatenate([left.ids[:i], window.ids[x:y], right.ids[j:]]),
                np.concatenate([left.starts[:i], at[x:y], right.starts[j:] + border]),
                np.concatenate([left.heads[:i], _first(window.heads[x:y], i < n and bool(left.heads[i])), right.heads[j:]]),
            )
        k *= 2


def _first(heads: np.ndarray, first: bool) -> np.ndarray:
    heads = heads.copy()
    if len(heads):
        heads[0] = first
    return heads


def _left(left: Piece, window: Piece, a: int, at: np.ndarray, border: int):
    """(tokens of left that stay, token of the window to go on from), or None."""
    if a == 0:
        return 0, 0
    mine = a + np.flatnonzero(left.heads[a:])
    mine = mine[left.starts[mine] <= border - MARGIN]
    mine = mine[left.starts[mine] > left.starts[a]]
    theirs = np.flatnonzero(window.heads)
    common, i, x = np.intersect1d(left.starts[mine], at[theirs], return_indices=True)
    if len(common):
        return int(mine[i[0]]), int(theirs[x[0]])
    inside = int(np.searchsorted(at, border, side="right"))
    if not left.heads[a:].any() and not window.heads[1:inside].any() and np.array_equal(left.ids[a : a + AGREE], window.ids[:AGREE]) and len(left.ids) - a >= AGREE:
        return a, 0
    return None


def _right(right: Piece, window: Piece, b: int, at: np.ndarray, border: int, last: int):
    """(first token of right that stays, tokens of the window up to there), or None."""
    if b == len(right.ids):
        return b, len(window.ids)
    mine = np.flatnonzero(right.heads[:b])
    mine = mine[(right.starts[mine] > 0) & (right.starts[mine] <= last - MARGIN)]
    theirs = np.flatnonzero(window.heads)
    common, j, y = np.intersect1d(right.starts[mine] + border, at[theirs], return_indices=True)
    if len(common):
        return int(mine[j[-1]]), int(theirs[y[-1]])
    inside = int(np.searchsorted(at, border, side="left"))
    if not right.heads[1 : b + 1].any() and not window.heads[inside:].any() and b >= AGREE and np.array_equal(right.ids[b - AGREE : b], window.ids[-AGREE:]):
        return b, len(window.ids)
    return None


def join_tree(pieces: list[Piece], encode) -> Piece:
    """Join neighbours, then neighbours of what came out, until one piece is left."""
    while len(pieces) > 1:
        pieces = [join(pieces[k], pieces[k + 1], encode) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def _special(tokenizer) -> set[int]:
    return set(tokenizer.get_added_tokens_decoder())


def _answer(batch_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, decoder: Decoder, name: str) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
    return pa.RecordBatch.from_arrays([batch_ids, lists, pa.array(decoder.decode(ids, ends), pa.string())], names=[name, "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, decoded string"
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("nf_text"))

    def tools():
        e = encoder(path)
        if not hasattr(e, "decoder"):
            e.decoder, e.special = Decoder(e.tokenizer), _special(e.tokenizer)
        return e, e.decoder

    def short(batches):
        e, decoder = tools()
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for lo, hi in row_ranges(sizes, 1 << 23):
                ids, ends, _ = e.encode(batch.column(1).slice(lo, hi - lo))
                yield _answer(batch.column(0).slice(lo, hi - lo), ids, ends, decoder, id_col)
        trim()

    def leaves(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = xxhash.xxh3_64_intdigest(text.encode()) >> 1
                for k in range(0, len(text), leaf):
                    yield pa.RecordBatch.from_arrays([pa.array([i], batch.schema.field(0).type), pa.array([mark], pa.int64()), pa.array([k // leaf], pa.int32()), pa.array([text[k : k + leaf]], pa.string())], names=[id_col, "mark", "leaf", "part"])

    def encoded(batches):
        e, _ = tools()
        for batch in batches:
            for k in range(batch.num_rows):
                p = Piece.of(e.tokenizer, batch.column(3)[k].as_py(), e.special)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(4)), *(pa.array([x.tobytes()], pa.binary()) for x in (p.ids, p.starts, p.heads))], names=[*batch.schema.names, "ids", "starts", "heads"])

    def joined(table: pa.Table) -> pa.Table:
        e, decoder = tools()
        table = table.sort_by("leaf")
        rows: dict[int, Piece] = {}
        times = 0
        for leaf_no, part, ids, starts, heads in zip(*(table.column(c).to_pylist() for c in ("leaf", "part", "ids", "starts", "heads"))):
            times += leaf_no == 0
            rows[leaf_no] = Piece(part, np.frombuffer(ids, np.uint32), np.frombuffer(starts, np.int64), np.frombuffer(heads, bool))
        whole = join_tree([rows[k] for k in sorted(rows)], lambda t: Piece.of(e.tokenizer, t, e.special))
        one = _answer(table.column(0).combine_chunks().slice(0, 1), whole.ids, np.array([len(whole.ids)]), decoder, id_col)
        return pa.Table.from_batches([one] * times)  # repeated rows share their leaves

    is_long = F.length("nf_text") > leaf
    parts = base.where(is_long).mapInArrow(leaves, f"`{id_col}` {kind}, mark long, leaf int, part string").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col, "mark", "leaf")  # a number given is not made smaller
    pieces = parts.mapInArrow(encoded, f"`{id_col}` {kind}, mark long, leaf int, part string, ids binary, starts binary, heads binary")
    long = pieces.groupBy(id_col, "mark").applyInArrow(joined, schema)
    return base.where(~is_long).mapInArrow(short, schema).unionByName(long)
