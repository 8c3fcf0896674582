"""Operator 9: best-fit packing of token pieces by hierarchical residual packing.

1.  Each document's ids get an end id; only a longer document than LIMIT is cut, into pieces of
    LIMIT ids, of which the first may be shorter.
2.  Each partition packs its pieces by best fit, longest first.  Bins filled to all but
    SLACK ids are done and go out.
3.  The others move up a tree as items of their own: FANIN partitions meet in one task, which
    packs those bins by best fit again, and so on up to one root.

After best fit no two bins of a partition go into one, so at most one of them is half empty
and only as many bins as there are partitions can still be saved.  Going up, a node hands on
its `carry` emptiest bins (CARRY, unless asked otherwise); the rest are done as they are.  So no task gets
more than FANIN * carry bins, at any size of the corpus.  With carry=None every underfull bin goes up, to
one last task that holds all that are left.

Cases: a null or empty text is one piece, the end id; repeated rows are packed each for itself; a very long
text is encoded in one task and cut; the other columns of `pieces` go along, those of documents are not read;
an empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, row_ranges, trim

LIMIT = 1024
SLACK = 16
FANIN = 16
CARRY = 1024


def token_pieces(docs: DataFrame, path: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece int, start long, length long, ids binary): ids are little-endian unsigned 32-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for lo, hi in row_ranges(sizes):
                ids, ends, _ = e.encode(batch.column(1).slice(lo, hi - lo))
                out = np.full(len(ids) + len(ends), end_id, "<u4")
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                out[np.arange(len(ids)) + doc] = ids
                n = np.diff(ends, prepend=0) + 1
                pieces = -(-n // limit)
                owner = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * limit
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * limit)
                length = np.where(piece == 0, head[owner], limit)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data], names=[id_col, "piece", "start", "length", "ids"])
                trim()

    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("nf_text"))
    return base.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, its place in there, how full each bin is)."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, fill = 0, []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = limit, len(fill)
            fill.append(0)
        bins[k], places[k] = b, limit - room
        room -= size
        fill[b] = limit - room
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, places, np.array(fill, np.int64)


def pack(pieces: DataFrame, limit: int = LIMIT, slack: int = SLACK, fanin: int = FANIN, carry: int | None = CARRY) -> DataFrame:
    """pieces (with a column length, 1 to limit) and sequence_id long, offset long.

    pieces must come from files (or another source that a second reading deals alike).
    """
    names = pieces.columns
    length = names.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, fill long, node long, done boolean"

    def settle(table: pa.Table, node: int, level: int, bins, places, fill, last: bool) -> pa.Table:
        done = fill >= limit - slack
        if last:
            done[:] = True
        elif carry is not None and (~done).sum() > carry:
            left = np.flatnonzero(~done)
            done[left[np.argsort(fill[left], kind="stable")[carry:]]] = True
        made = (level << 58) | (node << 30) | bins
        cols = [*(table.column(i) for i in range(len(names))), *(pa.array(x) for x in (made, places, fill[bins], np.full(len(bins), node), done[bins]))]
        return pa.table(cols, names=[*names, "sequence_id", "offset", "fill", "node", "done"])

    def leaf(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        yield from settle(table, TaskContext.get().partitionId(), 0, *best_fit(table.column(length).to_numpy(), limit), last=False).to_batches()

    def node(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            at = {c: table.column(c).to_numpy() for c in ("sequence_id", "offset", "fill", "node")}
            # the order in which rows arrive must not matter
            order = np.lexsort((at["offset"], at["sequence_id"]))
            table = table.take(pa.array(order))
            seq, offset, fill = (at[c][order] for c in ("sequence_id", "offset", "fill"))
            _, first, back = np.unique(seq, return_index=True, return_inverse=True)
            bins, places, full = best_fit(fill[first], limit)
            return settle(table, int(at["node"][0]) // fanin, level, bins[back], places[back] + offset, full, last)

        return run

    parts = pieces.rdd.getNumPartitions()
    state = materialize(pieces.mapInArrow(leaf, schema), "packed")
    out = [state.where("done")]
    level = 1
    while True:
        parts = -(-parts // fanin)
        last = parts <= 1
        up = state.where("not done").withColumn("nf_up", F.floor(F.col("node") / fanin))
        state = up.groupBy("nf_up").applyInArrow(_without(node(level, last), "nf_up"), schema)
        state = materialize(state, "packed")
        out.append(state.where("done"))
        if last:
            break
        level += 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(*names, "sequence_id", "offset")


def _without(f, column: str):
    return lambda table: f(table.drop_columns([column]))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limit: int = LIMIT, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32 long[, ids binary], sequence_id, offset): one row for each piece."""
    pieces = materialize(token_pieces(docs, path, end_id, limit, id_col, text_col), "pieces")
    own = ["ids"] if with_ids else []
    return pack(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *own), limit)
