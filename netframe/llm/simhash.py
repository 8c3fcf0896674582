"""Operator 7: SimHash near-duplicates through pigeonhole blocks.

Fingerprints of 64 bits are split into blocks.  Two that differ in at most D bits (2) leave
at least two of D + 2 blocks alike, so every close pair shares the values of some pair of
blocks (32 of 64 bits): candidates are joined on those keys and verified by Hamming distance.

Equal fingerprints are folded into one row first, so copies never meet as pairs.  A key with
more than FULL fingerprints is not joined with itself: there each fingerprint is listed
under itself and its one-bit (in general floor(D/2)-bit) neighbours.  Two fingerprints that
list a common value differ in at most 2 * floor(D/2) bits, and for even D every close pair does
list one; such a group holds at most 65 rows whatever the corpus.  Both ways are exact, emit
rows in proportion to the fingerprints, and are picked by the size of a key alone.

Cases: a null or empty text has the fingerprint 0, linked like any other; a text shorter than a
shingle is one shingle; a very long text is fingerprinted whole, its bits added up a stretch at a time; rows with a
null doc_id have a fingerprint and take part, but never name a component; repeated rows are alike; extra columns are
not read, and pass through keep_one, whatever their names; an empty table has an empty result.  The result has one
row for each input row.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, let_go, materialize, tidy, trim
from .graph_components import components

SEED = 42
FULL = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        part = h[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) of every row; the long holds the 64 bits."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _block(fp, i: int, blocks: int):
    lo, hi = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo


def close_links(distinct: DataFrame, max_bits: int = 2, full: int = FULL) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) at most max_bits apart.

    Not every pair is listed; the components are those of all pairs.
    """
    if max_bits not in (0, 2):
        raise ValueError("max_bits is 0 or 2")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    blocks = max_bits + 2
    keys = []
    for k, (i, j) in enumerate(combinations(range(blocks), 2)):
        (x, _), (y, w) = _block(F.col("fp"), i, blocks), _block(F.col("fp"), j, blocks)
        keys.append(F.lit(k << 40).bitwiseOR(F.shiftleft(x, w).bitwiseOR(y)))
    # the planner takes exploded rows for as few as there were before, and would broadcast them
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.hint("merge").join(sizes, "key")
    few = members.where(F.col("n") <= full)
    near = (
        few.select("key", F.col("fp").alias("a"))
        .hint("merge")
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    many = members.where(F.col("n") > full).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    stars = (
        many.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("spot"))
        .groupBy("spot")
        .agg(F.collect_set("fp").alias("group"))  # 65 at most: spot and its one-bit neighbours
        .where(F.size("group") > 1)
        .select(F.array_min("group").alias("a"), F.explode("group").alias("b"))
        .where("a <> b")
    )
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marks = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = materialize(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    links = materialize(close_links(least.select("fp"), max_bits), "links")
    comp = components(links)
    named = least.join(comp.withColumnRenamed("node", "fp"), "fp")
    lowest = named.groupBy("root").agg(F.min("least").alias("low"))
    moved = named.join(lowest, "root").select("fp", "low")
    naming = materialize(least.join(moved, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id")), "naming")
    discard(least, links)
    return marks.join(naming, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each SimHash group: the one with the smallest doc_id.

    Rows with a null doc_id stay.  Repeated rows of one doc_id stay together.
    """
    gone = near_duplicates(docs, shingle, max_bits, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(free_name(docs, "nf_gone"))).distinct()
    return docs.join(gone, docs[id_col] == gone[gone.columns[0]], "left_anti")


# Near copies by similarity of word shingles: SimHash thins out, the shingles decide.

#: Keys of a row beyond those that exactness needs; rows with more crowded keys than that are ordered anew.
SPARE = 36

_EDGE = b".,;:!?\"'()[]"


def word_fingerprint(text: bytes, seed: int = SEED) -> int:
    """Majority bits over the distinct words, A-Z lowered and without edge punctuation.

    A changed word spoils five 5-word shingles but one word, so texts whose shingles are similar to
    0.8 lie few bits apart here (nine in ten within 5 bits, or more where texts share common words).
    """
    words = {w.strip(_EDGE) for w in text.lower().split()}
    if not words:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(words), bitorder="little").view(np.uint64)[0])


def shingle_similarity(a: bytes, b: bytes, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; a shorter text is one shingle, two empty ones are alike."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """Ascending hashes of the distinct word shingles, as many as shingle_similarity compares."""
    w = text.lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1], np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).view(np.int64))


def _least(n, similarity: float):
    """Shingles of n that any similar text has too, at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def block_links(distinct: DataFrame, max_bits: int, blocks: int, verify: int, full: int = FULL) -> DataFrame:
    """Edges (a, b) among distinct fingerprints at most `verify` bits apart.

    Of `blocks` blocks two that differ in at most max_bits bits share blocks - max_bits at least; the values of
    that many blocks are a key, and those that share a key are verified: all pairs of a key with up to `full` members, in
    a larger one each member against the first.  So not every pair is found.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - max_bits))

    def keys(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                fp = part.column(0).to_numpy().view(np.uint64)
                values = [(fp >> np.uint64(x)) & np.uint64((1 << (y - x)) - 1) for x, y in zip(edges, edges[1:])]
                out = np.empty((len(fp), len(chosen)), np.uint64)
                for n, some in enumerate(chosen):
                    key = np.full(len(fp), n, np.uint64)
                    for i in some:
                        key = key << np.uint64(edges[i + 1] - edges[i]) | values[i]
                    out[:, n] = key
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(chosen)).view(np.int64)), pa.array(out.ravel().view(np.int64))], names=["fp", "key"])

    keyed = distinct.select("fp").mapInArrow(keys, "fp long, key long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1")
    members = materialize(keyed.hint("merge").join(sizes, "key"), "members")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= verify
    few = members.where(F.col("n") <= full)
    near = few.select("key", F.col("fp").alias("a")).hint("merge").join(few.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & close).select("a", "b")
    star = members.where(F.col("n") > full).select(F.col("fp").alias("a"), F.col("first").alias("b")).where("a <> b").where(close)
    links = materialize(near.unionByName(star).distinct(), "links")
    discard(members)
    return links


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 3, blocks: int = 5, verify: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, full: int = FULL) -> DataFrame:
    """(id, like): the rows that are similar to a row with a smaller id, each with one such row.

    SimHash thins the groups out: blocks of word_fingerprint link rows, and each row is compared with the
    first of its Hamming group.  That keeps the next steps small and decides nothing else.  They compare
    every row that is left with all smaller ids that can be similar, whatever the fingerprints say.

    Two texts with similarity s share s of the shingles of each, at least.  So in any common order of
    shingles the first n - ceil(s n) + 1 of the two have one in common, and SPARE more of each have SPARE
    more in common.  Keys are those first shingles in the order of their hashes; pairs of keys with up to
    `full` rows are made.  A pair with none but crowded keys has over SPARE of them in each row: such rows
    are ordered once more, by how many of them have a shingle, rare ones first.  There rows in crowded keys
    are compared with the first of a key before pairs are made, which thins copies of one text out.
    Pairs that share too few keys to reach the similarity are not looked up.

    Texts without words are similar to each other and to nothing else.  Of similar rows the one with the smallest
    id stays; rows with a null id are left alone; rows that share an id go only if each of them is similar.
    Every intermediate table is deleted as soon as nothing reads it any more.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    def marks(batches):
        let_go()
        for batch in batches:
            fp = np.fromiter((word_fingerprint(t.as_py() or b"", seed) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])
        trim()

    def decide(batches):
        for batch in batches:
            a, b = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            s = [shingle_similarity(x or b"", y or b"", words) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["id", "like", "s"])
        trim()

    def keys(batches):
        """For each row (row, id, text) one row of what it is, and one (row, h) for each key."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                grams = [shingle_hashes(t.as_py() or b"", words) for t in part.column(2).cast(pa.binary())]
                n = np.fromiter(map(len, grams), np.int64, len(grams))
                take = np.minimum(n, n - _least(n, similarity) + 1 + SPARE)
                # a row's last key; shingles beyond it are in no key
                top = np.array([g[k - 1] if k < len(g) else (1 << 63) - 1 for g, k in zip(grams, take)], np.int64)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), none, part.column(1), pa.array(n), pa.array(n - take), pa.array(top)], names=["row", "h", "id", "n", "rest", "top"])
                h = np.concatenate([g[:k] for g, k in zip(grams, take)]) if len(grams) else np.empty(0, np.int64)
                rows = part.column(0).take(pa.array(np.repeat(np.arange(len(grams)), take)))
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([rows, pa.array(h), pa.nulls(len(h), part.schema.field(1).type), none, none, none], names=["row", "h", "id", "n", "rest", "top"])
        trim()

    def all_grams(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                grams = [shingle_hashes(t.as_py() or b"", words) for t in part.column(1).cast(pa.binary())]
                rows = part.column(0).take(pa.array(np.repeat(np.arange(len(grams)), list(map(len, grams)))))
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64))], names=["row", "h"])
        trim()

    def dropped(pairs: DataFrame) -> DataFrame:
        """Of the pairs those that are similar; of rows with one id all must be."""
        pairs = materialize(pairs, "pairs")
        texts = pairs.join(base, "id").select("id", "like", F.col("text").alias("own"))
        both = texts.join(base.select(F.col("id").alias("like"), F.col("text").alias("other")), "like").select("id", "like", "own", "other")
        s = both.mapInArrow(decide, f"id {kind}, like {kind}, s double").groupBy("id", "like").agg(F.min("s").alias("s"))
        out = materialize(s.where(F.col("s") >= similarity).groupBy("id").agg(F.min("like").alias("like")), "drop")
        discard(pairs)
        tidy(spark)
        return out

    def candidates(members: DataFrame, gone: DataFrame, ordered: bool) -> DataFrame:
        """Pairs of a row not in gone and one with a smaller id that share keys enough; of members (row, h, id, n, rest, top, hot)."""
        fields = ("row", "id", "n", "rest", "top", "hot")
        a = members.select("h", *(F.col(c).alias(f"a_{c}") for c in fields))
        b = members.join(gone.select("id"), "id", "left_anti").select("h", *(F.col(c).alias(f"b_{c}") for c in fields))
        near = (F.col("a_id") < F.col("b_id")) & (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9)
        both = b.hint("merge").join(a, "h").where(near)
        both = both.groupBy(*(f"{x}_{c}" for x in "ab" for c in fields)).agg(F.count(F.lit(1)).alias("c"))
        beyond = F.when(F.col("a_top") < F.col("b_top"), F.col("a_rest")).otherwise(F.col("b_rest")) if ordered else F.greatest("a_rest", "b_rest")
        most = F.col("c") + F.least("a_hot", "b_hot") + beyond
        return both.where(most >= similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-6).select(F.col("b_id").alias("id"), F.col("a_id").alias("like")).distinct()

    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    active = materialize(base.mapInArrow(marks, f"id {kind}, fp long").groupBy("id").agg(F.min("fp").alias("fp")), "words")
    least = materialize(active.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    links = block_links(least.select("fp"), max_bits, blocks, verify, full)
    named = least.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("least").alias("like"), F.sum("n").alias("n")).where("n > 1").drop("n")
    gone = dropped(active.join(named.select("fp", "root"), "fp").join(low, "root").where("id <> like").select("id", "like"))
    discard(active, least, links)

    # rows that share id and text share a key; what there is of them besides counts once
    placed = base.select(F.xxhash64("id", "text").alias("row"), "id", "text")
    keyed = materialize(placed.mapInArrow(keys, f"row long, h long, id {kind}, n long, rest long, top long"), "keys")
    info = materialize(keyed.where("h is null").select("row", "id", "n", "rest", "top").dropDuplicates(["row"]), "rows")
    tokens = keyed.where("h is not null").select("row", "h")
    sizes = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(tokens.hint("merge").join(sizes, "h"), "shared")
    discard(keyed)
    tidy(spark)
    crowded = materialize(shared.where(F.col("m") > full).groupBy("row").agg(F.count(F.lit(1)).alias("hot")), "crowded")
    few = shared.where(F.col("m") <= full).drop("m").join(info, "row").join(crowded, "row", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    gone = gone.unionByName(dropped(candidates(few, gone, True)))
    discard(shared)

    # the shorter of a similar pair has s of the other's shingles at least, and has SPARE of them to spare or all but one of what it must share
    spare = F.least(F.lit(SPARE), F.ceil(similarity * F.ceil(similarity * F.col("n") - 1e-9) - 1e-9) - 1)
    full_rows = crowded.join(info, "row").where(F.col("hot") > spare).select("row")
    grams = materialize(placed.join(full_rows, "row", "left_semi").select("row", "text").mapInArrow(all_grams, "row long, h long"), "grams")
    often = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("df", "h"))
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    kept = grams.hint("merge").join(often, "h").withColumn("place", place).join(info.select("row", "id", "n"), "row")
    kept = kept.where((F.col("place") <= first) & (F.col("df") > 1)).select("row", "h", "id", "n", (F.col("n") - first).alias("rest"), F.lit(0).alias("top"), F.lit(0).alias("hot"))
    kept = materialize(kept, "rare")
    discard(grams, crowded, info)
    sizes = kept.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("like")).where("m > 1")
    members = materialize(kept.hint("merge").join(sizes, "h"), "members")
    discard(kept)
    to_first = members.where((F.col("m") > full) & (F.col("id") != F.col("like"))).join(gone.select("id"), "id", "left_anti").groupBy("id", "like").agg(F.count(F.lit(1)).alias("c"))
    gone = gone.unionByName(dropped(to_first.groupBy("id").agg(F.max_by("like", "c").alias("like"))))
    gone = gone.unionByName(dropped(candidates(members.drop("m", "like"), gone, False)))
    discard(members)
    return gone


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_copies names."""
    name = free_name(docs, "nf_gone")
    gone = materialize(near_copies(docs, words, similarity, id_col=id_col, text_col=text_col).select(F.col("id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
