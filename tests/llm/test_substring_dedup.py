import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from netframe.llm import bpe, substring_dedup
from netframe.llm.substring_dedup import candidates_by_length, drop_repeats, levels, repeated_words


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def check(docs, rows, window, **kw):
    got = [tuple(r) for r in repeated_words(docs, window, **kw).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert Counter(got) == Counter(brute([(i, t) for i, t, *_ in rows], window))


def test_against_brute_force_in_one_and_many_blocks(docs, rows):
    check(docs, rows, 13)
    check(docs, rows, 13, block_bytes=500)


def test_other_windows(docs, rows):
    for window in (2, 3, 5, 8):
        check(docs, rows, window, block_bytes=3000)


def test_repeats_of_few_words(spark):
    rows = [(k, " ".join("ab"[(k * j) % 2] for j in range(40)), "", "") for k in range(6)]
    check(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), rows, 13, block_bytes=100)


def test_empty_table_and_clashing_columns(docs, rows, empty):
    assert repeated_words(empty).count() == 0
    wide = docs.withColumn("n_words", F.lit("mine")).withColumn("block", F.lit(1)).withColumn("nf_block", F.lit(2))
    out = repeated_words(wide)
    assert {"_n_words", "n_removed", "kept_text", "block", "nf_block"} <= set(out.columns) and out.count() == len(rows)
    assert out.select("n_words").distinct().collect()[0][0] == "mine"


def test_texts_without_repeats_stay(docs, rows):
    out = drop_repeats(docs)
    assert out.columns == docs.columns
    first = next(t for i, t, *_ in rows if i == 3)
    got = {r["doc_id"]: r for r in out.where("doc_id in (3, 200, 402)").collect()}
    assert got[3]["text"] == first and got[402]["text"] == " \t\r\n"
    assert got[200]["text"] == "" and got[200]["n_chars"] == 0


def test_fewer_candidates_at_each_length(spark):
    """Four shared words end at the first length, eight at the second; only a shared passage gets to the last."""
    assert levels(13) == [4, 7, 13]
    own = lambda k, n: [f"o{k}x{j}" for j in range(n)]
    four, eight, passage = ([f"{c}{j}" for j in range(n)] for c, n in (("f", 4), ("e", 8), ("p", 20)))
    parts = {k: four if k % 2 else eight for k in range(40)} | {40: passage, 41: passage}
    rows = [(k, " ".join([*own(k, 30), *part, *own(f"{k}b", 30)])) for k, part in parts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (None, 1500):
        n = {r["length"]: r["candidates"] for r in candidates_by_length(docs, block_bytes=block_bytes).collect()}
        windows = sum(len(t.split()) - 12 for _, t in rows)
        assert windows > 2 * n[7] > 2 * n[13] >= 2 * 2 * 8
        # windows that no other text has even a part of are out at once, those with four or eight words in common later
        assert n[7] <= 42 * 16 + 2 * 32 and n[13] <= 20 * 12 + 2 * 32
    got = {r["doc_id"]: r["n_removed"] for r in repeated_words(docs, block_bytes=1500).collect()}
    assert {k: v for k, v in got.items() if v} == {41: 20}


def test_one_id_and_no_id_are_spread(spark):
    rows = [(None if k % 2 else 5, " ".join(f"r{k}x{j}" for j in range(40))) for k in range(60)] + [(9, " ".join(f"r0x{j}" for j in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, [(*r, "", "") for r in rows], 13, block_bytes=1000)


def test_very_long_text(spark):
    rows = [(1, " ".join(f"v{j % 5000}" for j in range(40000))), (2, " ".join(f"v{j}" for j in range(300, 900)))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), [(*r, "", "") for r in rows], 13, block_bytes=1 << 16)


def _block_table(n):
    texts = [" ".join(f"w{(k * 131 + j * j) % 5003}" for j in range(500)) for k in range(n)]
    return pa.table([pa.array(range(n)), pa.array(texts), pa.array([0] * n, pa.int32())], names=["doc_id", "text", "nf_block"])


def test_a_blocks_hashes_take_little_memory():
    steps = substring_dedup._Steps(13, "doc_id", "text", 2, 64)
    block, _ = steps.load(_block_table(800))
    assert block.n > 2 * substring_dedup.STRETCH
    tracemalloc.start()
    try:
        block.short_keys(4, block.whole, 64)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 * block.n


def test_hashes_are_the_same_in_stretches(monkeypatch):
    steps = substring_dedup._Steps(13, "doc_id", "text", 2, 64)
    block, _ = steps.load(_block_table(20))
    some = np.flatnonzero(block.whole)[::3]
    whole = [*block.short_keys(7, block.whole, 64), *block.full_keys(some, 64)]
    monkeypatch.setattr(substring_dedup, "STRETCH", 37)
    for a, b in zip(whole, [*block.short_keys(7, block.whole, 64), *block.full_keys(some, 64)], strict=True):
        assert np.array_equal(a, b)


def test_encoders_an_earlier_stage_has_left_are_let_go():
    bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe._ENCODERS
    substring_dedup._Steps(13, "doc_id", "text", 2, 64).first(4)(_block_table(2))
    assert not bpe._ENCODERS
