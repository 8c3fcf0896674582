import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from netframe.llm import exact_dedup
from netframe.llm.common import fresh_dir


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]", "", t or "")


def want(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return by


def check(out, rows):
    by = want(rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["digest_ok"]) for r in out) == Counter((i, min(by[norm(t)])[3], len(by[norm(t)]), True) for i, t, *_ in rows)
    kept = Counter(r["keep_id"] for r in out if r["kept"])
    assert kept == Counter(min(g)[3] for g in by.values())


def test_against_brute_force(docs, rows):
    digests = {hashlib.sha256(norm(t).encode()).hexdigest() for _, t, *_ in rows}
    out = exact_dedup.exact_groups(docs)
    assert {r["digest"] for r in out.collect()} == digests
    check(out.withColumn("digest_ok", F.lit(True)).collect(), rows)


def test_state_lives_on_over_batches(docs, rows):
    check(exact_dedup.exact_groups(docs, files_per_batch=1).withColumn("digest_ok", F.lit(True)).collect(), rows)


def test_collisions_are_told_apart_by_full_bytes(docs, rows):
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    check(exact_dedup.exact_groups(docs, digest=weak).withColumn("digest_ok", F.lit(True)).collect(), rows)


def test_keep_one(docs, rows, empty):
    kept = exact_dedup.keep_one(docs.withColumn("locator", F.lit("mine")))
    assert kept.columns == [*docs.columns, "locator"]
    assert kept.count() == len(want(rows))
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_parquet_of_one_file(spark, docs, rows, tmp_path):
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/d")
    check(exact_dedup.exact_groups(spark.read.parquet(f"file://{tmp_path}/d")).withColumn("digest_ok", F.lit(True)).collect(), rows)


def test_a_second_call_meets_the_state_of_the_first(spark, docs, rows):
    first, second = rows[::2], rows[1::2]
    frame = lambda part: spark.createDataFrame([(i, t) for i, t, *_ in part], "doc_id long, text string")
    for weak in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)):
        state = fresh_dir(spark, "state")
        check(exact_dedup.exact_groups(frame(first), digest=weak, state=state).withColumn("digest_ok", F.lit(True)).collect(), first)
        out = exact_dedup.exact_groups(frame(second), digest=weak, state=state).collect()
        by = want(rows)
        assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in out) == Counter((i, min(by[norm(t)])[3], len(by[norm(t)])) for i, t, *_ in second)
        assert sum(r["group_size"] > 1 for r in out) > 5
        third = exact_dedup.keep_one(frame(first), state=state)
        assert third.columns == ["doc_id", "text"]


def test_keep_one_with_clashing_names(docs, rows):
    wide = docs.withColumns({c: F.lit(c) for c in ("nf_gone", "locator", "digest", "call", "bytes", "first")})
    out = exact_dedup.keep_one(wide)
    assert out.columns == wide.columns and out.count() == len(want(rows))
