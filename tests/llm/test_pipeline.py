import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_simhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from netframe.llm import toxicity
from netframe.llm.common import materialize

HERE = Path(__file__).parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] >= seen[3] == seen[4] > 0
    left = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"file://{tmp_path}/substring_dedup").selectExpr("doc_id", "length(text) as n").collect()}
    packed = docs.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == seen[-1] and whole.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def repeats(rows, window=13):
    """Texts without the words under windows that start in an earlier document too; None where nothing goes."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = t.encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w = t.encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else None
    return out


def test_every_stage_does_what_brute_force_does(spark):
    SF = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3").select((docs.doc_id + 5000).alias("doc_id"), F.lit(None).cast("string").alias("text"), *(c for c in docs.columns if c not in ("doc_id", "text"))).select(docs.columns))
    docs = materialize(docs, "in")
    stages = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = materialize(stages["toxicity"](spark, docs, SF), "toxicity")
    score = lambda t: 1 / (1 + np.exp(-model.bias - model.weights[toxicity.text_features((t or "").encode())].sum()))
    assert {i for i, _ in rows_of(out)} == {i for i, t in rows_of(docs) if score(t) < 0.5}
    assert len(rows_of(out)) < len(rows_of(docs))

    docs, out = out, materialize(stages["exact_dedup"](spark, out, SF), "exact")
    by = {}
    for i, t in rows_of(docs):
        by.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    assert {i for i, _ in rows_of(out)} == {min(g)[1] for g in by.values()}

    docs, out = out, materialize(stages["simhash_near_dedup"](spark, out, SF), "near")
    assert {i for i, _ in rows_of(docs)} - {i for i, _ in rows_of(out)} == brute(rows_of(docs))

    docs, out = out, materialize(stages["substring_dedup"](spark, out, SF), "repeats")
    want, given = repeats([(i, t or "") for i, t in rows_of(docs)]), dict(rows_of(docs))
    assert dict(rows_of(out)) == {i: given[i] if t is None else t for i, t in want.items()} and any(want.values())

    library, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in stages["best_fit_packing"](spark, out, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in rows_of(out):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert sorted(got.pop(i)) == [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in sorted(_pieces(ids))]
    assert not got


def _pieces(ids, limit=1024):
    first = len(ids) % limit or limit
    cuts = [0, *range(first, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
    return [(a, b - a, None) for a, b in zip(cuts, cuts[1:])]


def test_stages_of_odd_tables(spark, docs, empty):
    """Nulls, repeated rows and ids, long texts and clashing names go through every stage."""
    for df in (docs.withColumns({c: F.lit(1) for c in ("score", "digest", "locator", "fp", "like", "n_words", "nf_gone")}), empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            df = materialize(out, name)
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count()


def test_entry_works_without_the_corpus_modules(tmp_path):
    import shutil

    shutil.copytree(HERE / "netframe", tmp_path / "netframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_pagerank_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}})
