import re
from collections import Counter

from pyspark.sql import functions as F

from netframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(grams)
    covered = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, rows):
    extra = [(900, "a b c d e " * 3, "en", "s"), (901, "x\nx\n \nx\ny z\n", "en", "s"), (902, "a b c d e x a b c d e", "en", "s"), (903, "😀 é #|<", "en", "s"), (904, "a a a a a a", "en", "s")]
    df = docs.unionByName(docs.sparkSession.createDataFrame([(*r, 0) for r in extra], docs.schema))
    got = {(r["doc_id"],): None for r in df.collect()}
    out = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.measures(df).collect())
    assert out == Counter((i, *slow(t)) for i, t, *_ in [*rows, *extra]) and got


def test_base_rules_and_outliers(spark):
    clean = [(k, " ".join(f"w{(k * 31 + j * 7) % 997}x{j}" for j in range(60)), "en", "a" if k % 3 else "b") for k in range(300)]
    odd = [(1000, " ".join(f"w{j}###" for j in range(60)), "en", "a"), (1001, "few words", "en", "a"), (1002, "a b c d e " * 12, "en", "b"), (1003, None, None, None)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge(df.withColumn("limits", F.lit(1)).withColumn("bin", F.lit(1))).collect()}
    assert len(out) == 304
    assert not out[1000]["kept"] and not out[1000]["base_failed"]
    assert out[1001]["base_failed"] and out[1002]["base_failed"] and out[1003]["base_failed"] and out[1003]["n_words"] == 0
    assert all(out[k]["kept"] for k in range(300))


def test_sketches_merge(spark, docs):
    m = quality.measures(docs.select("doc_id", "lang", "source", "text")).cache()
    parts = quality.merge(quality.sketch(m.where("doc_id < 100"), "lang").unionByName(quality.sketch(m.where("doc_id >= 100 or doc_id is null"), "lang")), "lang")
    assert Counter(map(tuple, parts.collect())) == Counter(map(tuple, quality.sketch(m, "lang").collect()))


def test_empty(empty):
    assert quality.judge(empty).count() == 0


def test_sources_of_different_level_get_different_limits(spark):
    """Every measure's limit follows the source; none is a constant."""
    rows = []
    for k in range(1200):
        loud = k % 2
        words = [f"w{(k * 31 + j * 7) % 997}x{j}" + "y" * (2 * loud) for j in range(60)]
        if loud:
            words[k % 7] += "#" * (1 + k % 11)
        lines = [" ".join(words[j : j + 10]) for j in range(0, 60, 10)]
        if loud:
            lines += ["a b c"] * (1 + k % 4)
            lines.append(" ".join(words[: 5 + k % 5]))
        rows.append((k, "\n".join(lines), "en", "loud" if loud else "calm"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality.measures(df)
    got = {r["source"]: r["limits"] for r in quality.limits(quality.sketch(measured.where(~quality.base_failed()), "lang", "source")).collect()}
    for name in quality.MEASURES:
        assert got["loud"][name]["high"] > 1.2 * got["calm"][name]["high"] > -1, name
    assert got["loud"]["word_length"]["low"] > got["calm"]["word_length"]["low"]


def test_quantiles_are_right_to_one_part_in_64_at_any_size(spark):
    values = [3**k % 10**9 for k in range(60)] + [0, 1, 127, 128, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for v, b in df.select("v", quality._bin(F.col("v"))).collect():
        assert b <= v and v - b <= v / 64 and (b == v or v > 127)


def test_a_small_source_leans_on_its_language(spark):
    rows = [(k, " ".join(f"w{(k * 31 + j * 7) % 997}x{j}" for j in range(60)) + " #" * (k % 9), "en", "large") for k in range(600)]
    rows += [(1000 + k, rows[9 * k][1], "en", "small") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["source"]: r["limits"]["symbol_share"]["high"] for r in quality.limits(quality.sketch(quality.measures(df), "lang", "source")).collect()}
    assert 0.9 * got["large"] < got["small"] < got["large"]
