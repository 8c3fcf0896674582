import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from netframe.llm import exact_dedup, simhash
from netframe.llm.graph_components import components


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps, bits=2):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= bits).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(docs, rows):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    by = {}
    for (i, *_), g in zip(rows, groups(fps)):
        by.setdefault(g, []).append(i)
    want = sorted(((i, f, min((x for x in by[g] if x is not None), default=None)) for (i, *_), f, g in zip(rows, fps, groups(fps))), key=repr)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in out), key=repr) == want


def test_links_of_crowded_keys(spark):
    """Keys with more members than are joined pairwise give the same components."""
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(3)]
    fps = set(centre)
    for c in centre:
        for _ in range(150):
            x = c
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(24)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for full in (1, 4, 1000):
        comp = {row["node"] & (1 << 64) - 1: row["root"] for row in components(simhash.close_links(df, full=full)).collect()}
        got, want = {}, {}
        for x, g in zip(fps, groups(fps)):
            got.setdefault(comp.get(x, ("alone", x)), set()).add(x)
            want.setdefault(g, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {roots[k] for k in range(n)} == {0} and roots[1001] == roots[1000] == 1000


def test_keep_one(docs, rows, empty):
    kept = simhash.keep_one(docs.withColumn("nf_gone", F.lit(1)))
    assert kept.columns == [*docs.columns, "nf_gone"]
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 3 in ids and not {200, 201, 202, 203, 204} & set(ids) and ids.count(None) == 2
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def similar(a, b):
    return simhash.shingle_similarity(a.encode(), b.encode())


def test_near_copies_by_shingles(spark):
    r = random.Random(8)
    texts = []
    for k in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(150)]
        texts.append(" ".join(words))
        for _ in range(k % 4):
            w = list(words)
            for _ in range(2):
                w[r.randrange(150)] = f"v{r.randrange(3000)}"
            texts.append(" ".join(w))
    crowd = [f"c{j}" for j in range(60)]
    for _ in range(80):  # the same words in other orders: alike to SimHash, not to the shingles
        r.shuffle(crowd)
        texts.append(" ".join(crowd))
    texts += [texts[-1] + " c1", "short one", "short one two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("like", F.lit(1)).withColumn("fp", F.lit(2))
    gone = {x["id"]: x["like"] for x in simhash.near_copies(docs).collect()}
    want = {j for j in range(len(texts)) if any(similar(texts[i], texts[j]) >= 0.8 for i in range(j))}
    assert set(gone) == want and all(similar(texts[a], texts[b]) >= 0.8 for a, b in gone.items())
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert set(range(len(texts))) - {x[0] for x in left.select("doc_id").collect()} == want


def test_near_copies_of_odd_rows(docs, rows, empty):
    ids = {x["id"] for x in simhash.near_copies(docs).collect()}
    assert {200, 201, 202, 203, 204, 405} <= ids and None not in ids and not ids & {3, 403, 404}
    assert simhash.drop_near_copies(empty).count() == 0


def near_and_want(spark, texts, **more):
    """(ids that the stage drops, ids with a similar smaller id)."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {x[0] for x in simhash.drop_near_copies(docs, **more).select("doc_id").collect()}
    return set(range(len(texts))) - left, {j for j in range(len(texts)) if any(similar(texts[i], texts[j]) >= 0.8 for i in range(j))}


def test_default_call_finds_short_and_shortened_copies(spark):
    r = random.Random(11)
    texts = []
    for k in range(80):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((12, 16, 25, 60, 150)))]
        shorter = words[: len(words) - len(words) // 7]
        other = [*words[:-1], "other"]
        texts += [" ".join(words), " ".join(shorter), " ".join(other)]
    got, want = near_and_want(spark, texts)
    assert len(want) > 100 and got == want


def brute(rows, similarity=0.8):
    """Ids with a similar smaller id; every pair of texts that share a shingle is compared."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, holders, out = {i: shingles(t) for i, t in rows}, {}, set()
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders.get(g, ()))
        if any(n >= similarity * (len(sets[i]) + len(sets[j]) - n) for j, n in shared.items()):
            out.add(i)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    return out


def test_stage_against_brute_force_after_exact_dedup(spark):
    docs = exact_dedup.keep_one(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    left = {r[0] for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    want = brute(rows)
    assert want and {i for i, _ in rows} - left == want


def test_a_family_whose_members_are_just_similar(spark):
    """600 texts with four changed words in 200: pairs lie about the least similarity."""
    r = random.Random(14)
    base = [f"b{j}" for j in range(200)]
    texts = []
    for k in range(600):
        w = list(base)
        for j in r.sample(range(200), 4):
            w[j] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = set(range(600)) - {x[0] for x in simhash.drop_near_copies(docs).select("doc_id").collect()}
    assert gone == brute(list(enumerate(texts))) and len(gone) > 10


def test_copies_that_share_a_fingerprint_with_unlike_rows(spark):
    r = random.Random(12)
    words = [f"c{j}" for j in range(60)]
    mixed = [r.sample(words, 60) for _ in range(3)]
    texts = [" ".join(w) for w in (mixed[0], [*mixed[1], "zz"], mixed[2], [*mixed[2], mixed[2][-1]])]
    got, want = near_and_want(spark, texts)
    assert got == want == {3}


def test_copies_in_crowded_keys(spark):
    """Every shingle of the copies is in an earlier unlike row too."""
    r = random.Random(13)
    words = [f"c{j}" for j in range(60)]
    a = r.sample(words, 60)
    texts = []
    for k in range(80):
        part = a[k * 8 : k * 8 + 12] if k < 8 else []
        texts.append(" ".join([*part, f"own{k}", *r.sample(sorted(set(words) - set(part)), 60 - len(part))]))
    texts += [" ".join(a), " ".join([*a, a[-1]])]
    got, want = near_and_want(spark, texts)
    assert got == want == {81}
