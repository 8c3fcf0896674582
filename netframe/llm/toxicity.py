"""Operator 3: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P; a sample of all texts, whatever their labels, is the
unlabelled U, of which the class prior's share is toxic.  With class prior p and loss l the risk of a scorer f is estimated by

    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f))

(Kiryo et al., 2017); where the second term falls below zero in a batch, its gradient is taken
backwards.  f is linear over the hashed words that a text has and the word beginnings (of PREFIXES bytes) that one, two
or three of its words share, A-Z lowered and edge punctuation off; inflected forms share their beginnings, and a single
word that happens to begin like a toxic one is told from several.  Only features are kept whose share
among P differs from that among U by more than Z standard errors and is LEAST_SHARE at least in one, so that chance words of few
texts carry no weight.  Training is Adam in numpy on the driver, over batches of BATCH unlabelled texts (with the
default bounds all are one batch); scoring is one pass of a map over whole texts.

The fit reads a bounded sample: at most POSITIVES confirmed texts and UNLABELLED of all, those with the
least hash of their id among the rows that may be learnt from; the bounds are parameters.
The class prior is the labelled rows' share of toxic ones, unless given.

Rows whose crc32(id) mod 5 is 0 are never learnt from.  Labels, language, source and id are never
inputs of a score.

Cases: null and empty texts score as a text without words; without any positive (or any other) row
to learn from every score is the prior or 0; repeated labels of one id count as toxic if one
of them does; repeated rows are scored alike; a very long text is scored whole, in one row; an empty table has an
empty result; extra columns are not read, or pass through drop_toxic, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let_go, materialize, row_ranges, tidy, trim

BITS = 20
PREFIXES = (4, 5, 6)
#: A beginning is one feature for each of these numbers of distinct words that have it.
TIMES = (1, 2, 3)
Z = 7.0
LEAST_SHARE = 0.015
BATCH = 16_384
POSITIVES = 4_000
UNLABELLED = 10_000
EPOCHS = 300
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_"


def text_features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted feature numbers of a text's distinct words."""
    words = {w.strip(_EDGE) for w in set(text.lower().split())}
    words.discard(b"")
    parts = [(0, words)]
    for n in PREFIXES:
        begun = Counter([w[:n] for w in words if len(w) >= n])
        parts += [(n + 100 * (k - 1), [p for p, times in begun.items() if times >= k]) for k in TIMES]
    h = np.fromiter((x for seed, ws in parts for x in map(xxhash.xxh3_64_intdigest, ws, repeat(seed))), np.uint64, sum(len(ws) for _, ws in parts))
    return np.unique(h & np.uint64((1 << bits) - 1)).astype(np.int32)


@dataclass
class Model:
    """f(text) = bias + the weights of the features it has."""

    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of texts whose features lie one after the other."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[features])])
        return total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)] + self.bias if len(ends) else np.zeros(0)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def nn_risk(f_positive: np.ndarray, f_unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(prior * mean_P l(f), mean_U l(-f) - prior * mean_P l(-f), slopes) with the logistic loss l.

    The risk is the first plus the second or 0.  The slopes, for each f of P and then of U, are those of the risk, or of
    the second part taken backwards where it is below 0.
    """
    n_p, n_u = len(f_positive), len(f_unlabelled)
    # l(z) = log(1 + exp(-z)): the slope of l(f) is s - 1, of l(-f) it is s
    s_p, s_u = _sigmoid(f_positive), _sigmoid(f_unlabelled)
    as_positive = prior * float(np.logaddexp(0, -f_positive).mean())
    as_negative = float(np.logaddexp(0, f_unlabelled).mean()) - prior * float(np.logaddexp(0, f_positive).mean())
    if as_negative >= 0:
        slopes = np.concatenate([prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u])
    else:
        slopes = np.concatenate([prior * s_p / n_p, -s_u / n_u])
    return as_positive, as_negative, slopes


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, epochs: int = EPOCHS, seed: int = 0, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with the logistic loss."""
    size = 1 << bits
    if not positive or not unlabelled:
        b = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return Model(np.zeros(size), b, prior)
    n_pos, n_unl = len(positive), len(unlabelled)
    in_pos = np.bincount(np.concatenate(positive), minlength=size)
    in_unl = np.bincount(np.concatenate(unlabelled), minlength=size)
    share = (in_pos + in_unl + 1) / (n_pos + n_unl + 2)
    z = (in_pos / n_pos - in_unl / n_unl) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl))
    used = (np.abs(z) > Z) & ((in_pos >= max(4, LEAST_SHARE * n_pos)) | (in_unl >= max(4, LEAST_SHARE * n_unl)))
    number = np.cumsum(used) - 1  # of a feature among those used
    positive, unlabelled = ([number[t[used[t]]].astype(np.int32) for t in texts] for texts in (positive, unlabelled))
    many = int(used.sum())

    def rows(texts):
        return np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    rng = np.random.default_rng(seed)
    w, b = np.zeros(many), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros(many), np.zeros(many), 0.0, 0.0, 0
    batches = max(1, len(unlabelled) // BATCH)
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for p_part, u_part in zip(np.array_split(p_order, batches), np.array_split(u_order, batches)):
            if not len(p_part):
                p_part = rng.choice(len(positive), 1)
            flat, owner = rows([positive[i] for i in p_part] + [unlabelled[i] for i in u_part])
            n_p, n_u = len(p_part), len(u_part)
            f = np.bincount(owner, w[flat], n_p + n_u) + b
            _, _, g = nn_risk(f[:n_p], f[n_p:], prior)
            grad = np.bincount(flat, g[owner], many) + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    whole = np.zeros(size)
    whole[used] = w
    return Model(whole, b, prior)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores of the texts, about a megabyte at a time."""
    out = [np.zeros(0)]
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for lo, hi in row_ranges(sizes, 1 << 20):
        feats = [text_features(t or b"") for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
        out.append(_sigmoid(model.logits(np.concatenate(feats), np.cumsum([len(x) for x in feats]))))
    return np.concatenate(out)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurised(docs: DataFrame, extra: list[str], text_col: str) -> DataFrame:
    def run(batches):
        let_go()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                feats = [text_features(t or b"").tobytes() for t in part.column(len(extra)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(extra))), pa.array(feats, pa.binary())], names=[*extra, "features"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(*extra, text_col).mapInArrow(run, kinds + ", features binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model of the labelled rows that may be learnt from, and as many others."""
    marks = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("nf_id")).agg(F.max(F.coalesce(F.col(toxic_col), F.lit(0)).cast("int")).alias("nf_toxic"))
    if prior is None:
        seen = marks.agg(F.count(F.lit(1)).alias("n"), F.sum("nf_toxic").alias("t")).first()
        prior = min(0.9, max(1e-3, (seen["t"] or 0) / max(1, seen["n"])))
    some = docs.where(~held_out(F.col(id_col))).select(id_col, text_col)

    def sample(ids: DataFrame, n: int) -> list[np.ndarray]:
        """Features of the n ids with the least hash; only ids are sorted, and n rows are sent, a partition at a time."""
        top = ids.select(F.col(id_col).alias("nf_own")).distinct().orderBy(F.xxhash64(F.lit(7), F.col("nf_own")), "nf_own").limit(n)
        chosen = some.join(F.broadcast(top), some[id_col].eqNullSafe(top["nf_own"]), "left_semi")  # n rows at most
        # of rows that share an id one is taken
        got = _featurised(chosen, [id_col], text_col).groupBy(id_col).agg(F.min("features").alias("features"))
        got = materialize(got.select(F.xxhash64(F.lit(7), F.col(id_col)).alias("place"), F.col(id_col).cast("string").alias("name"), "features"), "sample")
        rows = sorted((r["place"], r["name"] or "", bytes(r["features"])) for r in got.toLocalIterator())
        discard(got)
        return [np.frombuffer(x, np.int32) for _, _, x in rows]

    ids = some.select(id_col)
    toxic = ids.join(marks.where("nf_toxic = 1"), F.col(id_col) == F.col("nf_id"), "left_semi")
    model = fit(sample(toxic, positives), sample(ids, unlabelled), prior)
    tidy(docs.sparkSession)
    return model


def _scorer(model: Model):
    """_scores of the model on workers; only the weights that are not 0 travel."""
    used = np.flatnonzero(model.weights)
    values, size, bias, prior = model.weights[used], len(model.weights), model.bias, model.prior

    def make():
        whole = np.zeros(size)
        whole[used] = values
        return lambda texts: _scores(Model(whole, bias, prior), texts)

    return make


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double) of every row."""
    make = _scorer(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        let_go()
        scores = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], names=[id_col, "score"])
        trim()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """(id_col, held_out boolean, score double, predicted int)."""
    out = score(docs, train(docs, labels, id_col, text_col, **fitting), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more."""
    model = train(docs, labels, id_col, text_col, **fitting)
    make = _scorer(model)
    at = docs.columns.index(text_col)

    def run(batches):
        let_go()
        scores = make()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < 0.5))
        trim()

    return docs.mapInArrow(run, docs.schema)
