"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; unlabelled rows are a hash sample of all documents; rows whose
crc32(doc_id as text) mod 4 is 2 lend no labels. Each text, read whole, gives format and repetition features. The class
prior is estimated from both samples as the smallest ratio of unlabelled to positive mass above a score (a Scott-type
bound with a correction for sample size). A small network minimises the non-negative unbiased risk
prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]); while the second part is negative its gradient is reversed.
Its output becomes a probability by logistic calibration on labelled training rows of both classes (by the prior alone
where one class is missing).

The sample is bounded: TRAIN_ROWS labelled and TRAIN_ROWS unlabelled doc_ids, those with the smallest hashes; of rows with
one doc_id the least features count. Only features reach the driver.

Edge cases: null and empty texts have zero features and get a score; a null doc_id is not held out and has no label; of
several labels of a doc_id the smallest counts; without any positive every score is 0.5; repeated rows get equal scores;
an empty table gives an empty result; other columns are not read, except by filter_quality, which keeps all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_columns, map_slices, slices

TRAIN_ROWS = 6000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
HIDDEN, EPOCHS, RATE = 16, 250, 0.02

CLASSES = [
    [b for b in range(256) if chr(b).isascii() and chr(b).isupper()],
    [b for b in range(256) if chr(b).isascii() and chr(b).islower()],
    [b for b in range(256) if chr(b).isascii() and chr(b).isdigit()],
    [32],
    [10],
    [9, 11, 12, 13],
    [ord(c) for c in ".,;:"],
    [ord(c) for c in "!?"],
    [ord(c) for c in "|"],
    [ord(c) for c in "*#$%&"],
    [ord(c) for c in "'\"()-"],
    [ord(c) for c in "@/\\+=<>[]{}^_`~"],
    list(range(128, 256)),
]
CLASS_OF = np.full(256, len(CLASSES))
for _k, _members in enumerate(CLASSES):
    CLASS_OF[_members] = _k
N_FEATURES = len(CLASSES) + 1 + 13


def features(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(N_FEATURES)
    if not len(raw):
        return out
    by_class = np.bincount(CLASS_OF, weights=np.bincount(raw, minlength=256), minlength=len(CLASSES) + 1)
    out[: len(CLASSES) + 1] = by_class / len(raw)
    words = text.split()
    n = len(words)
    rest = out[len(CLASSES) + 1 :]
    rest[0] = np.log1p(n)
    if n:
        ids: dict[str, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        counts = np.bincount(w)
        lengths = np.fromiter(map(len, words), np.int64, n)
        rest[1] = (w[1:] == w[:-1]).mean() if n > 1 else 0
        rest[2] = len(counts) / n
        rest[3] = counts.max() / n
        rest[4] = len(np.unique(w[2:] + len(ids) * (w[1:-1] + len(ids) * w[:-2]))) / (n - 2) if n > 2 else 1
        rest[5], rest[6] = lengths.mean() / 10, lengths.std() / 10
        rest[7] = (lengths <= 3).mean()
        ends = [x[-1] for x in ids]
        odd = np.fromiter((not (c.isalnum() or c in ".,;:") for c in ends), bool, len(ends))
        rest[8] = counts[odd].sum() / n
        rest[9] = np.fromiter((x.isupper() and len(x) > 1 for x in ids), bool, len(ids)) @ counts / n
        rest[10] = np.fromiter((not any(map(str.isalnum, x)) for x in ids), bool, len(ids)) @ counts / n
    lines = text.split("\n")
    rest[11] = 1 - len(set(lines)) / len(lines)
    rest[12] = np.log1p(len(raw) / len(lines))
    return out


class Model:
    """A network of one hidden layer; score() gives calibrated probabilities of label 1."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        d = len(center)
        self.center, self.scale = center, scale
        self.w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.a, self.b = 1.0, 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of masses above a threshold, each ratio raised by its sampling error; at most 0.98."""
    cuts = np.quantile(positive, np.linspace(0, 0.95, 96))
    p, u = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive), 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = np.sqrt(np.maximum(u * (1 - u), 1e-4) / len(unlabelled)) + u / np.maximum(p, 1e-9) * np.sqrt(np.maximum(p * (1 - p), 1e-4) / len(positive))
    return float(np.clip(((u + 2 * error) / np.maximum(p, 1e-9)).min(), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray) -> tuple[Model, float]:
    """Fit by non-negative PU risk; negatives (labelled 0) only calibrate. Returns the model and the prior."""
    rng = np.random.default_rng(5)
    everything = np.concatenate([positive, unlabelled])
    model = Model(everything.mean(0), everything.std(0) + 1e-3, rng)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    prior = None
    for stage in range(2):  # the first fit, at a neutral prior, gives the scores that the prior is estimated from
        pi = 0.5 if stage == 0 else prior
        m, v = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
        for t in range(1, (EPOCHS // 3 if stage == 0 else EPOCHS) + 1):
            hp, hu = np.tanh(p @ model.w[0] + model.w[1]), np.tanh(u @ model.w[0] + model.w[1])
            gp, gu = hp @ model.w[2] + model.w[3][0], hu @ model.w[2] + model.w[3][0]
            lp, lu = 1 / (1 + np.exp(np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))  # l(g) on P, l(-g) on U
            slope_p, slope_u = lp * (1 - lp) / len(p), lu * (1 - lu) / len(u)
            rest = lu.mean() - pi * (1 - lp).mean()
            if rest >= 0:
                dp, du = -2 * pi * slope_p, slope_u
            else:
                dp, du = pi * slope_p, -slope_u
            grads = []
            for x, h, d in ((p, hp, dp), (u, hu, du)):
                back = (d[:, None] * model.w[2]) * (1 - h * h)
                grads.append([x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])])
            for k in range(4):
                g = grads[0][k] + grads[1][k] + 1e-4 * model.w[k] * (k in (0, 2))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.w[k] = model.w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        prior = estimate_prior(model.margin(positive), model.margin(unlabelled)) if stage == 0 else prior
    if len(negative):
        z = np.concatenate([model.margin(positive), model.margin(negative)])
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    else:
        z, y = model.margin(unlabelled), (model.margin(unlabelled) >= np.quantile(model.margin(unlabelled), 1 - prior)).astype(float)
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda ab: np.logaddexp(0, ab[0] * z + ab[1]).sum() - (soft * (ab[0] * z + ab[1])).sum() + 1e-3 * ab[0] ** 2
    ab = np.array([1.0, 0.0])
    for _ in range(100):  # damped Newton steps for the two calibration parameters
        q = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        g = np.array([((q - soft) * z).sum() + 2e-3 * ab[0], (q - soft).sum()])
        s = q * (1 - q)
        step = np.linalg.solve(np.array([[(s * z * z).sum() + 2e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]]), g)
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step * (size > 1e-6)
    a, b = ab
    model.a, model.b = float(a), float(b)
    return model, prior


def fold(doc_id):
    """crc32 of the doc_id as text, mod FOLDS; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def feature_rows(texts: DataFrame) -> DataFrame:
    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "kind": cols["kind"], "x": [features(t) for t in cols["text"]]}

    return map_slices(texts, "text", make, "doc_id bigint, kind int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on a bounded sample of labelled and unlabelled rows; None without positives."""
    labelled = labels.where(fold(F.col("doc_id")) != HELD_OUT).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    labelled = labelled.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("kind"))
    order = lambda salt: F.xxhash64(F.lit(salt), "doc_id")
    some = labelled.orderBy(order(1), "doc_id").limit(train_rows)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    free = ids.distinct().orderBy(order(2), "doc_id").limit(train_rows).withColumn("kind", F.lit(2))
    sample = F.broadcast(some.unionByName(free))  # at most 2 * train_rows ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    rows = feature_rows(texts.select("doc_id", "kind", "text")).groupBy("doc_id", "kind").agg(F.min("x").alias("x")).toPandas()
    rows = rows.sort_values(["kind", "doc_id"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    kind = rows["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 2).any():
        return None
    return train(x[kind == 1], x[kind == 2], x[kind == 0])[0]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def make():
        def f(cols):
            x = np.array([features(t) for t in cols["text"]]).reshape(-1, N_FEATURES)
            return {"doc_id": cols["doc_id"], "score": model.score(x) if model else [0.5] * len(x)}

        return f

    rows = map_slices(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), "text", make, "doc_id bigint, score double")
    held = fold(F.col("doc_id")) == HELD_OUT
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that the model does not reject, all columns kept; without a model all stay."""
    if model is None:
        return docs

    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                x = np.array([features(t) for t in part.column(at).to_pylist()]).reshape(-1, N_FEATURES)
                yield part.filter(pa.array(model.score(x) >= THRESHOLD))

    return map_columns(docs, run)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: quality scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
