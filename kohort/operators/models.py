"""Pair classifiers: deep-and-wide network and logistic regression, in numpy on Arrow batches and with Spark's own optimiser."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort.operators.validation import ContractError
from kohort.session import ship

FRAMEWORK = "numpy"  # tag of checkpoints written here
PAIR_ROWS = 512  # pairs in a step of training or a batch of features


def deep_features(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """[u, v, |u-v|, u*v]; built inside a batch, never stored."""
    return np.concatenate([u, v, np.abs(u - v), u * v], axis=1)


def depth(w: dict[str, np.ndarray]) -> int:
    """Layers of the deep part."""
    n = 0
    while f"w{n}" in w:
        n += 1
    return n


def forward(w: dict[str, np.ndarray], wide: np.ndarray, deep: np.ndarray | None = None) -> np.ndarray:
    """Probabilities: a linear wide part plus, if there are layers, ReLU layers over the deep features. Layers need deep."""
    z = wide @ w["wide_w"] + w["wide_b"]
    n = depth(w)
    if n:
        if deep is None:
            raise ContractError("the weights have a deep part, and no vectors are given")
        h = deep
        for i in range(n):
            h = h @ w[f"w{i}"] + w[f"b{i}"]
            if i + 1 < n:
                h = np.maximum(h, 0)
        z = z + h[:, 0]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def initial_weights(wide: int, deep: int = 0, hidden: tuple[int, ...] = (512, 256), seed: int = 42) -> dict[str, np.ndarray]:
    """Zero wide part; layers deep -> hidden -> 1, uniform within 1 / sqrt(inputs), if deep is not 0."""
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"wide_w": np.zeros(wide), "wide_b": np.zeros(())}
    if deep:
        for i, (a, b) in enumerate(zip((deep, *hidden), (*hidden, 1))):
            w[f"w{i}"], w[f"b{i}"] = rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)
    return w


def _gradients(w: dict[str, np.ndarray], wide: np.ndarray, deep: np.ndarray | None, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean weighted cross-entropy, and that mean."""
    n, kept = depth(w), []
    z = wide @ w["wide_w"] + w["wide_b"]
    if n:
        h = deep
        for i in range(n):
            kept.append(h)
            h = h @ w[f"w{i}"] + w[f"b{i}"]
            h = np.maximum(h, 0) if i + 1 < n else h
        z = z + h[:, 0]
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    loss = float(np.mean(weight * -np.where(y == 1, np.log(np.maximum(p, 1e-30)), np.log(np.maximum(1 - p, 1e-30)))))
    back = (p - y) * weight / len(y)
    out = {"wide_w": wide.T @ back, "wide_b": np.asarray(back.sum())}
    flow = back[:, None]
    for i in range(n - 1, -1, -1):
        out[f"w{i}"], out[f"b{i}"] = kept[i].T @ flow, flow.sum(0)
        if i:
            flow = (flow @ w[f"w{i}"].T) * (kept[i] > 0)
    return out, loss


class AdamW:
    """Adam with decoupled weight decay."""

    def __init__(self, w: dict[str, np.ndarray], rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m, self.s = ({k: np.zeros_like(v, dtype=float) for k, v in w.items()} for _ in range(2))

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k in w:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.s[k] = 0.999 * self.s[k] + 0.001 * g[k] * g[k]
            w[k] = w[k] * (1 - self.rate * self.decay) - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)


def pos_weight(pairs: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``n_pos, n_neg, weight``, negatives for each positive; null without a positive."""
    n = pairs.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return n.withColumn("weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")))


def fit_epoch(w: dict[str, np.ndarray], adam: AdamW, wide: np.ndarray, deep: tuple[np.ndarray, np.ndarray] | None, y: np.ndarray, positive: float, order: np.ndarray, batch: int = PAIR_ROWS) -> float:
    """One pass in the given order; weights change in place. deep: vectors of both sides, whose features are made batch by batch."""
    total = 0.0
    for at in range(0, len(order), batch):
        i = order[at : at + batch]
        g, loss = _gradients(w, wide[i], deep_features(deep[0][i], deep[1][i]) if deep else None, y[i], np.where(y[i] == 1, positive, 1.0))
        adam.step(w, g)
        total += loss * len(i)
    return total / max(1, len(order))


def f1_positive(p: np.ndarray, y: np.ndarray, theta: float = 0.5) -> float:
    hit = p >= theta
    tp = int((hit & (y == 1)).sum())
    return 2.0 * tp / max(1, int(hit.sum()) + int((y == 1).sum())) if tp else 0.0


def _arrays(pdf: pd.DataFrame, features: list[str], vectors: tuple[str, str] | None):
    wide = pdf[features].to_numpy(float) if features else np.zeros((len(pdf), 0))
    deep = tuple(np.stack(pdf[c].to_numpy()).astype(float) for c in vectors) if vectors and len(pdf) else None
    return wide, deep


def train_folds(train: DataFrame, dev: DataFrame, features: list[str], vectors: tuple[str, str] | None = None, fold: str = "fold", epochs: int = 8, rate: float = 1e-3, decay: float = 1e-2, hidden: tuple[int, ...] = (512, 256), batch: int = PAIR_ROWS, seed: int = 42, theta: float = 0.5) -> DataFrame:
    """``fold, epoch, train_loss, dev_f1, best, weights``: a row for each epoch of each fold, folds side by side.

    train and dev: fold, label, the wide features and, for a deep part, two vector columns. Positives weigh negatives /
    positives. best marks the first epoch with the greatest F1 of the positive class on dev; only its weights (an .npz)
    are kept. Without vectors the model is a logistic regression. A fold's pairs must fit one task.
    """
    ship(train.sparkSession)
    cols = [fold, "label", *features, *(vectors or ())]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, kept, best = [], b"", -1.0
        (wide, deep), (dev_wide, dev_deep) = _arrays(a, features, vectors), _arrays(b, features, vectors)
        y, dev_y = a["label"].to_numpy(float), b["label"].to_numpy(float)
        w = initial_weights(len(features), 4 * deep[0].shape[1] if deep else 0, hidden, seed)
        adam, rng = AdamW(w, rate, decay), np.random.default_rng(seed)
        positive = float((y == 0).sum()) / max(1.0, float((y == 1).sum())) or 1.0
        for epoch in range(1, epochs + 1):
            loss = fit_epoch(w, adam, wide, deep, y, positive, rng.permutation(len(y)), batch)
            p = np.concatenate([forward(w, dev_wide[at : at + batch], deep_features(*(x[at : at + batch] for x in dev_deep)) if dev_deep else None) for at in range(0, len(dev_y), batch)] or [np.empty(0)])
            score = f1_positive(p, dev_y, theta)
            rows.append([key[0], epoch, loss, score, False, None])
            if score > best:
                out = io.BytesIO()
                np.savez(out, **w)
                best, kept, at_best = score, out.getvalue(), epoch - 1
        if rows:
            rows[at_best][4:] = [True, kept]
        return pd.DataFrame(rows, columns=["fold", "epoch", "train_loss", "dev_f1", "best", "weights"])

    kind = train.schema[fold].dataType.simpleString()
    grouped = train.select(*cols).groupBy(fold).cogroup(dev.select(*cols).groupBy(fold))
    return grouped.applyInPandas(run, f"fold {kind}, epoch int, train_loss double, dev_f1 double, best boolean, weights binary")


def weights_of(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def best_overall(runs: DataFrame, *order: str) -> DataFrame:
    """The one run that is greatest by the given columns, one after the other; a column after ``-`` counts downwards."""
    keys = [F.col(c[1:]).asc() if c.startswith("-") else F.col(c).desc_nulls_last() for c in order]
    return runs.orderBy(*keys).limit(1)


def fit_logistic(pairs: DataFrame, features: list[str], label: str = "label", iterations: int = 100, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights of a logistic regression over pairs of any number, by Spark's distributed optimiser; positives weigh negatives / positives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = pos_weight(pairs, label).first()
    rows = pairs.select(F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, F.lit(n.weight or 1.0)).otherwise(1.0).alias("weight"), *[F.col(f).cast("double").alias(f) for f in features])
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=decay, standardization=False).fit(ready)
    return {"wide_w": model.coefficients.toArray(), "wide_b": np.asarray(model.intercept)}


def train_logistic(x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 1e-2, decay: float = 1e-2, batch: int = PAIR_ROWS, seed: int = 42) -> dict[str, np.ndarray]:
    """The same model by minibatches of arrays."""
    w = initial_weights(x.shape[1])
    adam, rng = AdamW(w, rate, decay), np.random.default_rng(seed)
    positive = float((y == 0).sum()) / max(1, int((y == 1).sum())) or 1.0
    for _ in range(epochs):
        fit_epoch(w, adam, x, None, y, positive, rng.permutation(len(x)), batch)
    return w


def report_vector(cases: DataFrame, fields: list[str], dims: dict[str, int]) -> Column:
    """The fields' vectors one after the other, zeros where one is missing or its ``<field>_valid`` is false."""
    parts = []
    for f in fields:
        ok = F.col(f).isNotNull() & (F.col(f"{f}_valid") if f"{f}_valid" in cases.columns else F.lit(True))
        parts.append(F.when(ok, F.col(f).cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dims[f])))
    return F.concat(*parts)


def report_vectors(cases: DataFrame, fields: list[str], dims: dict[str, int], key: str = "id") -> DataFrame:
    """``id, report``, see report_vector."""
    return cases.select(F.col(key).alias("id"), report_vector(cases, fields, dims).alias("report"))


def with_reports(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """pairs with ``q_report`` and ``c_report``; a side without one gets nulls, which count as zeros."""
    q, c = (reports.select(F.col("id").alias(side), F.col("report").alias(f"{side[0]}_report")) for side in ("query_id", "candidate_id"))
    return pairs.join(q, "query_id", "left").join(c, "candidate_id", "left")


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column, zeros for null."""
    out = np.zeros((len(column), dim))
    there = np.flatnonzero(column.is_valid())
    if len(there):
        flat = np.asarray(column.drop_null().flatten().to_numpy(zero_copy_only=False), float)
        out[there] = flat.reshape(len(there), dim)
    return out


def predict(pairs: DataFrame, weights: dict[str, np.ndarray], features: list[str], theta: float = 0.5, vectors: tuple[str, str] | None = None) -> DataFrame:
    """``query_id, candidate_id, probability, prediction`` from wide feature columns and, for a deep part, two vector columns.

    Weights with layers need vectors, and weights without refuse them: nothing is left out in silence. Deep features are
    made for PAIR_ROWS pairs at a time.
    """
    n = depth(weights)
    if bool(n) != bool(vectors):
        raise ContractError("a deep part and vectors belong together")
    if len(np.atleast_1d(weights["wide_w"])) != len(features):
        raise ContractError(f"the weights take {len(np.atleast_1d(weights['wide_w']))} features, {len(features)} are given")
    ship(pairs.sparkSession)
    held = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value
        for b in batches:
            wide = np.column_stack([np.asarray(b.column(i + 2).to_numpy(zero_copy_only=False), float) for i in range(len(features))]) if features else np.zeros((b.num_rows, 0))
            p = np.empty(b.num_rows)
            for at in range(0, b.num_rows, PAIR_ROWS):
                part = slice(at, min(at + PAIR_ROWS, b.num_rows))
                deep = None
                if vectors:
                    u, v = (_stack(b.column(len(features) + 2 + i).slice(at, PAIR_ROWS), w["w0"].shape[0] // 4) for i in range(2))
                    deep = deep_features(u, v)
                p[part] = forward(w, wide[part], deep)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= theta).astype(np.int32))], names=["query_id", "candidate_id", "probability", "prediction"])

    return pairs.select(F.col("query_id").cast("string"), F.col("candidate_id").cast("string"), *features, *(vectors or ())).mapInArrow(run, "query_id string, candidate_id string, probability double, prediction int")


def encode_texts(texts: DataFrame, make_encoder, dim: int, key: str = "id", text: str = "text") -> DataFrame:
    """``id, vec, valid`` by any encoder: make_encoder() gives a function from a list of texts to an array, once a task.

    Vectors are normalised. A batch that fails is tried again text by text; a text that fails, or is blank, gets zeros
    and is not valid.
    """
    ship(texts.sparkSession)

    def run(batches):
        encoder = make_encoder()

        def one(text: str) -> np.ndarray | None:
            try:
                return np.asarray(encoder([text]), float)[0]
            except Exception:  # whatever a model may raise for a text
                return None

        for b in batches:
            own = [x or "" for x in b.column(1).to_pylist()]
            try:
                got = list(np.asarray(encoder(own), float)) if own else []
            except Exception:  # the same, for the batch
                got = [one(x) for x in own]
            out = np.zeros((len(own), dim))
            valid = np.zeros(len(own), bool)
            for i, v in enumerate(got):
                if v is not None and own[i].strip() and len(v) == dim and np.isfinite(v).all():
                    out[i], valid[i] = v / (np.linalg.norm(v) or 1.0), True
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), vec, pa.array(valid)], names=["id", "vec", "valid"])

    return texts.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id string, vec array<float>, valid boolean")


def save_checkpoint(path: str, weights: dict[str, np.ndarray], config: dict) -> None:
    with open(path, "wb") as f:
        np.savez(f, __config__=json.dumps({"framework": FRAMEWORK, **config}, sort_keys=True), **weights)


def load_checkpoint(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Weights and configuration; sizes that it lacks are read off the weights, sizes that contradict them raise, and so does another framework's tag."""
    with np.load(path) as z:
        w = {k: z[k] for k in z.files if k != "__config__"}
        config = json.loads(str(z["__config__"])) if "__config__" in z.files else {}
    if config.get("framework", FRAMEWORK) != FRAMEWORK:
        raise ContractError(f"a checkpoint of {config['framework']!r}")
    for k, found in {"wide_dim": int(np.size(w["wide_w"])), "layers": [int(w[f"w{i}"].shape[1]) for i in range(depth(w))]}.items():
        if config.setdefault(k, found) != found:
            raise ContractError(f"{k} is {config[k]}, the weights have {found}")
    return w, config
