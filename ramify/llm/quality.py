"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both are logistic models with features of their own. In each round each view labels the
unlabelled rows it is most certain of, and these become training rows of the other view. In
the end both are calibrated on labelled rows set aside, and their log-odds add up.

At most ``max_labelled`` labelled rows are used, taken in order of a hash of the id. All other rows
are unlabelled ones and take part in each round: their features are kept as a table, rows are chosen
by thresholds over all of them, and Newton steps add up gradients and Hessians by partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.arrow import as_bytes, slices, small_batches
from ramify.scratch import saved

_CLASSES = 8
_WORDS = 256
_META = 512


def _byte_classes() -> np.ndarray:
    """Lower case, upper case, digit, blank, line end, sentence mark, other mark, beyond ASCII."""
    kind = np.full(256, 6, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-")):
        kind[list(chars)] = k
    kind[128:] = 7
    return kind


def text_features(texts: list[bytes]) -> np.ndarray:
    """Shares of character-class trigrams, share of distinct words and lines, lengths, hashed words."""
    kind = _byte_classes()
    n = len(texts)
    tri = np.zeros((n, _CLASSES**3), np.float32)
    other = np.zeros((n, 4 + _WORDS), np.float32)
    for i, text in enumerate(texts):
        k = kind[np.frombuffer(text, np.uint8)]
        if len(k) > 2:
            code = (k[:-2] * _CLASSES + k[1:-1]) * _CLASSES + k[2:]
            tri[i] = np.bincount(code, minlength=_CLASSES**3) / (len(k) - 2)
        words, lines = text.split(), text.split(b"\n")
        distinct = set(words)
        other[i, 0] = len(distinct) / max(1, len(words))
        other[i, 1] = len(set(lines)) / len(lines)
        other[i, 2] = np.log1p(len(words)) / 10
        other[i, 3] = np.log1p(len(text) / max(1, len(words))) / 5
        if distinct:
            other[i, 4:] = np.bincount(np.fromiter((zlib.crc32(w) % _WORDS for w in distinct), np.int64, len(distinct)), minlength=_WORDS) / len(distinct)
    return np.hstack([np.sqrt(tri), other])


def meta_features(columns: list[list]) -> np.ndarray:
    """One hashed indicator for each column's value; numbers by their power of two."""
    out = np.zeros((len(columns[0]) if columns else 0, _META), np.float32)
    for c, values in enumerate(columns):
        for i, x in enumerate(values):
            known = f"2^{int(abs(x)).bit_length()}" if isinstance(x, int | float) and not isinstance(x, bool) and x == x and abs(x) < 1e300 else str(x)
            out[i, zlib.crc32(f"{c}={known}".encode()) % _META] = 1
    return out


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.shift

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
    """Ridge logistic regression by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))]).astype(np.float64)
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + penalty * beta
        move = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty), grad)
        beta -= move
        if np.abs(move).max() < 1e-4:
            break
    return Logistic(beta[:-1], float(beta[-1]), mean, spread)


def calibrated(m: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling on rows that the model wasn't fitted on."""
    if len(y) and 0 < y.mean() < 1:
        one = fitted(m.margin(x)[:, None], y, np.ones(len(y)), ridge=1e-3)
        m.slope = max(0.0, float(one.weights[0] / one.spread[0]))
        m.shift = one.bias - float(one.weights[0] * one.mean[0] / one.spread[0])
    return m


def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Features of both views of a batch of (t, m)."""
    text = np.frombuffer(b"".join(batch.column("t").to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float32)
    return [text, np.unpackbits(np.frombuffer(b"".join(batch.column("m").to_pylist()), np.uint8)).reshape(-1, _META).astype(np.float32)]


def summed(pool: DataFrame, of, sizes: list[int], kind: type = np.float64) -> list[np.ndarray]:
    """Vectors of the given sizes that ``of`` (features of both views) makes of each batch, added up over all rows."""
    blocks = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(sum(sizes))
        for batch in slices(batches, "t", 4 << 20, 2048):
            sums += np.concatenate([np.ravel(v) for v in of(unpacked(batch))])
        parts = [b.astype(kind).tobytes() for b in np.array_split(sums, blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), type=pa.int32()), pa.array(parts, type=pa.binary())], names=["k", "x"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind).astype(np.float64) for x in group.column("x").to_pylist())
        return pa.table({"k": group.column("k")[:1], "x": pa.array([total.tobytes()], type=pa.binary())})

    rows = pool.mapInArrow(run, "k int, x binary").groupBy("k").applyInArrow(add, "k int, x binary").collect()  # one row for each block
    out = np.concatenate([np.frombuffer(bytes(r["x"]), np.float64) for r in sorted(rows, key=lambda r: r["k"])]) if rows else np.zeros(sum(sizes))
    return np.split(out, np.cumsum(sizes)[:-1])


@dataclass
class Choice:
    """Rows that a view gives to the other one: log-odds of ``low`` or less as bad, of ``high`` or more as good."""

    view: int
    model: Logistic
    low: float
    high: float


def given_by(history: list[Choice], x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the view that it was given to (-1: none) and the label; the earliest choice holds."""
    to, y = np.full(len(x[0]), -1), np.zeros(len(x[0]))
    for c in history:
        odds = c.model.log_odds(x[c.view])
        new = (to < 0) & ((odds <= c.low) | (odds >= c.high))
        to[new], y[new] = 1 - c.view, odds[new] >= c.high
    return to, y


def derivatives(x: np.ndarray, y: np.ndarray, beta: np.ndarray, m: Logistic, curved: bool) -> list[np.ndarray]:
    """Gradient of the logistic loss at ``beta`` and, if ``curved``, the upper half of its Hessian."""
    z = np.hstack([(x - m.mean) / m.spread, np.ones((len(x), 1))]).astype(np.float32)
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    grad = z.T.astype(np.float64) @ (p - y)
    if not curved:
        return [grad]
    w = np.sqrt(np.maximum(p * (1 - p), 1e-4)).astype(np.float32)[:, None]
    return [grad, ((z * w).T @ (z * w))[np.triu_indices(z.shape[1])]]


_BINS = 2400  # of log-odds from -30 to 30


def co_trained(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: DataFrame, rounds: int, grow: float, ridge: float = 3.0, steps: int = 5, weight: float = 0.3) -> tuple[Logistic, Logistic, float]:
    """``label``: 0 or 1; ``pool``: features (t, m) of all unlabelled rows, of which each view labels a share of
    ``grow`` in a round at most (and those that tie with the last). Returns both models and the log-odds of a good page."""
    held, learn = np.arange(len(label))[::4], np.setdiff1d(np.arange(len(label)), np.arange(len(label))[::4])
    views = [text, meta]
    y, y_held = label[learn].astype(float), label[held].astype(float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    width = [text.shape[1], meta.shape[1]]

    # Means and spreads are those of the learning and all unlabelled rows; the models start from labelled rows alone.
    seen = summed(pool, lambda x: [[len(x[0])], *[f(v.astype(np.float64)) for v in x for f in (lambda v: v.sum(axis=0), lambda v: (v * v).sum(axis=0))]], [1, width[0], width[0], width[1], width[1]])
    models = []
    for v, (s1, s2) in zip(views, (seen[1:3], seen[3:5]), strict=True):
        n, x = seen[0][0] + len(learn), v[learn].astype(np.float64)
        mean = (s1 + x.sum(axis=0)) / n
        spread = np.sqrt(np.maximum(0, (s2 + (x * x).sum(axis=0)) / n - mean**2)) + 1e-3
        models.append(Logistic(np.zeros(v.shape[1]), 0.0, mean, spread))

    def fit(start: list[Logistic], history: list[Choice]) -> list[Logistic]:
        betas = [np.append(m.weights, m.bias) for m in start]
        halves = [None, None]
        penalty = [np.append(np.full(w, ridge), 1e-6) for w in width]
        for step in range(steps if history else 12):
            curved = step % 2 == 0 or not history
            sizes = [n for w in width for n in ([w + 1] + [(w + 1) * (w + 2) // 2] * curved)]

            def of(x: list[np.ndarray], betas=betas, curved=curved) -> list[np.ndarray]:
                to, label = given_by(history, x)
                return [d for v in (0, 1) for d in derivatives(x[v][to == v], label[to == v], betas[v], start[v], curved)]

            given = summed(pool, of, sizes, np.float32 if curved else np.float64) if history else [np.zeros(n) for n in sizes]
            largest = 0.0
            for v in (0, 1):
                own = derivatives(views[v][learn], y, betas[v], start[v], curved)
                theirs = given[v * len(own) : (v + 1) * len(own)]
                if curved:
                    half = np.zeros((width[v] + 1, width[v] + 1))
                    half[np.triu_indices(width[v] + 1)] = own[1] + weight * theirs[1]
                    halves[v] = half + np.triu(half, 1).T + np.diag(penalty[v])
                move = np.linalg.solve(halves[v], own[0] + weight * theirs[0] + penalty[v] * betas[v])
                betas[v] = betas[v] - move
                largest = max(largest, float(np.abs(move).max()))
            if largest < 1e-4:
                break
        return [calibrated(Logistic(b[:-1], float(b[-1]), m.mean, m.spread), views[v][held], y_held) for v, (b, m) in enumerate(zip(betas, start, strict=True))]

    def cuts(models: list[Logistic], history: list[Choice]) -> list[Choice]:
        def of(x: list[np.ndarray]) -> list[np.ndarray]:
            rest = given_by(history, x)[0] < 0
            place = [np.clip((m.log_odds(x[v][rest]) + 30) / 60 * _BINS, 0, _BINS - 1).astype(np.int64) for v, m in enumerate(models)]
            return [np.bincount(k, minlength=_BINS) for k in place]

        edges = np.linspace(-30, 30, _BINS + 1)
        # Confident means clearly beyond what the share of good pages says anyway.
        p_low, p_high = share * 0.3, 1 - (1 - share) * 0.3
        out = []
        for v, counts in enumerate(summed(pool, of, [_BINS, _BINS])):
            low = edges[1:][min(_BINS - 1, int(np.searchsorted(np.cumsum(counts), grow * (1 - share) * seen[0][0])))]
            high = edges[:-1][_BINS - 1 - min(_BINS - 1, int(np.searchsorted(np.cumsum(counts[::-1]), grow * share * seen[0][0])))]
            out.append(Choice(v, models[v], min(low, np.log(p_low / (1 - p_low))), max(high, np.log(p_high / (1 - p_high)))))
        return out

    models, history = fit(models, []), []
    for _ in range(rounds if seen[0][0] else 0):
        history = history + cuts(models, history)
        models = fit(models, history)
    return models[0], models[1], float(np.log(share / (1 - share)))


def quality_scores(df: DataFrame, id_col: str, text_col: str, meta_cols: list[str], labels: DataFrame, label_id: str, label_col: str, max_labelled: int = 12_000, rounds: int = 3, grow: float = 0.075) -> DataFrame:
    """``id_col``, text_score, meta_score, score (chances of a good page), kept (score >= 0.5).

    Null texts count as empty, null metadata as a value of its own, null labels as none; of
    several labels of an id the smallest holds. Without labels of both kinds all scores are 0.5.
    Rows with null ids are unlabelled; so are labelled rows beyond ``max_labelled``.
    """
    spark = small_batches(df).sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_l")).agg(F.min(label_col).cast("int").alias("_y"))
    cols = [F.col(text_col).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)]]
    rows = df.select(F.col(id_col).alias("id"), *cols)
    order = F.xxhash64("id", F.lit(11))
    marked = rows.select("id").join(marks, F.col("id") == F.col("_l")).select("id", F.col("_y").alias("y")).where("y >= 0").distinct()
    picked = marked.orderBy(order, "id").limit(max_labelled)
    chosen = spark.createDataFrame(picked.collect(), picked.schema)
    n_text = _CLASSES**3 + 4 + _WORDS
    names = [f"m{i}" for i in range(len(meta_cols))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, 512):
            text = text_features(as_bytes(batch.column("text"))).astype(np.float16)
            meta = meta_features([batch.column(c).to_pylist() for c in names] or [[None] * batch.num_rows]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([t.tobytes() for t in text], type=pa.binary()), pa.array([np.packbits(m > 0).tobytes() for m in meta], type=pa.binary())], names=["y", "t", "m"])

    # Rows that repeat an id count once, by the least hash, so the sample stays as small as the ids chosen.
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by(F.struct("text", *names), F.struct(F.xxhash64("text", *names), F.hash("text", *names))).alias("row")).select("y", "row.*").mapInArrow(features, "y int, t binary, m binary").orderBy("y", "t", "m").collect()
    y = np.array([r["y"] for r in sample], np.int64)
    models = None
    if (y == 0).sum() > 1 and (y == 1).sum() > 1:
        text = np.frombuffer(b"".join(bytes(r["t"]) for r in sample), np.float16).reshape(-1, n_text).astype(np.float32)
        meta = np.unpackbits(np.frombuffer(b"".join(bytes(r["m"]) for r in sample), np.uint8)).reshape(-1, _META).astype(np.float32)
        shuffled = np.random.default_rng(3).permutation(len(y))
        others = rows.join(F.broadcast(chosen.select("id")), "id", "left_anti").withColumn("y", F.lit(-1))
        pool = saved(others.mapInArrow(features, "y int, t binary, m binary").select("t", "m"), "quality-features")
        models = co_trained(text[shuffled], meta[shuffled], y[shuffled], pool, rounds, grow)
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, 512):
            n = batch.num_rows
            a = b = c = np.full(n, 0.5)
            if models:
                text_model, meta_model, prior = models
                x = text_features(as_bytes(batch.column("text"))).astype(np.float16).astype(np.float32)
                m = meta_features([batch.column(k).to_pylist() for k in names] or [[None] * n])
                a, b = text_model.chance(x), meta_model.chance(m)
                c = 1 / (1 + np.exp(-np.clip(text_model.log_odds(x) + meta_model.log_odds(m) - prior, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, type=pa.float64()) for v in (a, b, c)], pa.array(c >= 0.5)], names=[id_col, "text_score", "meta_score", "score", "kept"])

    return rows.mapInArrow(score, f"`{id_col}` {kind}, text_score double, meta_score double, score double, kept boolean")
