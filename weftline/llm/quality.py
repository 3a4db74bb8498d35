"""A quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of the learning folds with label 1; the unlabelled set is a sample of all
documents. The model minimises the non-negative risk estimate

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

by Adam, stepping against the negative part when it falls below zero. No labelled negative is used anywhere: the class
prior comes from the least ratio of the unlabelled rows' and left-out positives' shares above a threshold of a first
network's output. One network is trained without each learning fold. Slope and shift that turn their outputs into a
probability minimise the same risk, which is convex in them, over left-out positives and the unlabelled rows.

Inputs of a score are counts of a text's bytes and of adjacent byte classes, and how far its words and lines repeat; ids, language, source and labels are not.
Training takes bounded samples (about SAMPLE rows of each set, chosen by a hash of the id); scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare
from .tokens import strings, units

#: Rows that the positives and the unlabelled set are each bounded to.
SAMPLE = 12_000
HIDDEN, STEPS, BATCH, DECAY = 24, 500, 512, 3e-2
#: Of the four folds of documents those that labels are learnt from.
LEARNING, HELD_OUT = (0, 1, 3), 2

#: Bytes of text whose features are counted at once.
UNIT = 4 << 20

_CLASSES = 14


def _byte_classes() -> np.ndarray:
    table = np.full(256, 13, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for k, chars in enumerate((" \t", "\r\n", ".,;:", "!?", "|", "\"'`()[]{}", "%$#&*@^~", "<>/\\=+-_"), 3):
        table[[ord(c) for c in chars]] = k
    table[0x80:0xC0], table[0xC0:] = 11, 12
    return table


_TABLE = _byte_classes()
FEATURES = 256 + _CLASSES * _CLASSES + 7


def _repetition(text: str) -> tuple[float, float, float]:
    """Shares of distinct words, of words equal to the next, and of distinct lines."""
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    return len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines)


def features(texts) -> np.ndarray:
    """A row of FEATURES numbers for each text; all zero for an empty one."""
    texts = strings(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    scale = np.maximum(lengths, 1)[:, None]
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    kind = _TABLE[data].astype(np.int64)
    inside = row[1:] == row[:-1]
    pairs = np.bincount((row[:-1] * _CLASSES + kind[:-1])[inside] * _CLASSES + kind[1:][inside], minlength=n * _CLASSES**2).reshape(n, -1)
    words = counts[:, 32] + counts[:, 10] + (lengths > 0)
    rest = np.stack([np.log1p(lengths) / 10, lengths / np.maximum(words, 1) / 10, counts[:, 10] / scale[:, 0], (counts > 0).sum(1) / 100], 1)
    rest = np.concatenate([rest, np.array([_repetition(t) for t in texts.to_pylist()]).reshape(n, 3)], 1)
    return np.concatenate([np.log1p(100 * counts / scale), np.log1p(100 * pairs / scale), rest], 1).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """One hidden layer; a positive output speaks for label 1."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        def some(x):
            return (np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2).astype(np.float64)

        return np.concatenate([some(x[k : k + 1024]) for k in range(0, max(1, len(x)), 1024)])


@dataclass
class Model:
    """Networks whose mean output is calibrated to a probability."""

    networks: list
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * np.mean([n.raw(x) for n in self.networks], 0) + self.shift)


def risk(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the risk of outputs on positives and unlabelled rows, for the logistic losses
    softplus(-z) for label 1 and softplus(z) for label 0. The non-negative risk is first + max(0, second)."""
    return prior * float(np.logaddexp(0, -p).mean()), float(np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())


def risk_slope(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the risk in each output, positives first; where the negative part is below zero it overfits, and the
    step goes back along it alone."""
    a, b = _sigmoid(p), _sigmoid(u)
    if risk(p, u, prior)[1] >= 0:
        return np.concatenate([prior * ((a - 1) - a) / len(p), b / len(u)])
    return np.concatenate([prior * a / len(p), -b / len(u)])


def _moments(*sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the columns of all sets together, without a copy of them."""
    n = sum(map(len, sets))
    mean = sum(x.sum(0, dtype=np.float64) for x in sets) / n
    square = sum(((x[k : k + 1024] - mean) ** 2).sum(0) for x in sets for k in range(0, len(x), 1024)) / n
    return mean.astype(np.float32), (np.sqrt(square) + 0.05).astype(np.float32)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Network:
    """The network of least non-negative risk; without positives or unlabelled rows, one that gives the prior's logit."""
    rng = np.random.default_rng(seed)
    if not len(positive) or not len(unlabelled):
        zero = np.zeros(FEATURES, np.float32)
        return Network(zero, zero + 1, np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), float(np.log(prior / (1 - prior))))
    mean, spread = _moments(positive, unlabelled)
    m = Network(mean, spread, (rng.normal(size=(FEATURES, HIDDEN)) / FEATURES**0.5).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.normal(size=HIDDEN) / HIDDEN**0.5).astype(np.float32), 0.0)
    parts = [m.w1, m.b1, m.w2, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts], 0
    for _ in range(STEPS):
        x = np.concatenate([positive[rng.integers(len(positive), size=BATCH)], unlabelled[rng.integers(len(unlabelled), size=BATCH)]])
        x = (x - mean) / spread
        hidden = x @ parts[0] + parts[1]
        active = np.maximum(hidden, 0)
        z = active @ parts[2] + parts[3]
        slope = risk_slope(z[:BATCH], z[BATCH:], prior)
        back = np.outer(slope, parts[2]) * (hidden > 0)
        grads = [x.T @ back + DECAY * parts[0], back.sum(0), active.T @ slope, slope.sum(keepdims=True)]
        step += 1
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parts[k] = (parts[k] - 2e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    m.w1, m.b1, m.w2, m.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    return m


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from outputs on left-out positives and on the unlabelled rows.

    Of a share q of the positives above a threshold the unlabelled rows must hold at least prior * q, so the least ratio
    of the two shares bounds the prior, and meets it where no negative is above. Bounds on both shares keep the few rows
    above high thresholds from deciding.
    """
    if not len(p) or not len(u):
        return 0.5
    p, u = np.sort(p), np.sort(u)
    cut = np.quantile(p, np.linspace(0, 0.9, 181))
    above = lambda x: 1 - np.searchsorted(x, cut, "left") / len(x)
    slack = lambda n: np.sqrt(np.log(20) / (2 * n))
    bound = (above(u) + slack(len(u)) + slack(len(p))) / above(p)
    best = int(np.argmin(bound))
    return float(np.clip(above(u)[best] / above(p)[best], 0.01, 0.99))


def calibrate(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the outputs that minimise the unbiased risk -prior * E_P[z] + E_U[softplus(z)], by Newton steps."""
    if len(p) < 10 or len(u) < 10:
        return 1.0, 0.0
    center, width = u.mean(), u.std() + 1e-6
    rows = lambda x: np.stack([(x - center) / width, np.ones_like(x)], 1)
    pull, a = prior * rows(p).mean(0), rows(u)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        s = _sigmoid(a @ w)
        g = a.T @ s / len(a) - pull + 1e-3 * w * [1, 0]
        h = (a * (s * (1 - s))[:, None]).T @ a / len(a) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 1 / max(1e-9, np.abs(step).max()))
    if w[0] <= 0:  # higher must stay likelier
        return 1.0, 0.0
    return w[0] / width, w[1] - w[0] * center / width


def fit(x: np.ndarray, fold: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, float]:
    """A network for each learning fold, trained on positives without it, and the class prior; prior and calibration see
    only outputs on positives that were left out and on unlabelled rows."""
    first = LEARNING[0]
    trial = train(x[fold != first], unlabelled, 0.5, seed=-1 % 2**32)
    prior = estimate_prior(trial.raw(x[fold == first]), trial.raw(unlabelled))
    networks, z, u = [], np.zeros(len(x)), np.zeros(len(unlabelled))
    for k in LEARNING:
        out = fold == k
        network = train(x[~out], unlabelled, prior, seed=k)
        networks.append(network)
        z[out] = network.raw(x[out])
        u += network.raw(unlabelled) / len(LEARNING)
    return Model(networks, *calibrate(z, u, prior)), prior


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _share(n: int, most: int):
    """A condition by a hash of doc_id that some `most` of n rows meet."""
    share = 1_000_000 if n <= most else int(1_000_000 * most / n)
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1_000_000)) < share


def _collected(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and label of sampled rows (label, text); only numbers leave the tasks, and at most `most` rows of them."""
    def run(batches):
        for table in units(batches, most=UNIT):
            packed = pa.array([r.tobytes() for r in features(table["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([table["label"].combine_chunks(), packed], names=["label", "x"])

    found = rows.mapInArrow(run, "label int, x binary").limit(most).toArrow()
    x = np.empty((len(found), FEATURES), np.float32)
    at = 0
    for chunk in found["x"].chunks:
        for row in chunk:
            x[at] = np.frombuffer(row.as_buffer(), np.float32)
            at += 1
    return x, found["label"].to_numpy()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on docs and on the labels of the learning folds; the same tables always give the same model.

    Only labels of 1 outside the held-out fold are read; an id with several counts once for each. Without any the score
    of every text is that of an even prior.
    """
    prepare(docs.sparkSession)
    told = labels.where((F.col("quality") == 1) & (_fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", _fold(F.col("doc_id")).cast("int").alias("label"))
    rows = docs.select("doc_id", "text")
    bound = sample + sample // 10
    # The limit makes it safe to send the chosen labels, two numbers each, to all tasks.
    chosen = F.broadcast(told.where(_share(told.count(), sample)).limit(bound))
    x, fold = _collected(rows.join(chosen, "doc_id").select("label", "text"), bound)
    order = np.lexsort((*x.T[:8], x.sum(1)))
    x, fold = x[order], fold[order]
    u, _ = _collected(rows.where(_share(rows.count(), sample)).select(F.lit(0).alias("label"), "text"), bound)
    u = u[np.lexsort((*u.T[:8], u.sum(1)))]
    return fit(x, fold, u)[0]


def score(docs: DataFrame, model: Model, keep_row: bool = False) -> DataFrame:
    """doc_id (or, with keep_row, row: a struct of all columns) and score for every row; null texts count as empty."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights
    if keep_row:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    else:
        rows = docs.select("doc_id", "text")
    kept = "row" if keep_row else "doc_id"

    def run(batches):
        if keep_row:
            batches = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field("text")], names=["row", "text"]) for b in batches)
        for table in units(batches, most=UNIT):
            s = pa.array(sent.value.score(features(table["text"])))
            yield pa.RecordBatch.from_arrays([table[kept].combine_chunks(), s], names=[kept, "score"])

    return rows.mapInArrow(run, f"{kept} {rows.schema[kept].dataType.simpleString()}, score double" if not keep_row else T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep_row: bool = False) -> DataFrame:
    """doc_id (or row, with keep_row), held_out, score and predicted (1 from the threshold on) for every row of docs.

    Rows that repeat an id get a score each; a null id is in no held-out fold. An empty table gives no rows; without
    labels every text gets the score of an even prior. Columns besides doc_id and text do not matter, whatever their
    names.
    """
    scored = score(docs, learn(docs, labels), keep_row)
    doc_id = F.col("row.doc_id" if keep_row else "doc_id")
    held_out = F.coalesce(_fold(doc_id) == HELD_OUT, F.lit(False))
    return scored.select("row" if keep_row else "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
