"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < .. < K-1 share one weight vector over sparse text features; thresholds
t_1 < .. < t_{K-1} turn the linear score s into P(grade >= k) = logistic(s - t_k).  Expected
severity is the sum of these over k.  Thresholds are kept in order by fitting the first and the
logarithms of the gaps.  Features are a text's distinct words (letters and digits, lower case),
hashed, with weight 1 + log(count), over the fourth root of the number of distinct words.  Words
in fewer than `RARE` training rows have no weight, as they could only be learnt by heart.

Grades may be any ordered integers in the label column.  Where labels only say toxic or not,
`grades_from_binary` spreads toxic rows over three grades: words that are over-represented in
toxic rows of the sample (log-odds, smoothed) mark a row, and the terciles of the marked share
of its words are grades 1, 2 and 3; the others are grade 0.

Training uses at most `SAMPLE` labelled rows, those whose identifiers hash lowest, in one task;
the model has a fixed size.

Defined results: a null or empty text has no features and gets the severity of the thresholds
alone.  Null labels are no labels.  With no labelled rows every severity is 0.  Repeated rows are
scored alike.  Identifiers may be null.  Other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, features
from .quality import Rows, sample

SAMPLE = 40_000
BITS = 18
EPOCHS = 8
RARE = 8
#: P(grade >= 1) at which a document is called toxic.
TOXIC = 0.4


def row(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    h, c = features.hashed(features.tokens(raw or b""))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (1 + np.log(np.maximum(c, 1))) * 2 / max(1, len(h)) ** 0.25


def grades_from_binary(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grade 0 for rows that are not toxic, 1 to 3 for the others by the share of marked words."""
    out = np.zeros(len(rows), np.int64)
    if not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    n = [np.bincount(np.concatenate([i for (i, _), t in zip(rows, toxic, strict=True) if t == k] or [np.zeros(0, np.int64)]), minlength=1 << BITS) for k in (0, 1)]
    odds = np.log((n[1] + 0.5) / (toxic.sum() + 1)) - np.log((n[0] + 0.5) / (len(rows) - toxic.sum() + 1))
    marked = (odds > 2.5) & (n[1] >= 5)
    share = np.array([x[marked[i]].sum() for i, x in rows])
    cuts = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    out[toxic == 1] = 1 + (share[toxic == 1][:, None] > cuts).sum(axis=1)
    return out


class Ordinal:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, rows: Rows) -> np.ndarray:
        """P(grade >= k) for each row and threshold."""
        s = np.zeros(len(rows.n))
        full = rows.n > 0
        if full.any():
            s[full] = np.add.reduceat(self.weights[rows.i] * rows.x, rows.at[full])
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -30, 30)))

    def dump(self) -> bytes:
        return np.int64(len(self.thresholds)).tobytes() + self.thresholds.astype(np.float64).tobytes() + self.weights.astype(np.float32).tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Ordinal:
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        return cls(np.frombuffer(blob, np.float32, -1, 8 + 8 * k), np.frombuffer(blob, np.float64, k, 8))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, seed: int = 11, rate: float = 0.2, decay: float = 3e-4) -> Ordinal:
    """AdaGrad on the likelihood of the observed grades."""
    rng, weights = np.random.default_rng(seed), np.zeros(1 << BITS)
    k = int(grades.max()) if len(grades) else 0
    if not k:
        return Ordinal(weights, np.array([30.0]))
    common_words = np.bincount(np.concatenate([i for i, _ in rows]), minlength=1 << BITS) >= RARE
    rows = [(i[common_words[i]], x[common_words[i]]) for i, x in rows]
    above = np.array([(grades >= j).mean() for j in range(1, k + 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - above) / above)
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])  # first, log gaps
    seen, seen_raw = np.full(1 << BITS, 1e-3), np.full(k, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            batch, y = Rows([rows[i] for i in pick]), grades[pick]
            t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            p = Ordinal(weights, t).at_least(batch)
            whole = np.hstack([np.ones((len(y), 1)), p, np.zeros((len(y), 1))])
            like = np.maximum(whole[np.arange(len(y)), y] - whole[np.arange(len(y)), y + 1], 1e-9)
            slope = np.hstack([np.zeros((len(y), 1)), p * (1 - p), np.zeros((len(y), 1))])
            low, high = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
            g = -(low - high) / like / 4  # by the linear score
            gt = np.zeros((len(y), k + 2))
            gt[np.arange(len(y)), y] += low / like / 4
            gt[np.arange(len(y)), y + 1] -= high / like / 4
            gt = gt[:, 1:-1].sum(axis=0)
            gr = np.array([gt.sum(), *(gt[j:].sum() * np.exp(raw[j]) for j in range(1, k))])
            by = np.argsort(batch.i, kind="stable")
            where, start = np.unique(batch.i[by], return_index=True)
            if len(where):
                grad = np.add.reduceat((np.repeat(g, batch.n) * batch.x)[by], start) + decay * weights[where]
                seen[where] += grad**2
                weights[where] -= rate * grad / np.sqrt(seen[where])
            seen_raw += gr**2
            raw -= 0.1 * gr / np.sqrt(seen_raw)
    return Ordinal(weights, np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))]))


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id", most: int = SAMPLE) -> bytes:
    """A model from the labelled rows; a label of two values is spread over grades first."""
    common.ship(docs.sparkSession)
    # the sample is bounded by `most`, so its identifiers may be broadcast
    chosen = F.broadcast(sample(labels, label_id, label, None, most))
    rows = docs.select(F.col(ident).cast("long").alias("_key"), F.col(text).cast("binary").alias("t")).join(chosen, "_key").select("_key", "t", "_y")

    def cook(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [row(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["k", "y", "i", "x"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, i, x, y) for b in batches for k, y, i, x in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
        made = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x)) for _, i, x, _ in got]
        y = np.array([y for *_, y in got]).astype(np.int64)
        grades = grades_from_binary(made, y) if len(y) and set(y) <= {0, 1} else np.searchsorted(np.unique(y), y)
        yield pa.record_batch([pa.array([fit(made, grades).dump()], pa.binary())], names=["model"])

    got = rows.mapInArrow(cook, "k long, y double, i binary, x binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return got[0].model if got else fit([], np.zeros(0)).dump()


def score(docs: DataFrame, model: bytes, text: str = "text", toxic: float = TOXIC, keep_text: bool = True) -> DataFrame:
    """docs with expected_severity, grade (the likeliest) and toxic."""
    spark = docs.sparkSession
    common.ship(spark)
    new = ("expected_severity", "grade", "toxic")
    carried = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    slim = docs.select(*[F.col(common.quoted(c)) for c in carried], F.col(text).cast("binary").alias(common.fresh(carried, "raw")))
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ordinal.load(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                if not b.num_rows:
                    continue
                p = m.at_least(Rows([row(t.as_py()) for t in b.column(b.num_columns - 1)]))
                steps = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]), axis=1)
                made = [pa.array(p.sum(axis=1)), pa.array(steps.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= toxic)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*carried, *new])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "expected_severity double, grade int, toxic boolean"])
    return common.plain(slim).mapInArrow(work, schema)
