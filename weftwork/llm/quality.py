"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct hashed words (each with weight 1 / sqrt(their number)), one
indicator per statistic (the bin, by quantiles of the training rows, of sizes, byte classes,
repetition and line shape), and for each metadata column that is named one hashed word of its name
and value.  The registered query names none, as its contract bars them.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

through the logistic function; the bracket makes the pairwise part linear in the features.
Training is AdaGrad on the logistic loss over a sample of at most `SAMPLE` labelled rows, those
whose identifiers hash lowest, in one task; the model is one array of fixed size.  Labels,
language, source and identifier are no inputs of a score.

Defined results: a null text counts as empty and gets the score that its statistics give.  Rows
without a label play no part in training; a null label is no label.  With no labelled rows every
score is 0.5.  Repeated rows are scored alike.  Other columns are carried by `classify`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, features

SAMPLE = 20_000
BITS = 16
FACTORS = 8
BINS = 16
EPOCHS = 4
#: At or above this score a document is good.
GOOD = 0.7
_S = len(features.STATS)


class Rows:
    """Sparse rows: places, values, and where each row begins."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(i) for i, _ in rows])
        self.at = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.i = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.x = np.concatenate([x for _, x in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)


def words_and_statistics(raw: bytes | None, meta: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    raw = raw or b""
    h, c = features.hashed(features.tokens(raw))
    stats = features.statistics(raw, h, c)
    if meta:
        h = np.concatenate([h, features.hashed([m.encode() for m in meta if m is not None])[0]])
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64), stats


def _meta(metadata: Sequence[str]) -> Column:
    """name=value of the metadata columns of a row, which no word of a text can equal; nulls are left out."""
    pairs = [F.concat(F.lit(f"{m}="), F.col(common.quoted(m)).cast("string")) for m in metadata]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")


class Machine:
    """w0, then one row of [w, v_1 .. v_k] for each hashed word and each bin of each statistic."""

    def __init__(self, edges: np.ndarray, table: np.ndarray, bias: float):
        self.edges, self.table, self.bias = edges, table, bias

    def row(self, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (self.edges <= stats[:, None]).sum(axis=1) + np.arange(_S) * BINS + (1 << BITS)
        return np.concatenate([words, bins]), np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.full(_S, 1 / np.sqrt(_S))])

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of the factors."""
        got = self.table[rows.i] * rows.x[:, None]
        sums = np.add.reduceat(got, rows.at, axis=0)
        squares = np.add.reduceat((got[:, 1:] ** 2).sum(axis=1), rows.at)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums[:, 1:]

    def scores(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not made:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(Rows([self.row(*m) for m in made]))[0], -30, 30).astype(np.float64)))

    def dump(self) -> bytes:
        return np.float64(self.bias).tobytes() + self.edges.astype(np.float64).tobytes() + self.table.astype(np.float32).tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Machine:
        e = _S * (BINS - 1)
        return cls(np.frombuffer(blob, np.float64, e, 8).reshape(_S, BINS - 1), np.frombuffer(blob, np.float32, -1, 8 + 8 * e).reshape(-1, 1 + FACTORS), float(np.frombuffer(blob, np.float64, 1)[0]))


def fit(made: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, rate: float = 0.15, decay: float = 1e-5) -> Machine:
    rng = np.random.default_rng(seed)
    table = np.zeros(((1 << BITS) + _S * BINS, 1 + FACTORS), np.float32)
    if not len(made):
        return Machine(np.zeros((_S, BINS - 1)), table, 0.0)
    table[:, 1:] = rng.normal(0, 0.02, (len(table), FACTORS))
    stats = np.array([s for _, s in made])
    machine = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy(), table, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))
    seen, seen_bias = np.full(table.shape, 1e-3, np.float32), 1e-3
    rows = [machine.row(*m) for m in made]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            batch = Rows([rows[i] for i in pick])
            z, sums = machine.raw(batch)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]).astype(np.float32) / np.float32(len(pick)) * 32
            each = np.repeat(g, batch.n) * batch.x
            grad = np.empty((len(batch.i), 1 + FACTORS), np.float32)
            grad[:, 0] = each
            grad[:, 1:] = each[:, None] * (np.repeat(sums, batch.n, axis=0) - table[batch.i, 1:] * batch.x[:, None])
            by = np.argsort(batch.i, kind="stable")
            where, first = np.unique(batch.i[by], return_index=True)
            total = np.add.reduceat(grad[by], first, axis=0) + decay * table[where]
            seen[where] += total**2
            table[where] -= rate * total / np.sqrt(seen[where])
            seen_bias += float(g.sum()) ** 2
            machine.bias -= rate * float(g.sum()) / np.sqrt(seen_bias)
    return machine


def sample(labels: DataFrame, ident: str, label: str, allowed: Column | None, most: int) -> DataFrame:
    """At most `most` labelled identifiers: _key, _y; those that hash lowest."""
    found = labels.select(F.col(ident).cast("long").alias("_key"), F.col(label).cast("double").alias("_y")).where("_key is not null and _y is not null")
    if allowed is not None:
        found = found.where(allowed)
    return found.orderBy(F.xxhash64("_key"), "_key", "_y").limit(most)


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", allowed: Column | None = None, most: int = SAMPLE, metadata: Sequence[str] = ()) -> bytes:
    """A model from the labelled rows; `allowed` is a condition on _key, the labelled identifier; metadata names columns of docs."""
    common.ship(docs.sparkSession)
    # the sample is bounded by `most`, so its identifiers may be broadcast
    chosen = F.broadcast(sample(labels, label_id, label, allowed, most))
    rows = docs.select(F.col(ident).cast("long").alias("_key"), F.col(text).cast("binary").alias("t"), _meta(metadata).alias("m")).join(chosen, "_key").select("_key", "t", "_y", "m")

    def cook(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [words_and_statistics(t.as_py(), m) for t, m in zip(b.column(1), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([w.astype(np.int32).tobytes() for w, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())], names=["k", "y", "w", "s"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, w, s, y) for b in batches for k, y, w, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        made = [(np.frombuffer(w, np.int32).astype(np.int64), np.frombuffer(s)) for _, w, s, _ in got]
        yield pa.record_batch([pa.array([fit(made, np.array([y for *_, y in got])).dump()], pa.binary())], names=["model"])

    cooked = rows.mapInArrow(cook, "k long, y double, w binary, s binary")
    got = cooked.repartition(1).mapInArrow(learn, "model binary").collect()
    return got[0].model if got else fit([], np.zeros(0)).dump()


def classify(docs: DataFrame, model: bytes, text: str = "text", good: float = GOOD, keep_text: bool = True, metadata: Sequence[str] = ()) -> DataFrame:
    """docs with score and predicted."""
    spark = docs.sparkSession
    common.ship(spark)
    carried = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    slim = docs.select(*[F.col(common.quoted(c)) for c in carried], F.col(text).cast("binary").alias(common.fresh(carried, "raw")), _meta(metadata).alias(common.fresh(carried, "meta")))
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                s = machine.scores([words_and_statistics(t.as_py(), m) for t, m in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(s), pa.array((s >= good).astype(np.int32))], names=[*carried, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "score double, predicted int"])
    return common.plain(slim).mapInArrow(work, schema)


def keep_good(docs: DataFrame, model: bytes, text: str = "text", good: float = GOOD) -> DataFrame:
    """The rows of docs that score `good` or better, with all their columns as they are."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), docs.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                raw = [None if t is None else t.encode() for t in b.column(at).to_pylist()]
                b = pa.RecordBatch.from_arrays(b.columns, names=names)
                yield b.filter(pa.array(machine.scores([words_and_statistics(t) for t in raw]) >= good, pa.bool_()))

    return common.plain(docs).mapInArrow(work, docs.schema)
