"""Text quality by a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)):
all pairs of features meet through their low-rank factors, in time linear in the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.columns import Aside
from notemill.llm.words import text_slices, word_hashes, words

#: At most so many labelled rows are fitted, those whose hashed id is smallest.
FIT_ROWS = 6000
BUCKETS = 1 << 15
RANK = 8

_CLASSES = np.full(256, 8, np.int64)
for _i, _set in enumerate(
    (range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b"!?", b"#$%&*@^~+=<>{}[]\\/_", b"|", ()),
):
    _CLASSES[list(_set)] = _i
_CLASSES[128:] = 9
_N_CLASSES = 10
N_DENSE = _N_CLASSES + 8


@dataclass
class Model:
    w0: float
    w: np.ndarray  # buckets + dense
    v: np.ndarray  # (buckets + dense) x rank
    mean: np.ndarray
    std: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text (count, bucket, value of unit length) and its statistics."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, lengths, counts = words(data, offsets)
    text_of = np.repeat(np.arange(n), counts)
    hashed = word_hashes(data, starts, lengths, lower=False)
    cells, times = np.unique(text_of.astype(np.int64) * BUCKETS + (hashed % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = cells // BUCKETS, cells % BUCKETS
    value = 1 + np.log(times)
    distinct = np.bincount(row, minlength=n)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / np.maximum(norm, 1e-9)[row]
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES)
    shares = kinds.reshape(n, _N_CLASSES) / np.maximum(sizes, 1)[:, None]
    total = np.maximum(counts, 1)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    long_words = np.bincount(text_of, lengths > 12, minlength=n)
    last = data[starts + lengths - 1] if len(starts) else data[:0]
    ends = np.bincount(text_of, (last < 48) & (last > 32), minlength=n)
    odd = np.bincount(text_of, _CLASSES[last] >= 5, minlength=n)
    dense = np.column_stack([
        shares, np.log1p(sizes), np.log1p(counts), (sizes - kinds.reshape(n, -1)[:, 3]) / total, distinct / total,
        most / total, long_words / total, ends / total, odd / total,
    ])
    return distinct, bucket, value, dense


def _scaled(model: Model, dense: np.ndarray) -> np.ndarray:
    return np.clip((dense - model.mean) / model.std, -5, 5) * 0.5


def _sums(rows: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Sum of consecutive rows for each text, in their order."""
    out = np.zeros((len(distinct), rows.shape[1]))
    full = np.flatnonzero(distinct)
    if len(full):
        out[full] = np.add.reduceat(rows, (np.cumsum(distinct) - distinct)[full], axis=0)
    return out


def logits(model: Model, distinct, bucket, value, dense) -> np.ndarray:
    x = _scaled(model, dense)
    ww, vw = model.w[:BUCKETS], model.v[:BUCKETS]
    wd, vd = model.w[BUCKETS:], model.v[BUCKETS:]
    taken = vw[bucket] * value[:, None]
    linear = _sums((ww[bucket] * value)[:, None], distinct)[:, 0] + (x * wd).sum(axis=1)
    first = _sums(taken, distinct) + (x[:, :, None] * vd[None]).sum(axis=1)
    second = _sums(taken * taken, distinct) + ((x * x)[:, :, None] * (vd * vd)[None]).sum(axis=1)
    return model.w0 + linear + 0.5 * (first * first - second).sum(axis=1)


def fit(parts: list, labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Model:
    """Fit on rows given as (bucket, value, dense) each, by AdaGrad on single small batches."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + N_DENSE
    dense = np.array([p[2] for p in parts]).reshape(len(parts), N_DENSE)
    mean = dense.mean(axis=0) if len(parts) else np.zeros(N_DENSE)
    std = dense.std(axis=0) if len(parts) else np.ones(N_DENSE)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), mean, np.where(std > 1e-9, std, 1.0))
    if not len(parts):
        model.v[:] = 0
        return model
    rate_of = np.clip(labels.mean(), 0.01, 0.99)
    model.w0 = float(np.log(rate_of / (1 - rate_of)))
    x = _scaled(model, dense)
    tail = np.arange(BUCKETS, size)
    gw, gv = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // 16)):
            index = [np.concatenate([parts[i][0], tail]) for i in batch]
            value = [np.concatenate([parts[i][1], x[i]]) for i in batch]
            place = np.repeat(np.arange(len(batch)), [len(i) for i in index])
            at, val = np.concatenate(index), np.concatenate(value)
            edge = np.cumsum([0, *[len(i) for i in index[:-1]]])
            vx = model.v[at] * val[:, None]
            first = np.add.reduceat(vx, edge, axis=0)
            z = model.w0 + np.add.reduceat(model.w[at] * val, edge)
            z += 0.5 * (first * first - np.add.reduceat(vx * vx, edge, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            model.w0 -= rate * error.sum()
            e = error[place] * val
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e, minlength=len(used)) + decay * model.w[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, back, e[:, None] * (first[place] - vx))
            dv += decay * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is kept from the fit: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows: int = FIT_ROWS,
) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out.

    They are those whose hashed id is smallest. Rows without an id or label teach
    nothing; of several labels of an id the largest counts, of several texts the first
    by value. Without any labelled document all scores are 0.5.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    joined = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__id", "__label", "__text")

    def rows_of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, marks = batch.column(0), batch.column(1)
            for start, end, data, offsets in text_slices(batch.column(2)):
                distinct, bucket, value, dense = features(data, offsets)
                edges = np.concatenate([[0], np.cumsum(distinct)])
                n = end - start
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, n), marks.slice(start, n),
                        pa.array([bucket[edges[i] : edges[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary()),
                        pa.array([value[edges[i] : edges[i + 1]].astype(np.float64).tobytes() for i in range(n)], pa.binary()),
                        pa.array([dense[i].tobytes() for i in range(n)], pa.binary()),
                    ],
                    names=["id", "label", "bucket", "value", "dense"],
                )

    kind = dict(joined.dtypes)["__id"]
    found = joined.mapInArrow(rows_of, f"id {kind}, label int, bucket binary, value binary, dense binary")
    first = found.groupBy("id", "label").agg(F.min(F.struct("bucket", "dense", "value")).alias("x"))
    # One row an id, however many rows share it.
    ordered = sorted(first.select("id", "label", "x.*").collect(), key=lambda r: r["id"])
    parts = [
        (np.frombuffer(r["bucket"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float64), np.frombuffer(r["dense"], np.float64))
        for r in ordered
    ]
    return fit(parts, np.array([r["label"] for r in ordered], float))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score`` in (0, 1) to every row; a column of that name, in any letter case, gives way.

    Every word of every text counts. A null text scores as an empty one, by its
    statistics alone; equal texts get equal scores. No rows give no rows.
    """
    aside = Aside(docs, score_col)
    carried = aside.working
    rows = docs.select(*aside.take, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + N_DENSE) x (RANK + 1) numbers

    def scored(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, end, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                z = logits(shared.value, *features(data, offsets))
                out[start:end] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out)], names=[*carried, "__score"])

    schema = T.StructType([*aside.fields, T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(scored, schema).select(*aside.give, F.col("__score").alias(score_col))
