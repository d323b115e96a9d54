"""A token model that obeys the tag scheme: a linear-chain conditional random field under BIO.

Sentences are scored, summed over and decoded many at once. Each value of the likelihood is one Spark job: every partition
adds up the slopes of its sentences, and Spark sums single cells. Only cells that are not 0 travel; there are
at most ``n_features * tags`` of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.runtime import drop_path, fresh_path

MAX_CELLS = 64_000_000
_CELLS = 1 << 15  # tokens of one batch, padding included
_NEVER = -1e30


def allowed(tags: Sequence[str]) -> np.ndarray:
    """``[previous, next]``, the last row being the start: ``I-x`` follows ``B-x`` or ``I-x`` only."""
    out = np.ones((len(tags) + 1, len(tags)), bool)
    for j, tag in enumerate(tags):
        if tag.startswith("I-"):
            out[:, j] = [p in (tag, "B-" + tag[2:]) for p in tags] + [False]
    return out


def _shape(token: str) -> str:
    out = []
    for c in token:
        s = "X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def features(tokens: pa.Array, sizes: np.ndarray, n_features: int) -> np.ndarray:
    """Five hashed features a token, as in the plain classifier: itself, its shape and ending, its neighbours' shapes."""
    coded = tokens.fill_null("").dictionary_encode()
    known = coded.dictionary.to_pylist()
    place = coded.indices.to_numpy().astype(np.int64)
    hashed = np.array([[zlib.crc32(f.encode()) % n_features for f in (f"w={t}", f"s={_shape(t)}", f"e={t[-3:]}", f"p={_shape(t)}", f"n={_shape(t)}")] for t in known] or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    out = hashed[place]
    ends = np.cumsum(sizes)
    first, last = (ends - sizes)[sizes > 0], (ends - 1)[sizes > 0]
    out[1:, 3], out[:-1, 4] = hashed[place[:-1], 3], hashed[place[1:], 4]
    out[first, 3], out[last, 4] = zlib.crc32(b"p=<s>") % n_features, zlib.crc32(b"n=</s>") % n_features
    return out


def _batches(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Sentences of like length together, in batches that are small when padded."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and n < most and (n + 1) * sizes[order[at + n]] <= _CELLS:
            n += 1
        yield order[at : at + n]
        at += n


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best paths of ``[sentence, place, tag]`` scores; ``steps`` holds transitions, the last row those from the start."""
    n, longest, k = scores.shape
    back = np.zeros((n, longest, k), np.int32)
    best = scores[:, 0] + steps[-1]
    for t in range(1, longest):
        reach = best[:, :, None] + steps[:-1][None]
        back[:, t] = reach.argmax(1)
        best = np.where((t < lengths)[:, None], reach.max(1) + scores[:, t], best)
    out = np.zeros((n, longest), np.int64)
    tag = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        out[:, t] = tag
        tag = np.where(t < lengths, back[np.arange(n), t, tag], tag)
    return out


def lawful(ids: np.ndarray, starts: np.ndarray, tags: Sequence[str]) -> np.ndarray:
    """Tag ids with ``I-x`` as ``B-x`` where it may not stand: the chunks are the same, and the scheme holds.

    Else a sentence that breaks the scheme would be an error that no step can mend.
    """
    begin = np.array([tags.index("B-" + t[2:]) if t.startswith("I-") else j for j, t in enumerate(tags)], np.int64)
    if not len(ids):
        return ids
    before = np.r_[len(tags), ids[:-1]]
    before[starts[starts < len(ids)]] = len(tags)
    return np.where(allowed(tags)[before, ids], ids, begin[ids])


@dataclass
class Tagger:
    tags: list[str]
    weights: np.ndarray  # [feature, tag]
    steps: np.ndarray  # [previous tag or start, tag]

    def decode(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best tags of padded sentences, the places of their tokens, and which of these are no padding."""
        place = starts[:, None] + np.arange(int(sizes.max()))
        real = np.arange(int(sizes.max())) < sizes[:, None]
        place = np.where(real, place, starts[:, None])
        scores = self.weights[rows[place]].sum(2)
        return viterbi(scores, sizes, np.where(allowed(self.tags), self.steps, _NEVER)), place, real


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _sums(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray):
    """As ``_log_sums``, by products of shares that are scaled at each place; None where a share is too small for that.

    One exponential a tag and place, where sums of logarithms take one for each pair of tags, three times over.
    """
    n, longest, k = scores.shape
    inside = np.arange(longest) < lengths[:, None]
    top = scores.max(2)
    shares = np.exp(scores - top[:, :, None])
    go, first = np.exp(steps[:-1]), np.exp(steps[-1])
    forward, scale = np.empty_like(scores), np.ones((n, longest))
    for t in range(longest):
        live = inside[:, t]
        reach = (first if t == 0 else forward[:, t - 1] @ go) * shares[:, t]
        total = reach.sum(1)
        if not np.all((total > 1e-200) & (total < 1e200), where=live):
            return None
        scale[live, t] = total[live]
        forward[:, t] = np.where(live[:, None], reach / scale[:, t, None], forward[:, t - 1] if t else reach)
    backward = np.ones_like(scores)
    edges = np.zeros_like(steps)
    for t in range(longest - 1, 0, -1):
        ahead = shares[:, t] * backward[:, t] / scale[:, t, None] * inside[:, t, None]
        edges[:-1] += forward[:, t - 1].T @ ahead
        backward[:, t - 1] = np.where(inside[:, t, None], ahead @ go.T, backward[:, t])
    if not np.isfinite(backward).all():
        return None
    nodes = forward * backward * inside[:, :, None]
    edges[:-1] *= go
    edges[-1] = nodes[:, 0].sum(0)
    return np.log(scale).sum(1) + (top * inside).sum(1), nodes, edges


def _log_sums(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray):
    """Logarithm of the sum over all paths of each sentence, shares of tags at places, and of steps."""
    n, longest, k = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + steps[-1]
    inside = np.arange(longest) < lengths[:, None]
    for t in range(1, longest):
        reach = _log_sum(forward[:, t - 1, :, None] + steps[None, :-1], 1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], reach, forward[:, t - 1])
    for t in range(longest - 1, 0, -1):
        reach = _log_sum(steps[None, :-1] + (scores[:, t] + backward[:, t])[:, None, :], 2)
        backward[:, t - 1] = np.where(inside[:, t, None], reach, backward[:, t])
    total = _log_sum(forward[:, -1], 1)
    nodes = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    edges = np.zeros_like(steps)
    edges[-1] = nodes[:, 0].sum(0)
    for t in range(1, longest):
        both = forward[:, t - 1, :, None] + steps[None, :-1] + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        edges[:-1] += (np.exp(both) * inside[:, t, None, None]).sum(0)
    return total, nodes, edges


def likelihood(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, gold: np.ndarray):
    """Negative log-likelihood of the gold paths, with its slopes: ``[sentence, place, tag]`` and as ``steps``."""
    n, longest, k = scores.shape
    inside = np.arange(longest) < lengths[:, None]
    found = _sums(scores, lengths, steps)
    total, nodes, edges = _log_sums(scores, lengths, steps) if found is None else found
    before = np.concatenate([np.full((n, 1), k), gold[:, :-1]], 1)
    row, place = np.nonzero(inside)
    true, prior = gold[inside], before[inside]
    loss = total.sum() - scores[row, place, true].sum() - steps[prior, true].sum()
    nodes[row, place, true] -= 1
    np.add.at(edges, (prior, true), -1.0)
    return loss, nodes, edges


def _prepared(n_features: int, tags: Sequence[str]):
    """For ``mapInArrow``: (words, tag ids) to hashed features, five a word, and lawful tag ids."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
            rows = features(batch.column(0).flatten(), sizes, n_features)
            truth = lawful(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes, tags)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = [pa.ListArray.from_arrays(pa.array((ends * k).astype(np.int32)), pa.array(v.ravel().astype(np.int32))) for k, v in ((5, rows), (1, truth))]
            yield pa.RecordBatch.from_arrays(lists, names=["features", "gold"])

    return run


def _slopes(tagger):
    """For ``mapInArrow``: loss and slopes of a partition, one row a cell; cell -1 is the loss, -2 the sentences."""

    def run(batches):
        model = tagger.value
        legal = allowed(model.tags)
        steps = np.where(legal, model.steps, _NEVER)
        size, k = model.weights.shape
        slope, edge, loss, seen = np.zeros((k, size)), np.zeros_like(model.steps), 0.0, 0
        for batch in batches:
            gold = batch.column(1)
            sizes = np.diff(gold.offsets.to_numpy()).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            rows, truth = batch.column(0).flatten().to_numpy().reshape(-1, 5), gold.flatten().to_numpy()
            for some in _batches(sizes, 512):
                real = np.arange(int(sizes[some].max())) < sizes[some][:, None]
                place = np.where(real, starts[some][:, None] + np.arange(real.shape[1]), starts[some][:, None])
                part, nodes, edges = likelihood(model.weights[rows[place]].sum(2), sizes[some], steps, truth[place])
                loss, seen = loss + part, seen + len(some)
                edge += np.where(legal, edges, 0.0)
                flat, change = rows[place[real]].ravel(), nodes[real]
                for j in range(k):
                    slope[j] += np.bincount(flat, np.repeat(change[:, j], rows.shape[1]), size)
        if seen:
            whole = np.concatenate([slope.T.ravel(), edge.ravel()])
            cells = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, cells]), pa.array(np.r_[loss, float(seen), whole[cells]])], names=["cell", "value"])

    return run


def _lbfgs(evaluate, x: np.ndarray, max_iter: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving; ``evaluate`` gives value and slope."""
    value, slope = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        way, kept = slope.copy(), []
        for s, y, r in reversed(pairs):
            a = r * s.dot(way)
            way -= a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            way *= s.dot(y) / y.dot(y)
        else:
            way /= max(1.0, np.linalg.norm(slope))
        for (s, y, r), a in zip(pairs, reversed(kept)):
            way += s * (a - r * y.dot(way))
        step, fall = 1.0, slope.dot(way)
        while True:
            new_value, new_slope = evaluate(x - step * way)
            if new_value <= value - 1e-4 * step * fall or step < 1e-6:
                break
            step /= 2
        if new_value >= value:
            break
        s, y = -step * way, new_slope - slope
        if s.dot(y) > 1e-12:
            pairs = [*pairs, (s, y, 1 / s.dot(y))][-memory:]
        done = value - new_value < tolerance * abs(value)
        x, value, slope = x + s, new_value, new_slope
        if done:
            break
    return x


def fit_tagger(
    sentences: DataFrame, tags: Sequence[str], tokens_col: str = "tokens", tags_col: str = "ner_tags",
    max_iter: int = 20, n_features: int = 1 << 15, penalty: float = 1.0,
) -> Tagger:
    """Fit on sentences of words and tag ids; sentences without words, and those with a NULL id, teach nothing.

    A type that has an ``I-`` tag alone gets its ``B-`` tag, behind the given ones. Features are hashed
    once and staged; ``penalty`` weighs half the squared weights.
    """
    tags = list(tags)
    tags += sorted({"B-" + t[2:] for t in tags if t.startswith("I-")} - set(tags))
    if n_features * max(len(tags), 1) > MAX_CELLS:
        raise ValueError(f"{n_features} features of {len(tags)} tags are too many to send to tasks")
    spark = sentences.sparkSession
    context = spark.sparkContext
    rows = sentences.select(tokens_col, F.col(tags_col).cast("array<int>").alias(tags_col)).filter(
        (F.size(tokens_col) > 0) & (F.size(tokens_col) == F.size(tags_col)) & ~F.exists(tags_col, lambda i: i.isNull())
    )
    path = fresh_path(spark, "features")
    # Read once for each value of the likelihood, so dealt out evenly first.
    even = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    even.mapInArrow(_prepared(n_features, tags), "features array<int>, gold array<int>").write.parquet(path)
    shape, cells = (n_features, len(tags)), n_features * len(tags)

    def model_of(x: np.ndarray) -> Tagger:
        return Tagger(tags, x[:cells].reshape(shape), x[cells:].reshape(len(tags) + 1, len(tags)))

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(model_of(x))
        found = spark.read.parquet(path).mapInArrow(_slopes(sent), "cell long, value double")
        sums = found.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        sent.destroy()
        own = sums[sums["cell"] >= 0]
        slope = penalty * x
        slope[own["cell"].to_numpy()] += own["value"].to_numpy()
        n = max(sums.loc[sums["cell"] == -2, "value"].sum(), 1.0)
        return (sums.loc[sums["cell"] == -1, "value"].sum() + penalty / 2 * x.dot(x)) / n, slope / n

    fitted = model_of(_lbfgs(evaluate, np.zeros(cells + (len(tags) + 1) * len(tags)), max_iter))
    drop_path(spark, path)
    return fitted


def predict_tags(tagger: Tagger, sentences: DataFrame, tokens_col: str = "tokens", out: str = "pred") -> DataFrame:
    """Add the best tag sequence that the scheme allows; a NULL list of words counts as empty."""
    sent = sentences.sparkSession.sparkContext.broadcast(tagger)

    @F.arrow_udf("array<string>")
    def best(words: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        model = sent.value
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        rows = features(words.flatten(), sizes, len(model.weights))
        found = np.zeros(int(sizes.sum()), np.int64)
        for some in _batches(sizes, 1024):
            guess, place, real = model.decode(rows, starts[some], sizes[some])
            found[place[real]] = guess[real]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(model.tags, pa.string()).take(pa.array(found)))

    return sentences.withColumn(out, best(F.col(tokens_col)))
