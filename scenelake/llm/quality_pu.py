"""Quality classifier learnt from positives and unlabelled text.

Trusted positives are the labelled good documents; all documents, whatever their label, are the unlabelled text. A logistic score over piecewise
linear text measures minimises the non-negative unbiased risk

    pi * R+(g) + max(0, Ru-(g) - pi * R+-(g)),

where pi, the share of good documents among the unlabelled, is estimated from the scores: where a first model sees
only good text, positives and unlabelled differ by the factor pi alone. Only the labelled rows are a bounded sample: every
step of the fit is one pass over the measures of all documents, whose sums (not rows) come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import held_out
from scenelake.session import cut_lineage

#: Labelled rows that the model is fitted on at most: those of least hash.
SAMPLE = 12_000
#: Passes over all measures that one descent makes at most; some eight are made.
STEPS = 40
#: Slices that what all tasks have summed is added up in, each by one task.
SLICES = 32
#: Weight of the squared weights in the risk.
RIDGE = 3e-3
#: Width over which the clamp of the risk's negative part is rounded off.
BEND = 0.01
#: What the estimated share of good documents is held within.
PRIOR_RANGE = (0.05, 0.98)
KNOTS = 8
#: Score from which a document counts as good.
CUT = 0.7

MEASURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "symbols", "bangs", "pipes", "digits", "stops", "commas", "lines", "distinct",
    "repeats", "top_word", "long_words", "deflate", "cut_words", "other_bytes",
)

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&<>{}[]=_@^~\\/"
_DIGITS = b"0123456789"
_STOP = b".!?"
_PLAIN = re.compile(rb"[a-z\x80-\xff]+")


def text_measures(data: bytes) -> list[float]:
    """The measures of one text, each a share or a logarithm; all 0 for the empty text."""
    n = len(data)
    words = data.split()
    if not words:
        return [0.0] * len(MEASURES)
    k = len(words)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    low = data.lower().split()
    count = Counter(low)
    body = sum(map(len, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        body / k,
        share(_UPPER),
        share(_SYMBOLS),
        data.count(b"!") / k,
        data.count(b"|") / k,
        share(_DIGITS),
        share(_STOP) * n / k,
        data.count(b",") / k,
        data.count(b"\n") / k,
        len(count) / k**0.9,
        sum(map(bytes.__eq__, low, low[1:])) / k,
        max(count.values()) / k,
        sum(1 for w in words if len(w) > 20) / k,
        len(zlib.compress(data, 1)) / n,
        sum(1 for w in words if not _PLAIN.match(w)) / k,
        (n - len(_PLAIN.sub(b"", data))) / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, m (the measures) of every whole text; null texts are empty. Nothing but the text is an input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_measures(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "m"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, m array<float>")


class Model:
    """Knots of the measures, weights and prior; small enough to travel with a task."""

    def __init__(self, knots: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.knots, self.scale, self.weights, self.prior = knots, scale, weights, prior

    @staticmethod
    def basis(m: np.ndarray, knots: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """One, and for each measure the part of it between each pair of neighbouring knots, in 0..1."""
        steps = [np.clip((m[:, j, None] - knots[j, :-1]) / scale[j], 0, 1) for j in range(m.shape[1])]
        return np.concatenate([np.ones((len(m), 1)), *steps], axis=1)

    def score(self, m: np.ndarray) -> np.ndarray:
        z = self.basis(np.asarray(m, float).reshape(-1, len(MEASURES)), self.knots, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def negative_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, loss as negatives, its gradient and its second derivative, each summed over the rows of ``x``, in one array."""
    z = x @ w.astype(x.dtype)
    s = _sigmoid(z)
    hess = x.T @ (x * (s * (1 - s))[:, None])
    return np.concatenate([[len(x), np.logaddexp(0, z).sum(dtype=float)], x.T @ s, hess.ravel()]).astype(float)


class Descent:
    """Newton steps down the non-negative risk, one for each sum over the unlabelled text; a step that does not help is cut.

    With the logistic loss both parts of the risk are convex; the clamp at zero is rounded off over BEND, so that the steps do
    not stick at its edge.
    """

    def __init__(self, pos: np.ndarray, prior: float, start: np.ndarray, ridge: float = RIDGE, close: float = 1e-6):
        self.pos, self.prior, self.ridge, self.close = pos, prior, ridge, close
        self.weights = self.offered = start.astype(float)
        self.risk, self.done, self.length = np.inf, False, 1.0

    def take(self, sums: np.ndarray) -> None:
        """Judge the offered weights by ``negative_sums`` of all unlabelled rows for them, and offer the next ones."""
        w, d, n = self.offered, len(self.weights), sums[0]
        if not n:
            self.done = True
            return
        z = self.pos @ w.astype(self.pos.dtype)
        negative = sums[1] / n - self.prior * np.logaddexp(0, z).mean(dtype=float)
        clamped = BEND * np.logaddexp(0, negative / BEND)
        risk = self.prior * np.logaddexp(0, -z).mean(dtype=float) + clamped + self.ridge / 2 * w @ w
        gain = self.risk - risk
        if gain > 0:
            self.weights, self.risk, self.length = w, risk, min(1.0, 4 * self.length)
            own = negative_sums(self.pos, w) / len(self.pos)
            down = sums[2 : 2 + d] / n - self.prior * own[2 : 2 + d]  # of the clamped part
            share = float(_sigmoid(negative / BEND))  # how much of it counts
            up = self.prior * (own[2 : 2 + d] - self.pos.mean(axis=0, dtype=float))
            second = self.prior * (1 - share) * own[2 + d :] + share * sums[2 + d :] / n
            second = second.reshape(d, d) + share * (1 - share) / BEND * np.outer(down, down)
            self.step = -np.linalg.solve(second + self.ridge * np.eye(d), up + share * down + self.ridge * w)
            self.done = gain < self.close
        else:
            self.length /= 4
            self.done = self.length < 1e-3
        self.offered = self.weights + self.length * self.step


class Unlabelled:
    """All rows of a table of measures: what the fit must know of them, each a sum over tasks, in a fixed order."""

    def __init__(self, table: DataFrame):
        self.rows = table.select("m", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))

    def histograms(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values (to eight bits after the first) and counts of each measure: a bounded number, whatever the table's size."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Counter() for _ in MEASURES]
            for batch in batches:
                m = _matrix(batch).astype(np.float32)
                coarse = (np.ascontiguousarray(m).view(np.uint32) & np.uint32(0xFFFF8000)).view(np.float32)
                for j, count in enumerate(held):
                    values, n = np.unique(coarse[:, j], return_counts=True)
                    count.update(dict(zip(values.tolist(), n.tolist())))
            rows = [(j, v, n) for j, count in enumerate(held) for v, n in count.items()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["j", "v", "n"])

        counted = self.rows.mapInArrow(run, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n")).collect()
        each: list[list] = [[] for _ in MEASURES]
        for j, v, n in counted:
            each[j].append((v, n))
        return [tuple(np.array(sorted(x), float).reshape(-1, 2).T) for x in each]

    def summed(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum of ``fn(measures, halves)``, an array of ``size`` numbers, over all rows.

        Each task makes one array and cuts it into ``SLICES``; a slice of all tasks is added up by one task, in the tasks'
        order. So the driver gets ``size`` numbers, however many tasks there are.
        """
        edges = np.linspace(0, size, min(SLICES, size) + 1).astype(int).tolist()

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    part = fn(_matrix(batch), batch.column("half").to_numpy())
                    out = part if out is None else out + part
            if out is not None:
                out = out.astype("<f8")
                slices = [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                task = [TaskContext.get().partitionId()] * len(slices)
                columns = [pa.array(range(len(slices)), pa.int32()), pa.array(task, pa.int32()), pa.array(slices, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "task", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column("slice").to_pylist(), batch.column("sums")):
                    part = np.frombuffer(x.as_buffer(), "<f8")
                    held[k] = held[k] + part if k in held else part.copy()
            if held:
                columns = [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "sums"])

        dealt = self.rows.mapInArrow(made, "slice int, task int, sums binary").repartition("slice").sortWithinPartitions("slice", "task")
        total = np.zeros(size)
        for k, sums in dealt.mapInArrow(added, "slice int, sums binary").collect():
            total[edges[k] : edges[k + 1]] = np.frombuffer(sums, "<f8")
        return total


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("m").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(MEASURES))


def knots_of(histograms: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of each measure at fixed shares of all rows, and the distances between them (never zero)."""
    shares = np.sort([*np.linspace(0, 1, KNOTS + 1), 0.95, 0.98])
    knots = []
    for values, counts in histograms:
        upto = np.cumsum(counts)
        knots.append(values[np.minimum(np.searchsorted(upto, shares * upto[-1]), len(values) - 1)])
    knots = np.array(knots)
    return knots, np.maximum(np.diff(knots, axis=1), 1e-6 * np.maximum(1, np.abs(knots).max(axis=1))[:, None])


def _descend(unlabelled: Unlabelled, place: tuple, descents: list[Descent], halves: list[int | None]) -> None:
    """Run the descents together, each over the rows of its half (None: all), one pass over the measures for each step."""
    d = len(descents[0].weights)
    size = 2 + d + d * d
    for _ in range(STEPS):
        open_ = [(x, h) for x, h in zip(descents, halves) if not x.done]
        if not open_:
            return
        weights = [(x.offered, h) for x, h in open_]

        def sums(m: np.ndarray, half: np.ndarray, weights: list = weights) -> np.ndarray:
            x = Model.basis(m, *place).astype(np.float32)
            return np.concatenate([negative_sums(x if h is None else x[half == h], w) for w, h in weights])

        got = unlabelled.summed(sums, size * len(open_))
        for k, (x, _) in enumerate(open_):
            x.take(got[k * size : (k + 1) * size])


def estimated_prior(pos: list[np.ndarray], above: Callable[[list[np.ndarray]], np.ndarray]) -> float:
    """Share of positives among all rows, from scores of rows that the scoring model has not seen.

    ``pos`` are the positives' scores in each half, ``above`` gives per half the share of all rows from each cut on. Above a
    low quantile of the positives nearly all unlabelled rows are good too, so the ratio of the two shares is the prior
    there, and it is larger below: the least ratio over the low quantiles. High quantiles, where few rows are left, would
    add noise only; and a prior that is a little low does less harm than one that is too high. Held within PRIOR_RANGE.
    """
    cuts = [np.quantile(p, np.linspace(0.02, 0.3, 8)) for p in pos]
    shares = above(cuts)
    least = [min(u / (p >= c).mean() for u, c in zip(row, cut)) for row, cut, p in zip(shares, cuts, pos) if not np.isnan(row).any()]
    return float(np.clip(np.mean(least), *PRIOR_RANGE)) if least else 0.5


def fit(pos: np.ndarray, half: np.ndarray, unlabelled: Unlabelled) -> Model | None:
    """A model from measures of positives (and the half of ids each is in) and all unlabelled rows; None without either."""
    histograms = unlabelled.histograms()
    if not len(pos) or not len(histograms[0][0]):
        return None
    place = knots_of(histograms)
    p = Model.basis(pos, *place).astype(np.float32)
    both = all((half == h).any() for h in (0, 1))
    own = [p[half == h] if both else p for h in (0, 1)]
    rough = [Descent(own[1 - h], 0.5, np.zeros(p.shape[1]), close=1e-4) for h in (0, 1)]
    _descend(unlabelled, place, rough, [1, 0])  # each half is scored by the model of the other
    weights = [x.weights.astype(np.float32) for x in rough]

    def above(cuts: list[np.ndarray]) -> np.ndarray:
        def count(m: np.ndarray, half: np.ndarray) -> np.ndarray:
            x = Model.basis(m, *place).astype(np.float32)
            z = [x[half == h] @ weights[h] for h in (0, 1)]
            return np.concatenate([[len(z[h]), *((z[h] >= c).sum() for c in cuts[h])] for h in (0, 1)]).astype(float)

        got = unlabelled.summed(count, 2 * (len(cuts[0]) + 1)).reshape(2, -1)
        return got[:, 1:] / np.where(got[:, :1] > 0, got[:, :1], np.nan)

    prior = estimated_prior([own[h] @ weights[h] for h in (0, 1)], above)
    last = Descent(p, prior, (rough[0].weights + rough[1].weights) / 2)
    _descend(unlabelled, place, [last], [None])
    return Model(*place, last.weights, prior)


def _taken(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures of about the ``most`` rows of least id hash, never more, in that order, and the half of ids of each.

    Rows are cut by hash first, with some to spare, so that tasks do not send the driver ``most`` rows each.
    """
    span = 1 << 40
    bound = int(span * min(1.0, 1.3 * most / max(1, rows.count())))
    hashed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(span)).alias("h"), "doc_id", "m").filter(F.col("h") < bound)
    got = hashed.orderBy("h", "doc_id").limit(most).select("m", "h").collect()
    return np.array([r[0] for r in got], float).reshape(-1, len(MEASURES)), np.array([r[1] % 2 for r in got], int)


def learn(table: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled good documents among ``usable`` rows and on all documents as unlabelled text.

    Only the labelled rows are bounded; knots, prior and the unlabelled part of the risk come from every row. None if
    there is no usable positive or no unlabelled text.
    """
    good = labels.filter("quality = 1").filter(usable).select("doc_id").distinct()
    pos, half = _taken(table.join(good, "doc_id", "left_semi"), sample)
    return fit(pos, half, Unlabelled(table)) if len(pos) else None


def score(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``CUT`` on): one row per row of ``docs``.

    Labels come only from rows whose crc32(doc_id) mod 4 is not 2, unless ``usable`` says otherwise. Null and empty
    texts have a score too; without a usable label every score is 0.5. Repeated rows stay; a null doc_id stays null
    and has no label. Further columns are not read.
    """
    out = held_out(4, 2)
    table = cut_lineage(measured(docs))
    model = learn(table, labels, ~out if usable is None else usable, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            m = _matrix(batch)
            s = model.score(m) if model else np.full(n, 0.5)
            columns = [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good, all columns as they are; all rows if there is no usable label.

    Null and empty texts are judged like any text; repeated rows and null ids stay or go by their text.
    """
    model = learn(cut_lineage(measured(docs)), labels, ~held_out(4, 2), sample)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            m = np.array([text_measures(t or b"") for t in texts], np.float32).reshape(-1, len(MEASURES))
            yield batch.filter(pa.array(model.score(m) >= CUT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if model else docs
