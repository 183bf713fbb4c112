"""Boosted trees with a softmax (or logistic) loss, grown on shared histograms.

Features are cut into bins once, at quantiles of the training rows. The rows are kept as
blocks: bins of a few thousand rows as one array, with their codes. A round grows one
regression tree per class (one in all for two classes), level by level and all classes at once: every task
sums first and second derivatives by (class, node, feature, bin), Spark adds the sums, and the
driver, which sees one row a bin however many rows there are, picks the splits and the Newton
leaf values. It stops once ``patience`` rounds have not lowered the loss of the held rows.

Up to ``ALONE_ROWS`` rows a pass computes no longer than a job takes to start: there, one task
takes the blocks and all rounds are one job. Of more rows, a pass is one short job over blocks
held in memory, which go from round to round with their margins; every few rounds a written
table carries them, so a fit goes on where it stood instead of starting anew.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from marketloom.session import cut_lineage

BINS = 64
BLOCK_ROWS = 1024
#: Fixed values of the loss: penalty of a leaf's weight, least sum of second derivatives of a child.
PENALTY = 1.0
LEAST_HESSIAN = 1.0
#: Rounds between tables of margins.
CARRY = 25
#: Blocks that are worth a task of their own: over as many rows a pass computes as long as a task takes to start.
BLOCKS_A_TASK = 12
#: Rows of which one task grows all rounds: their bins take 5 MB at 38 features, and a pass about a tenth of a second.
ALONE_ROWS = 1 << 17
#: Tasks whose sums the driver adds itself; those of more tasks are added in a shuffle first.
DIRECT = 16
_STATE = "block long, codes binary, bins binary, held binary, margins binary"


@dataclass
class Tree:
    """Heap-ordered nodes: feature (-1 at a leaf), bin (rows at or below go left), value and gain."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Of each class; one margin a row is that of the second of two classes."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return np.hstack((1.0 - p, p))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each margin."""
    p = probabilities(margins)
    y = np.zeros_like(p)
    y[np.arange(len(codes)), codes] = 1.0
    first, second = p - y, p * (1.0 - p)
    if margins.shape[1] == 1:
        return first[:, 1:], second[:, 1:]
    return first, 2.0 * second


def log_loss(margins: np.ndarray, codes: np.ndarray) -> float:
    """Summed over rows."""
    return float(-np.log(np.maximum(probabilities(margins)[np.arange(len(codes)), codes], 1e-15)).sum())


def best_split(grad: np.ndarray, hess: np.ndarray, allowed: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of one node's sums (features, bins); ties to the first."""
    left_g, left_h = grad.cumsum(axis=1)[:, :-1], hess.cumsum(axis=1)[:, :-1]
    g, h = grad[0].sum(), hess[0].sum()
    right_g, right_h = g - left_g, h - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - g * g / (h + PENALTY)
    gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN) | ~allowed[:, None]] = -np.inf
    best = int(np.argmax(gain))
    f, b = divmod(best, gain.shape[1])
    return float(gain[f, b]), f, b


@dataclass
class Boosted:
    """Trees of each round and class over binned features; ``transform`` adds pred code and probs."""

    features: list[str]
    cuts: list[np.ndarray]
    classes: int
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of values; NaN goes with the greatest."""
        return np.stack([np.searchsorted(c, values[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def raised(self, margins: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The margins with those of the trees."""
        margins = margins.copy()
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                margins[:, k] += self.rate * tree.value[tree.nodes(bins)]
        return margins

    def since(self, first: int) -> Boosted:
        """The rounds from ``first`` on, which is all that tasks need."""
        return replace(self, rounds=self.rounds[first:], losses=[], cuts=[])

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.features))
        for tree in itertools.chain.from_iterable(self.rounds):
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() else total

    def save(self, path: str) -> None:
        """One row of JSON as a text table."""
        trees = [[{k: v.tolist() for k, v in vars(t).items()} for t in trees] for trees in self.rounds]
        state = {**vars(self), "cuts": [c.tolist() for c in self.cuts], "rounds": trees}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(state),)], "boosted string").write.mode("overwrite").parquet(path)

    @staticmethod
    def saved_at(path: str) -> bool:
        """Whether a boosted model is there; the other families are saved as folders without a table."""
        try:
            return SparkSession.getActiveSession().read.parquet(path).columns == ["boosted"]
        except AnalysisException:
            return False

    @staticmethod
    def load(path: str) -> Boosted:
        state = json.loads(SparkSession.getActiveSession().read.parquet(path).first()["boosted"])
        rounds = [[Tree(**{k: np.array(v) for k, v in t.items()}) for t in trees] for trees in state.pop("rounds")]
        return Boosted(**{**state, "cuts": [np.array(c, np.float64) for c in state["cuts"]], "rounds": rounds})

    def transform(self, rows: DataFrame) -> DataFrame:
        """All columns of the rows, ``_code`` (the likeliest class) and ``probs``."""
        model, names = self, rows.columns

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.stack([batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(len(model.features))], axis=1)
                probs = probabilities(model.raised(np.zeros((len(values), model.outputs)), model.binned(values.astype(np.float64))))
                listed = pa.ListArray.from_arrays(np.arange(len(probs) + 1, dtype=np.int32) * model.classes, probs.reshape(-1))
                code = pa.array(probs.argmax(axis=1).astype(np.float64)) if len(probs) else pa.array([], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], code, listed], names=[*names, "_code", "probs"])

        inputs = rows.select(*names, *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(self.features)))
        schema = StructType([*rows.schema.fields, StructField("_code", DoubleType()), StructField("probs", ArrayType(DoubleType()))])
        return inputs.mapInArrow(scored, schema)


def quantile_cuts(rows: DataFrame, features: list[str], bins: int = BINS, error: float = 0.001) -> list[np.ndarray]:
    """Up to ``bins`` - 1 ascending cut points of each feature, found in one pass; null and NaN values do not count."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, round(1 / error)).alias(c) for c in features)).first()
    return [np.unique(np.array(found[c] or [], np.float64)) for c in features]


def _blocks(rows: DataFrame, model: Boosted, label: Column, held: Column) -> DataFrame:
    """Blocks of binned rows with their codes, held flags and margins of zero."""

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, parts = TaskContext.get().partitionId(), itertools.count(), []

        def sent() -> pa.RecordBatch:
            values, codes, flags = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            bins, margins = model.binned(values), np.zeros((len(codes), model.outputs))
            arrays = [codes.astype(np.uint8), bins, flags.astype(np.uint8), margins]
            block = pa.array([(part << 33) + next(serial)], pa.int64())
            return pa.RecordBatch.from_arrays([block, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["block", "codes", "bins", "held", "margins"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            if batch.num_rows:
                parts.append((np.stack(columns[2:], axis=1), columns[0], columns[1]))
            if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                yield sent()
        if parts:
            yield sent()

    inputs = rows.select(label.cast("double").alias("_y"), held.cast("double").alias("_h"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(model.features)))
    return inputs.mapInArrow(blocked, _STATE)


def _opened(codes: bytes, bins: bytes, held: bytes, margins: bytes, model: Boosted):
    codes = np.frombuffer(codes, np.uint8).astype(np.int64)
    return (
        codes,
        np.frombuffer(bins, np.uint8).reshape(len(codes), -1),
        np.frombuffer(held, np.uint8) > 0,
        np.frombuffer(margins, np.float64).reshape(len(codes), model.outputs),
    )


def _drawn(block: int, codes: np.ndarray, bins: np.ndarray, held: np.ndarray, margins: np.ndarray, turn: int, subsample: float, seed: int) -> tuple:
    """Bins by feature and derivatives of the rows of a block that a round uses; loss and number of the held ones.

    Which rows a round leaves out follows from the seed, the round and the block alone.
    """
    use = ~held & (np.random.default_rng((seed, turn, block & 0xFFFFFFFF, block >> 32)).random(len(codes)) < subsample)
    return np.ascontiguousarray(bins[use].T), *derivatives(margins[use], codes[use]), log_loss(margins[held], codes[held]), int(held.sum())


def _added(drawn: Iterable[tuple], many: int, outputs: int, growing: list[Tree], level: int) -> tuple[np.ndarray, float, int]:
    """Sums of derivatives by (class and node of the level, feature and bin) over drawn blocks, loss and rows of the held ones."""
    first, count = (1 << level) - 1, 1 << level
    total = np.zeros((outputs, many, count, BINS, 2))
    loss = rows = 0
    for columns, first_d, second_d, block_loss, block_rows in drawn:
        loss, rows = loss + block_loss, rows + block_rows
        for k in range(outputs):
            at = growing[k].nodes(columns.T) - first
            here, sides = at >= 0, (first_d[:, k], second_d[:, k])
            own = columns
            if not here.all():
                at, own, sides = at[here], columns[:, here], [x[here] for x in sides]
            sides = [np.ascontiguousarray(x) for x in sides]
            cells = at * BINS
            for f in range(many):
                index = cells + own[f]
                for j, x in enumerate(sides):
                    total[k, f, :, :, j] += np.bincount(index, x, count * BINS).reshape(count, BINS)
    return np.moveaxis(total, 2, 1).reshape(outputs * count, -1), loss, rows


def _sums(blocks: RDD, model: Boosted, growing: list[Tree], level: int, subsample: float, seed: int) -> tuple[np.ndarray, float, int]:
    """Sums of derivatives by (class, node of the level, feature, bin) over all rows, loss and rows of the held ones."""
    many, outputs, turn = len(model.features), model.outputs, len(model.rounds)

    def summed(opened: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        flat, loss, rows = _added((_drawn(*block, turn, subsample, seed) for block in opened), many, outputs, growing, level)
        for slot in np.flatnonzero(flat.any(axis=1)):
            yield int(slot), flat[slot]
        if rows:
            yield -1, np.array([loss, float(rows)])

    nodes = outputs << level
    total = np.zeros((nodes, many * BINS * 2))
    loss = rows = 0.0
    sums = blocks.mapPartitions(summed)
    if blocks.getNumPartitions() > DIRECT:
        sums = sums.reduceByKey(np.add, min(DIRECT, nodes + 1))  # one row a node and class
    for slot, one in sums.collect():
        if slot < 0:
            loss, rows = loss + one[0], rows + one[1]
        else:
            total[slot] += one
    return total.reshape(outputs, 1 << level, many, BINS, 2), float(loss), int(rows)


def _grow(trees: list[Tree], sums: np.ndarray, allowed: list[np.ndarray], level: int, depth: int) -> bool:
    """Split the nodes of a level where that gains, down to ``depth``, and set Newton values; whether any was split."""
    first, split = (1 << level) - 1, False
    for k, tree in enumerate(trees):
        for n in range(1 << level):
            node, (g, h) = first + n, np.moveaxis(sums[k, n], -1, 0)
            if not h.any():
                continue
            tree.value[node] = -g[0].sum() / (h[0].sum() + PENALTY)
            if level == depth:
                continue
            gain, f, b = best_split(g, h, allowed[k])
            if gain > 1e-12:
                tree.feature[node], tree.bin[node], tree.gain[node] = f, b, gain
                left = g[f, : b + 1].sum(), h[f, : b + 1].sum()
                right = g[f].sum() - left[0], h[f].sum() - left[1]
                for child, (cg, ch) in ((2 * node + 1, left), (2 * node + 2, right)):
                    tree.value[child] = -cg / (ch + PENALTY)
                split = True
    return split


def fit_boosted(
    rows: DataFrame,
    features: list[str],
    label: Column,
    held: Column,
    classes: int,
    rounds: int,
    rate: float,
    depth: int,
    subsample: float = 1.0,
    columns: float = 1.0,
    patience: int = 20,
    seed: int = 42,
) -> Boosted:
    """Boost trees on the rows not ``held``; cut at the round that the held rows find best.

    ``label`` gives codes from 0. Without held rows all ``rounds`` are grown; without training
    rows the model has no trees. Null features go with the greatest bin.
    """
    model = Boosted(features, quantile_cuts(rows.where(~held), features), classes, rate)
    table = cut_lineage(_blocks(rows, model, label, held))
    plan = _Plan(rounds, depth, subsample, columns, patience, seed)
    if _rows(table) <= ALONE_ROWS:
        _fit_in_one_job(table, model, plan)
    else:
        _fit_by_passes(table, model, plan, _tasks(table))
    if model.losses:
        # the loss at place k is that of k rounds
        model.rounds = model.rounds[: max(1, int(np.argmin(model.losses)))]
    return model


@dataclass(frozen=True)
class _Plan:
    """How a model is grown; see ``fit_boosted``."""

    rounds: int
    depth: int
    subsample: float
    columns: float
    patience: int
    seed: int


def _add_rounds(model: Boosted, plan: _Plan, sums: Callable[[list[Tree], int], tuple], raise_margins: Callable[[], None]) -> None:
    """Add rounds until there are enough or the loss is stale.

    ``sums`` gives those of the growing trees' level, loss and rows of the held ones;
    ``raise_margins`` is called after each round. The same sums give the same trees.
    """
    size, draws, many = (2 << plan.depth) - 1, np.random.default_rng(plan.seed), len(model.features)
    some = max(1, int(plan.columns * many))
    while True:
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for _ in range(model.outputs)]
        found, loss, rows = sums(trees, 0)
        if rows:
            model.losses.append(loss / rows)
        if len(model.rounds) == plan.rounds or _stale(model.losses, plan.patience):
            return
        allowed = [np.isin(np.arange(many), draws.choice(many, some, replace=False)) for _ in trees]
        level = 0
        while _grow(trees, found, allowed, level, plan.depth) and level + 1 < plan.depth:
            level += 1
            found = sums(trees, level)[0]
        model.rounds.append(trees)
        raise_margins()


def _rows(table: DataFrame) -> int:
    """Rows in all blocks."""
    return table.agg(F.sum(F.octet_length("codes"))).first()[0] or 0


def _fit_in_one_job(table: DataFrame, model: Boosted, plan: _Plan) -> None:
    """Add the rounds in one task, which returns them."""
    many, outputs = len(model.features), model.outputs

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [[block, *_opened(*arrays, model)] for batch in batches for block, *arrays in zip(*(c.to_pylist() for c in batch.columns))]
        blocks.sort(key=lambda b: b[0])
        drawn = []

        def sums(trees: list[Tree], level: int) -> tuple[np.ndarray, float, int]:
            if not level:
                drawn[:] = [_drawn(*b, len(model.rounds), plan.subsample, plan.seed) for b in blocks]
            found, loss, rows = _added(drawn, many, outputs, trees, level)
            return found.reshape(outputs, 1 << level, many, BINS, 2), loss, rows

        def raise_margins() -> None:
            last = model.since(len(model.rounds) - 1)
            for b in blocks:
                b[4] = last.raised(b[4], b[2])

        _add_rounds(model, plan, sums, raise_margins)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.rounds, model.losses))], pa.binary())], names=["grown"])

    found = table.coalesce(1).mapInArrow(grown, "grown binary").first()
    model.rounds, model.losses = pickle.loads(found["grown"])


def _fit_by_passes(table: DataFrame, model: Boosted, plan: _Plan, tasks: int) -> None:
    """Add the rounds by a job for each pass."""
    carried, before, blocks = 0, None, _held(table, model, tasks)

    def sums(trees: list[Tree], level: int) -> tuple[np.ndarray, float, int]:
        nonlocal before
        found = _sums(blocks, model, trees, level, plan.subsample, plan.seed)
        if before is not None:
            before.unpersist()
            before = None
        return found

    def raise_margins() -> None:
        nonlocal table, carried, before, blocks
        before = blocks
        if len(model.rounds) - carried == CARRY:
            table = _carried(table, model, carried)
            carried, blocks = len(model.rounds), _held(table, model, tasks)
        else:
            blocks = _next(blocks, model)

    try:
        _add_rounds(model, plan, sums, raise_margins)
    finally:
        blocks.unpersist()


def _tasks(table: DataFrame) -> int:
    """As many as the blocks are worth, up to those of any other shuffle; fits beside each other share the cores."""
    most = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-table.count() // BLOCKS_A_TASK)))


def _held(table: DataFrame, model: Boosted, tasks: int) -> RDD:
    """Opened blocks of a written table, held in memory, as a round passes over them once a level."""
    model = model.since(len(model.rounds))
    opened = table.repartition(tasks, "block").rdd.map(lambda r: (r[0], *_opened(*r[1:], model)))
    return opened.persist(StorageLevel.MEMORY_AND_DISK)


def _next(blocks: RDD, model: Boosted) -> RDD:
    """The blocks with the margins of the last round's trees added, held in memory."""
    last = model.since(len(model.rounds) - 1)
    return blocks.map(lambda r: (*r[:4], last.raised(r[4], r[2]))).persist(StorageLevel.MEMORY_AND_DISK)


def _stale(losses: list[float], patience: int) -> bool:
    """Whether the least loss is followed by ``patience`` rounds."""
    return bool(losses) and len(losses) - 1 - int(np.argmin(losses)) >= patience


def _carried(state: DataFrame, model: Boosted, carried: int) -> DataFrame:
    """The blocks with the margins of all rounds so far, as a written table."""
    model = model.since(carried)

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for codes, bins, held, old in zip(*(c.to_pylist() for c in batch.columns[1:])):
                _, opened, _, old = _opened(codes, bins, held, old, model)
                margins.append(model.raised(old, opened).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins, pa.binary())], names=batch.schema.names)

    return cut_lineage(state.mapInArrow(raised, _STATE))
