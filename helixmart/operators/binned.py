"""Forests and boosted trees over binned rows.

Trees only see in which of some 32 bins of each feature a row lies. Rows of the same bins are one cell, so a training set is a
table of cells with counts per class: at most bins ** features of them, however many rows there are. Each task grows whole trees
on all cells; what is kept of a model is the class it gives to each cell. Binning, impurities, stopping and pruning follow Spark ML.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from helixmart.session import cut_lineage, task_count

#: Cells of a training set that a task holds: all that four features of 32 bins can have.
MAX_CELLS = 32 ** 4
EPSILON = np.finfo(float).eps
#: Rows of a batch of votes, and of a task that goes over all fits.
BATCH, ROWS = 50_000, 50_000


# -- growing trees -----------------------------------------------------------------------------

def _spread(weights: np.ndarray) -> np.ndarray:
    """Gini impurity of class weights in the last axis, times their sum."""
    total = weights.sum(-1)
    return total - np.divide((weights * weights).sum(-1), total, out=np.zeros_like(total), where=total > 0)


def grow(bins: np.ndarray, widths: np.ndarray, cell: np.ndarray, klass: np.ndarray, weight: np.ndarray, rows: np.ndarray,
         classes: int, depth: int, least: int, chosen: int, rng: np.random.Generator) -> np.ndarray:
    """Class shares in the leaf of every cell, by one tree grown level by level over entries (cell, class, weight, rows)."""
    usable, b = np.flatnonzero(widths > 1), int(widths.max())
    at = np.zeros(len(bins), np.int64)  # node of a cell, numbered over the whole tree
    stats, child, level = [], [], np.zeros(1, np.int64)
    first, upto = 0, 1
    for deep in range(depth + 1):
        n, node = len(level), at[cell] - first
        here = np.bincount(node * classes + klass, weight, n * classes).reshape(n, classes)
        stats.append(here)
        child.append(np.full(n, -1, np.int64))
        impure = _spread(here)
        open_ = impure > EPSILON * here.sum(1)
        if deep == depth or not open_.any() or not len(usable):
            break
        seat = np.cumsum(open_) - 1  # of the open nodes
        keep = open_[node]
        node, on, of, w, r = seat[node[keep]], cell[keep], klass[keep], weight[keep], rows[keep]
        here, impure, k = here[open_], impure[open_], int(open_.sum())
        picks = np.sort(rng.random((k, len(widths))).argsort(1)[:, :chosen], 1)
        gain, feature, cut = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for j in range(picks.shape[1]):
            f = picks[:, j]
            key = node * b + bins[on, f[node]]
            left = np.bincount(key * classes + of, w, k * b * classes).reshape(k, b, classes).cumsum(1)[:, :-1]
            count = np.bincount(key, r, k * b).reshape(k, b).cumsum(1)
            few, total = count[:, :-1], count[:, -1:]
            better = impure[:, None] - _spread(left) - _spread(np.maximum(here[:, None] - left, 0.0))
            better[(few < least) | (total - few < least)] = -np.inf
            best = better.argmax(1)
            found = better[np.arange(k), best]
            more = found > gain
            gain[more], feature[more], cut[more] = found[more], f[more], best[more]
        split = gain > EPSILON * here.sum(1)
        if not split.any():
            break
        pairs = np.full(k, -1, np.int64)
        pairs[split] = upto + 2 * np.arange(split.sum())
        child[-1][open_] = pairs
        # All cells go down, also those without rows of this tree.
        mine = np.flatnonzero(at >= first)
        mine = mine[open_[at[mine] - first]]
        s = seat[at[mine] - first]
        mine, s = mine[split[s]], s[split[s]]
        at[mine] = pairs[s] + (bins[mine, feature[s]] > cut[s])
        first, upto = upto, upto + 2 * int(split.sum())
        level = np.arange(first, upto)
        going = at[cell] >= first
        cell, klass, weight, rows = cell[going], klass[going], weight[going], rows[going]
    return _pruned(stats, child, at)


def _pruned(stats: list[np.ndarray], child: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Class shares by cell; twin leaves that give the same class are their parent."""
    starts = np.cumsum([0, *map(len, stats)])
    every, kids = np.concatenate(stats), np.concatenate(child)
    says, leaf, top = every.argmax(1), kids < 0, np.arange(len(every))
    for i in range(len(stats) - 1, -1, -1):
        inner = starts[i] + np.flatnonzero(child[i] >= 0)
        a = kids[inner]
        leaf[inner[leaf[a] & leaf[a + 1] & (says[a] == says[a + 1])]] = True
    for i in range(len(stats)):
        inner = starts[i] + np.flatnonzero(child[i] >= 0)
        closed = inner[leaf[inner]]
        top[kids[closed]] = top[kids[closed] + 1] = top[closed]
    own = every[top[at]]
    total = own.sum(1, keepdims=True)
    return np.divide(own, total, out=np.zeros_like(own), where=total > 0)


def boost(bins: np.ndarray, widths: np.ndarray, own: np.ndarray, others: np.ndarray, rounds: int, step: float, depth: int,
          least: int) -> np.ndarray:
    """Margin of every cell for one class against the rest, by regression trees on the gradients of the log loss.

    ``own`` and ``others`` are the rows of a cell that are of the class and that are not.
    """
    b, k = int(widths.max()), len(widths)
    full = np.flatnonzero(own + others > 0)
    slots = (np.arange(k) * b + bins[full]).ravel()
    mine, rest = own[full].astype(float), others[full].astype(float)
    n = mine + rest
    margin = np.zeros(len(bins))
    for turn in range(rounds):
        if turn:
            f = margin[full]
            up = 2.0 * f
            pulls = mine * (4.0 / (1.0 + np.exp(np.minimum(up, 700.0)))) - rest * (4.0 / (1.0 + np.exp(np.minimum(-up, 700.0))))
        else:
            pulls = mine - rest
        at, nodes = np.zeros(len(bins), np.int64), 1
        value = np.zeros(1)
        settled = np.zeros(len(bins))
        done = np.zeros(len(bins), bool)
        for deep in range(depth + 1):
            live = ~done[full]
            node = at[full][live]
            count = np.bincount(node, n[live], nodes)
            total = np.bincount(node, pulls[live], nodes)
            value = np.divide(total, count, out=np.zeros(nodes), where=count > 0)
            split = np.zeros(nodes, bool)
            if deep < depth:
                key = (np.repeat(node, k) * (k * b)) + (slots if live.all() else slots.reshape(-1, k)[live].ravel())
                c = np.bincount(key, np.repeat(n[live], k), nodes * k * b).reshape(nodes, k, b).cumsum(2)[:, :, :-1]
                s = np.bincount(key, np.repeat(pulls[live], k), nodes * k * b).reshape(nodes, k, b).cumsum(2)[:, :, :-1]
                over, beside = count[:, None, None] - c, total[:, None, None] - s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s * s / c + beside * beside / over - (total * value)[:, None, None]
                gain[(c < least) | (over < least)] = -np.inf
                gain = gain.reshape(nodes, -1)
                best = gain.argmax(1) if gain.shape[1] else np.zeros(nodes, np.int64)
                split = gain[np.arange(nodes), best] > 0 if gain.shape[1] else split
            stay = ~done & ~split[at]
            settled[stay] = value[at[stay]]
            done |= stay
            if not split.any():
                break
            pairs = np.cumsum(split) * 2 - 2
            go = np.flatnonzero(~done)
            which = best[at[go]]
            at[go] = pairs[at[go]] + (bins[go, which // (b - 1)] > which % (b - 1))
            at[done], nodes = 0, 2 * int(split.sum())
        margin += settled * (step if turn else 1.0)
    return margin


# -- binning -----------------------------------------------------------------------------------

def _thresholds(rows: DataFrame, k: int, bins: int, weighted: bool) -> dict[tuple[int, int], np.ndarray]:
    """Up to bins - 1 thresholds per (fit, feature), halfway between neighbours where the running weight is nearest to an even
    share; all of the train rows count. The sorted values pass in batches."""
    train = rows.where(~F.col("held"))
    w = F.sum("class_weight") if weighted else F.count("*").cast("double")
    values = cut_lineage(train.select("fit", "class_weight", F.posexplode("x").alias("feature", "value")).groupBy(
        "fit", "feature", "value").agg(w.alias("w")))
    sizes = {r["fit"]: r["n"] for r in train.groupBy("fit").agg(F.count("*").alias("n")).collect()}
    strides = {}
    for r in values.groupBy("fit", "feature").agg(F.count("*").alias("d"), F.sum("w").alias("w")).collect():
        cuts = min(bins, sizes[r["fit"]]) - 1
        # Where there are few values, all gaps between them.
        strides[r["fit"], r["feature"]] = r["w"] / (cuts + 1) if r["d"] - 1 > cuts else 0.0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = last = None
        for batch in batches:
            fit, feature, value, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fit", "feature", "value", "w"))
            ends = np.flatnonzero(np.diff(fit) | np.diff(feature)) + 1
            for part in np.split(np.arange(len(fit)), ends):
                if not len(part):
                    continue
                v, c = value[part], weight[part]
                if group != (now := (int(fit[part[0]]), int(feature[part[0]]))):
                    group, last, seen, goal = now, None, 0.0, strides[now]
                c = seen + np.cumsum(c)
                if last is not None:
                    v, c = np.append(last, v), np.append(seen, c)
                last, seen, found = v[-1], float(c[-1]), []
                if not strides[group]:
                    found = list((v[:-1] + v[1:]) / 2)
                else:
                    middles, i = (c[:-1] + c[1:]) / 2, 0
                    while (i := max(i, int(np.searchsorted(middles, goal, "right")))) < len(middles):
                        found.append((v[i] + v[i + 1]) / 2)
                        goal, i = goal + strides[group], i + 1
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "fit": pa.array([group[0]] * len(found), pa.int32()), "feature": pa.array([group[1]] * len(found), pa.int32()),
                        "cut": pa.array(found, pa.float64())})

    dealt = values.repartition(max(len(strides), 1), "fit", "feature").sortWithinPartitions("fit", "feature", "value")
    got = dealt.mapInArrow(walk, "fit int, feature int, cut double").collect()
    return {(fit, f): np.sort([r["cut"] for r in got if (r["fit"], r["feature"]) == (fit, f)]) for fit in sizes for f in range(k)}


def _cell_numbers(x: pa.Array, fit: np.ndarray, cuts: dict, k: int, bins: int) -> np.ndarray:
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    out = np.zeros(len(values), np.int64)
    for one in np.unique(fit):
        rows = np.flatnonzero(fit == one)
        for f in range(k):
            out[rows] = out[rows] * bins + np.searchsorted(cuts[int(one), f], values[rows, f], "left")
    return out


def _celled(rows: DataFrame, cuts: dict, k: int, bins: int) -> DataFrame:
    """The rows with the number of their cell instead of their values."""
    rest = [c for c in rows.columns if c != "x"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch.column("fit").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(_cell_numbers(batch.column("x"), fit, cuts, k, bins))], [*rest, "cell"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(number, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "cell long"]))


# -- fitting -----------------------------------------------------------------------------------

@dataclass
class CellModel:
    """One fitted model: the class of each cell that its rows have, and how many of them are right."""

    fit: int
    features: int
    bins: int
    cuts: dict
    cells: np.ndarray
    classes: np.ndarray
    train_accuracy: float
    held_accuracy: float

    def predict(self, held: DataFrame) -> DataFrame:
        """Adds the column prediction to held rows of the fit, instead of their features."""
        shared = held.sparkSession.sparkContext.broadcast((self.cells, self.classes))
        rows = held.select(F.lit(self.fit).alias("fit"), vector_to_array("features").alias("x"), *held.drop("features").columns)
        rest = [c for c in rows.columns if c != "x"]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, classes = shared.value
            for batch in batches:
                found = classes[np.searchsorted(cells, batch.column("cell").to_numpy(zero_copy_only=False))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(found.astype(float))], [*rest, "prediction"])

        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "prediction double"])
        return _celled(rows, self.cuts, self.features, self.bins).mapInArrow(look_up, schema).drop("fit")


def all_rows(parts: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The train and held rows (label, class_weight, features) of all fits in one table, in as many tasks as the cluster has room
    for: the parts of each fit together would be many small ones."""
    rows = None
    for fit, pair in enumerate(parts):
        for part, held in zip(pair, (False, True), strict=True):
            one = part.select(F.lit(fit).alias("fit"), F.lit(held).alias("held"), "label", "class_weight", vector_to_array("features").alias("x"))
            rows = one if rows is None else rows.unionByName(one)
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))


def fit_cells(parts: Sequence[tuple[DataFrame, DataFrame]], estimator, k: int, classes: int) -> list[CellModel] | None:
    """A model per fit, given as train and held rows (label, class_weight, features), by the trees and settings of ``estimator``: a
    forest, or boosted trees for each class against the rest. None for other estimators and for more cells than a task may hold.
    """
    forest = isinstance(estimator, RandomForestClassifier)
    if not forest and not (isinstance(estimator, OneVsRest) and isinstance(estimator.getClassifier(), GBTClassifier)):
        return None
    trees = estimator if forest else estimator.getClassifier()
    bins = trees.getMaxBins()
    if bins ** k > 2 ** 62:
        return None
    rows = all_rows(parts)
    spark = rows.sparkSession
    cuts = _thresholds(rows, k, bins, forest)
    table = cut_lineage(_celled(rows, cuts, k, bins).groupBy("fit", "cell", F.col("label").cast("int").alias("label")).agg(
        F.count_if(~F.col("held")).alias("n"), F.count_if("held").alias("held"),
        F.sum(F.when(~F.col("held"), F.col("class_weight")).otherwise(0.0)).alias("w")))
    counts = {r["fit"]: r["n"] for r in table.groupBy("fit").agg(F.countDistinct("cell").alias("n")).collect()}
    if max(counts.values(), default=0) > MAX_CELLS:
        return None
    fits = sorted(counts)
    known, shared = {}, {}
    for fit in fits:
        got = table.where(F.col("fit") == fit).drop("fit").toArrow()
        cell, label, n, held, w = (got.column(c).to_numpy() for c in ("cell", "label", "n", "held", "w"))
        order = np.lexsort((label, cell))
        cells, place = np.unique(cell[order], return_inverse=True)
        known[fit] = (cells, place.astype(np.int32), label[order].astype(np.int32), n[order], held[order])
        binned = np.stack([cells // bins ** (k - 1 - f) % bins for f in range(k)], 1).astype(np.uint8 if bins <= 256 else np.int32)
        shared[fit] = spark.sparkContext.broadcast((
            binned, np.array([len(cuts[fit, f]) + 1 for f in range(k)]), *known[fit][1:4], w[order]))

    units = trees.getNumTrees() if forest else classes
    parts = min(units, max(1, -(-2 * task_count(spark) // len(fits))))
    tasks = [(fit, units * i // parts, units * (i + 1) // parts) for i in range(parts) for fit in fits]
    settings = _settings(estimator, k, classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_numpy():
                fit, low, high = tasks[i]
                votes = _votes(shared[fit].value, settings, low, high)
                for start in range(0, len(votes), BATCH):
                    piece = votes[start:start + BATCH]
                    yield pa.RecordBatch.from_pydict({
                        "fit": pa.array(np.full(len(piece), fit, np.int32)), "place": pa.array(np.arange(start, start + len(piece))),
                        **{f"v{c}": pa.array(np.ascontiguousarray(piece[:, c])) for c in range(classes)}})

    names = [f"v{c}" for c in range(classes)]
    votes = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(work, ", ".join(["fit int, place long", *[f"{v} double" for v in names]]))
    # The order of sums must not decide between classes of equal votes.
    sums = F.array(*[F.round(F.sum(v), 9) for v in names])
    says = cut_lineage(votes.groupBy("fit", "place").agg((F.array_position(sums, F.array_max(sums)) - 1).cast("int").alias("class")))
    models = []
    for fit in fits:
        cells, place, label, n, held = known[fit]
        got = says.where(F.col("fit") == fit).select("place", "class").toArrow()
        given = np.zeros(len(cells), np.int32)
        given[got.column("place").to_numpy()] = got.column("class").to_numpy()
        right = given[place] == label
        models.append(CellModel(fit, k, bins, cuts, cells, given, _share(n, right), _share(held, right)))
        shared[fit].destroy()
    return models


def _share(n: np.ndarray, right: np.ndarray) -> float:
    return float(n[right].sum() / n.sum()) if n.sum() else 0.0


def _settings(estimator, k: int, classes: int) -> dict:
    if isinstance(estimator, RandomForestClassifier):
        return {"kind": "forest", "depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode(), "classes": classes,
                "seed": estimator.getSeed(), "chosen": int(np.ceil(np.sqrt(k))) if estimator.getNumTrees() > 1 else k}
    trees = estimator.getClassifier()
    return {"kind": "boosted", "depth": trees.getMaxDepth(), "least": trees.getMinInstancesPerNode(), "classes": classes,
            "rounds": trees.getMaxIter(), "step": trees.getStepSize()}


def _votes(shared: Sequence, settings: dict, low: int, high: int) -> np.ndarray:
    """Votes by cell and class of the trees, or margins of the classes, from ``low`` up to ``high``."""
    bins, widths, cell, klass, n, w = shared
    out = np.zeros((len(bins), settings["classes"]))
    if settings["kind"] == "boosted":
        for c in range(low, high):
            own = np.bincount(cell, n * (klass == c), len(bins))
            others = np.bincount(cell, n * (klass != c), len(bins))
            out[:, c] = boost(bins, widths, own, others, settings["rounds"], settings["step"], settings["depth"], settings["least"])
        return out
    ours = n > 0
    cell, klass, n, w = cell[ours], klass[ours].astype(np.int64), n[ours], w[ours]
    for tree in range(low, high):
        rng = np.random.default_rng([settings["seed"], tree])
        drawn = rng.poisson(n)
        some = drawn > 0
        out += grow(bins, widths, cell[some], klass[some], w[some] / n[some] * drawn[some], drawn[some], settings["classes"],
                    settings["depth"], settings["least"], settings["chosen"], rng)
    return out
