"""A restricted Boltzmann machine, and the local density of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators.graph import checkpointed


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows).ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def uniforms(keys: np.ndarray, step: int, hidden: int) -> np.ndarray:
    """Numbers in [0, 1) for each key and hidden unit of a step: the same in every run."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * hidden) + np.arange(1, hidden + 1, dtype=np.uint64)[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def boltzmann_machine(rows: DataFrame, key: str, column: str, hidden: int, batches: int, epochs: int = 10, rate: float = 0.1, cost: float = 0.0002, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Weights (visible x hidden), visible and hidden biases, and each epoch's squared error of reconstruction.

    Contrastive divergence with one step; momentum is 0.5, from the seventh epoch 0.9. Rows are dealt to that many batches by
    a hash of their key; each batch is one aggregation, to which a task sends one row of sums. Hidden states are drawn from
    numbers that depend on key, epoch and batch alone, so a task that is run again draws the same. Rows with a null key or
    a null in the vector, or of another length than the first key's, take no part."""
    p = F.col(column).cast("array<double>")
    kept = rows.select(F.col(key).cast("long").alias("k"), p.alias("p")).filter(F.col("k").isNotNull() & F.col("p").isNotNull() & ~F.exists("p", lambda x: x.isNull()))
    first = kept.orderBy("k").first()
    dim = len(first["p"]) if first else 0
    weights = np.random.default_rng(seed).normal(size=(dim, hidden)) * 0.1
    visible, unseen = np.zeros(dim), np.zeros(hidden)
    grown = [np.zeros_like(x) for x in (weights, visible, unseen)]
    errors: list[float] = []
    if not dim:
        return weights, visible, unseen, errors
    dealt = kept.filter(F.size("p") == dim).withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches))).persist(StorageLevel.MEMORY_AND_DISK)
    for epoch in range(epochs):
        errors.append(0.0)
        for b in range(batches):

            def sums(parts: Iterator[pa.RecordBatch], now: tuple = (weights, visible, unseen), step: int = epoch * batches + b) -> Iterator[pa.RecordBatch]:
                w, vb, hb = now
                total = np.zeros(dim * hidden + dim + hidden + 2)
                for part in parts:
                    data = stacked(part["p"], dim)
                    up = logistic(data @ w + hb)
                    states = (up > uniforms(np.asarray(part["k"]), step, hidden)).astype(float)
                    down = logistic(states @ w.T + vb)
                    again = logistic(down @ w + hb)
                    total += np.concatenate([(data.T @ up - down.T @ again).ravel(), (data - down).sum(axis=0), (up - again).sum(axis=0), [len(data), ((data - down) ** 2).sum()]])
                yield pa.RecordBatch.from_pydict({"s": lists(total[None])})

            own = dealt.filter(F.col("batch") == b).select("k", "p").mapInArrow(sums, "s array<double>")
            found = own.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row for each parameter
            total = np.array([r["v"] for r in sorted(found)])
            n = total[-2] if len(total) else 0
            if not n:
                continue
            errors[-1] += float(total[-1])
            slope = total[: dim * hidden].reshape(dim, hidden) / n, total[dim * hidden : -2 - hidden] / n, total[-2 - hidden : -2] / n
            momentum = 0.9 if epoch > 5 else 0.5
            grown = [g * momentum + rate * s for g, s in zip(grown, (slope[0] - cost * weights, *slope[1:]), strict=True)]
            weights, visible, unseen = weights + grown[0], visible + grown[1], unseen + grown[2]
    dealt.unpersist()
    return weights, visible, unseen, errors


def near_in_groups(own: np.ndarray, others: np.ndarray, times: np.ndarray, width: float, gap: np.ndarray) -> np.ndarray:
    """For each first coordinate of own, how many (times) of the distinct sorted ones of others are nearer than width; gap
    has the differences of the other coordinates. Rounded sums grow with each part, so these are a run of others."""
    till = np.concatenate([[0], np.cumsum(times)])
    middle = np.searchsorted(others, own)

    def holds(at: np.ndarray) -> np.ndarray:
        return sum(gap, np.abs(own - others[np.clip(at, 0, len(others) - 1)])) < width

    def settled(at: np.ndarray, least: np.ndarray | int, most: np.ndarray | int, inside: int) -> np.ndarray:
        """at moved to where the run begins or ends; it is off by rounding only. inside: the first of the run, from at."""
        for step in (-1, 1):
            while (go := ((at > least) & (holds(at - 1) == (inside == 0)) if step < 0 else (at < most) & (holds(at) == (inside < 0)))).any():
                at = at + step * go
        return at

    reach = width - gap.sum()
    low = settled(np.clip(np.searchsorted(others, own - reach), 0, middle), 0, middle, 0)
    high = settled(np.clip(np.searchsorted(others, own + reach), middle, None), middle, len(others), -1)
    return till[high] - till[low]


def near_in_blocks(own: np.ndarray, others: np.ndarray, times: np.ndarray, width: float, block: int = 64, most: int = 16384) -> np.ndarray:
    """The same for points of any coordinates, which are compared in blocks; others are sorted by the first one."""
    found = np.zeros(len(own), np.int64)
    order = np.argsort(own[:, 0], kind="stable")
    for i in range(0, len(own), block):
        at = order[i : i + block]
        q = own[at]
        low, high = np.searchsorted(others[:, 0], q[0, 0] - width), np.searchsorted(others[:, 0], q[-1, 0] + width, "right")
        for j in range(low, high, most):
            o = others[j : min(j + most, high)]
            apart = np.zeros((len(q), len(o)))
            for k in range(q.shape[1]):
                apart += np.abs(q[:, k, None] - o[None, :, k])
            found[at] += ((apart < width) @ times[j : j + len(o)].astype(float)).astype(np.int64)
    return found


def near(own: np.ndarray, others: np.ndarray, times: np.ndarray, width: float) -> np.ndarray:
    """For each row of own, how many (times) of the distinct rows of others are nearer than width by the sum of absolute
    differences. Where few rows differ in other coordinates than the first, these are groups, and counts in a group are
    found by its sorted first coordinates; else rows are compared in blocks."""
    order = np.lexsort(others.T[::-1])
    others, times = others[order], times[order]
    if not others.shape[1]:
        return np.zeros(len(own), np.int64)
    kinds = [np.unique(x[:, 1:], axis=0, return_inverse=True) if x.shape[1] > 1 else (np.zeros((1, 0)), np.zeros(len(x), int)) for x in (own, others)]
    (a, of_own), (b, of_others) = ((k, i.ravel()) for k, i in kinds)
    if len(a) * len(b) > len(own) + len(others) or np.isnan(own).any() or np.isnan(others).any():
        return near_in_blocks(own, others, times, width)
    found = np.zeros(len(own), np.int64)
    rows = [np.flatnonzero(of_others == j) for j in range(len(b))] if len(b) < 64 else np.split(np.argsort(of_others, kind="stable"), np.cumsum(np.bincount(of_others, minlength=len(b)))[:-1])
    mine = np.split(np.argsort(of_own, kind="stable"), np.cumsum(np.bincount(of_own, minlength=len(a)))[:-1])
    for i, at in enumerate(mine):
        gaps = np.abs(b - a[i])
        for j in np.flatnonzero(sum(gaps.T, np.zeros(len(b))) < width):
            found[at] += near_in_groups(own[at, 0], others[rows[j], 0], times[rows[j]], width, gaps[j])
    return found


def local_density(points: DataFrame, key: str, column: str, width: float, most: int = 200_000) -> DataFrame:
    """key, n: how many points lie within a sum of absolute differences below width of each point, itself among them.

    Neither the first coordinate nor the sum of the others can differ by more between such points: both are cut into cells
    of that width, and a cell's points meet those of the cells next to it, about a million at a time, in one task; the
    points of a cell of more than about most are dealt over several. Equal points are counted first and compared once."""
    p = F.col(column).cast("array<double>")
    rows = points.select(F.col(key).alias("key"), p.alias("p")).filter(F.col("p").isNotNull() & ~F.exists("p", lambda x: x.isNull()))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    first, rest = F.coalesce(F.get("p", F.lit(0)), F.lit(0.0)), F.when(F.size("p") > 1, F.slice("p", F.lit(2), F.size("p"))).otherwise(F.array().cast("array<double>"))
    cell = lambda x: F.floor(x / F.lit(width))
    once = checkpointed(rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", "n", F.size("p").alias("size"), first.alias("x"), total(rest).alias("s"), total(F.transform(rest, F.abs)).alias("r")))
    own = once.withColumns({"c": cell(F.col("x")), "d": cell(F.col("s"))})
    # cells of x - width and x + width, rounded, enclose those of all near points; sums are further off by their rounding
    slack = F.lit(width) + (F.col("r") + F.lit(width)) * F.lit(1e-9)
    reach = lambda x, by: F.explode(F.sequence(cell(x - by), cell(x + by)))
    others = once.withColumn("c", reach(F.col("x"), F.lit(width))).withColumn("d", reach(F.col("s"), slack))
    large = own.groupBy("size", "c", "d").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts")).filter("parts > 1")
    cells = ["size", "c", "d"]
    dealt = own.join(F.broadcast(large), cells, "left").withColumn("part", F.pmod(F.xxhash64("p"), F.coalesce("parts", F.lit(1))).cast("int"))  # a row for each large cell
    met = others.join(F.broadcast(large), cells, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = dealt.select(*cells, "part", F.lit(0).alias("side"), "p", "n").union(met.select(*cells, "part", F.lit(1), "p", "n"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        own_rows: list[np.ndarray] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        mine, found = np.zeros((0, 0)), np.zeros(0, np.int64)

        def met_all() -> np.ndarray:
            if not waiting:
                return found
            theirs, times = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            return found + near(mine, theirs, times, width)

        def done() -> Iterator[pa.RecordBatch]:
            kept = found > 0
            if kept.any():
                yield pa.RecordBatch.from_pydict({"p": lists(mine[kept]), "n": pa.array(found[kept])})

        for batch in batches:
            keys = np.stack([np.asarray(batch[k], np.int64) for k in (*cells, "part", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *at, side = keys[:, a].tolist()
                data = stacked(batch["p"].slice(a, b - a), at[0]) if at[0] else np.zeros((b - a, 0))
                if tuple(at) != now:
                    found = met_all()
                    yield from done()
                    now, mine, found, own_rows = tuple(at), np.zeros((0, at[0])), np.zeros(0, np.int64), []
                if side == 0:
                    own_rows.append(data)
                    continue
                if own_rows:
                    mine, own_rows = np.concatenate(own_rows), []
                    found = np.zeros(len(mine), np.int64)
                if not len(mine):  # no point of its own in this cell
                    continue
                waiting.append((data, np.asarray(batch["n"].slice(a, b - a), np.int64)))
                if sum(len(x) for x, _ in waiting) > 1_000_000:
                    found = met_all()
        found = met_all()
        yield from done()

    counted = both.repartition(tasks, *cells, "part").sortWithinPartitions(*cells, "part", "side").mapInArrow(count, "p array<double>, n long")
    return rows.join(counted, "p").select("key", "n")
