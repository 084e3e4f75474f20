"""Machine-learning workloads whose passes over the data are aggregates; parameters are small and live on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.graph import checkpointed

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


def squared_distance(point: Column, centre: Sequence[float]) -> Column:
    c = F.array(*map(F.lit, map(float, centre)))
    return F.aggregate(F.zip_with(point, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(point: Column, centres: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest centre (the first of equals)."""
    return F.array_min(F.array(*(F.struct(squared_distance(point, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]


def kmeans(points: DataFrame, column: str, centres: list[list[float]], tolerance: float = 1e-3, most: int = 20) -> list[list[float]]:
    """Centres after at most that many rounds from the given ones; a centre without points stays. Points that are null or
    of another length take no part. Each round's plan is the same, and a task sends one row for each centre."""
    import numpy as np
    import pyarrow as pa

    now = np.array(centres, float)
    k, dim = now.shape
    p = F.col(column).cast("array<double>")
    rows = points.select(p.alias("p")).filter((F.size("p") == dim) & ~F.exists("p", lambda x: x.isNull())).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(most):

        def add_up(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, dim + 1))
            for batch in batches:
                x = np.asarray(batch["p"].flatten()).reshape(-1, dim)
                own = np.stack([((x - c) ** 2).sum(axis=1) for c in now]).argmin(axis=0)
                for c in np.unique(own):
                    sums[c, :dim] += x[own == c].sum(axis=0)
                    sums[c, dim] += (own == c).sum()
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(k), pa.int32()), "s": pa.array(sums.tolist(), pa.list_(pa.float64()))})

        parts = rows.mapInArrow(add_up, "c int, s array<double>").select("c", F.posexplode("s").alias("i", "v"))
        found = np.zeros((k, dim + 1))
        for r in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # k rows of dim + 1 numbers
            found[r["c"], r["i"]] = r["v"]
        n = found[:, dim:]
        new = np.where(n > 0, found[:, :dim] / np.maximum(n, 1), now)
        moved, now = ((new - now) ** 2).sum(axis=1).max(), new
        if moved < tolerance**2:
            break
    rows.unpersist()
    return now.tolist()


def _moments(df: DataFrame, xs: Sequence[Column], y: Column, weight: Column | None = None) -> tuple[list[list[float]], list[float]]:
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    r = df.agg(*(F.sum(w * xs[i] * xs[j]).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(w * x * y).alias(f"b{i}") for i, x in enumerate(xs))).first()
    a = [[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))]
    return a, [r[f"b{i}"] for i in range(len(xs))]


def linear_regression(df: DataFrame, xs: Sequence[Column], y: Column, weight: Column | None = None) -> list[float]:
    """Least squares by the normal equations, from one pass; with a weight column locally weighted."""
    import numpy as np

    a, b = _moments(df, [F.lit(1.0), *xs], y, weight)
    return np.linalg.lstsq(np.array(a, float), np.array(b, float), rcond=None)[0].tolist()


def unnormalised_step(df: DataFrame, xs: Sequence[Column], y: Column) -> list[float]:
    """(X'X)(X'y), without the inverse."""
    a, b = _moments(df, xs, y)
    return [sum(p * q for p, q in zip(row, b, strict=True)) for row in a]


def logistic_regression(df: DataFrame, xs: Sequence[Column], y: Column, rate: float = 1.0, tolerance: float = 1e-3, most: int = 30) -> list[float]:
    """Batch gradient steps, each one aggregation; the step is the mean gradient times the rate. Rows with a null take no
    part."""
    names = [f"x{i}" for i in range(len(xs))]
    rows = df.select(*(x.cast("double").alias(n) for x, n in zip(xs, names, strict=True)), y.cast("double").alias("y")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    theta = [0.0] * len(xs)
    n = rows.count()
    for _ in range(most if n else 0):
        z = reduce(lambda a, b: a + b, [F.lit(t) * F.col(x) for t, x in zip(theta, names, strict=True)])
        wrong = F.col("y") - 1 / (1 + F.exp(-z))
        step = [rate * g / n for g in rows.agg(*(F.sum(wrong * F.col(x)) for x in names)).first()]
        theta = [t + s for t, s in zip(theta, step, strict=True)]
        if sum(map(abs, step)) < tolerance:
            break
    rows.unpersist()
    return theta


def support_vector_machine(df: DataFrame, xs: Sequence[Column], y: Column, cost: float = 1.0, tolerance: float = 1e-3, most: int = 100) -> list[float]:
    """Bias and weights of the linear machine with the least w.w / 2 + cost * (sum of hinge losses); y is 1 or 0.

    The primal is solved over aggregates of all rows, so no pairs of rows are chosen and the result doesn't depend on
    chance. Rows with a null take no part; without rows, all are 0."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.array(*(x.cast("double") for x in xs)).alias("x"), y.cast("double").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & ~F.exists("x", lambda v: v.isNull())).select(array_to_vector("x").alias("x"), "label")
    n = rows.count()
    if not n:
        return [0.0] * (len(xs) + 1)
    found = LinearSVC(featuresCol="x", regParam=1 / (cost * n), tol=tolerance, maxIter=most, standardization=False).fit(rows)
    return [found.intercept, *found.coefficients.toArray().tolist()]


def svm_classify(weights: Sequence[float], xs: Sequence[Column]) -> Column:
    """1 or -1: the side of a point, by the bias and weights of a linear machine; 0 counts to the side of 1."""
    z = reduce(lambda a, b: a + b, [F.lit(w) * x for w, x in zip(weights[1:], xs, strict=True)], F.lit(weights[0]))
    return F.when(z < 0, -1).otherwise(1)


def gaussian_discriminant(df: DataFrame, xs: Sequence[Column], y: Column) -> DataFrame:
    """One row: phi, the class means m0_i and m1_i, and the unnormalised scatter s_i_j around the own class's mean."""
    one = y == 1
    of = lambda c, x: F.when(one == F.lit(bool(c)), x)
    means = [F.avg(of(c, x)).alias(f"m{c}_{i}") for c in (0, 1) for i, x in enumerate(xs)]
    part = lambda c, i, j: F.coalesce(F.covar_pop(of(c, xs[i]), of(c, xs[j])) * F.count_if(one == F.lit(bool(c))), F.lit(0.0))
    scatter = [(part(0, i, j) + part(1, i, j)).alias(f"s_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    return df.agg(F.avg(F.when(one, 1.0).otherwise(0.0)).alias("phi"), *means, *scatter)


def naive_bayes(tokens: DataFrame, token: str = "token", label: str = "label", most_labels: int = 10_000) -> DataFrame:
    """token, label, n, log_p with Laplace smoothing over all pairs of a known token and a label, from token rows.

    Labels are few: more than most_labels raise. Their totals are part of the plan."""
    counts = tokens.groupBy(token, label).agg(F.count(F.lit(1)).alias("n"))
    wide = checkpointed(counts.groupBy(token).agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("by")))
    totals = wide.select(F.explode("by").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).limit(most_labels + 1).collect()
    if len(totals) > most_labels:
        raise ValueError("too many labels")
    v = wide.count()
    each = F.array(*(F.struct(F.lit(r["label"]).alias(label), F.lit(r["n"]).alias("total")) for r in totals))
    rows = wide.select(token, "by", F.inline(each)) if totals else wide.select(token, "by", F.lit(None).cast(tokens.schema[label].dataType).alias(label), F.lit(0).alias("total")).limit(0)
    rows = rows.withColumn("n", F.coalesce(F.try_element_at("by", F.col(label)), F.lit(0)))
    return rows.select(token, label, "n", F.log((F.col("n") + 1) / (F.col("total") + F.lit(v))).alias("log_p"))


def naive_bayes_classify(tokens: DataFrame, model: DataFrame, priors: DataFrame, key: str = "key", token: str = "token", label: str = "label") -> DataFrame:
    """key, predicted: of each key's tokens the label with the highest sum of log_p and log_prior over all of them (each
    token brings the prior again); ties go to the smaller label. Unknown tokens don't count."""
    known = tokens.groupBy(key, token).agg(F.count(F.lit(1)).alias("times")).join(model, token)
    scores = known.join(F.broadcast(priors), label).groupBy(key, label).agg(F.sum(F.col("times") * (F.col("log_p") + F.col("log_prior"))).alias("score"))  # a row for each label
    best = F.min_by(label, F.struct(-F.round("score", 9), F.col(label)))
    return scores.groupBy(key).agg(best.alias("predicted"))


def bands_of(items: np.ndarray, bands: int) -> np.ndarray:
    """The band that each item is dealt to."""
    import numpy as np

    return ((items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(bands)


def suffixes(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """band, items, xs: for each band with items of a user, the user's items from the first of those on, as bytes; from
    rows of sorted items and their ratings xs."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        size = 0
        for row in range(batch.num_rows):
            items, xs = (np.asarray(batch[c].slice(row, 1).flatten()) for c in ("items", "xs"))
            for band, at in zip(*np.unique(bands_of(items, bands), return_index=True), strict=True):
                if at < len(items) - 1:
                    for o, v in zip(out, (int(band), items[at:].tobytes(), xs[at:].tobytes()), strict=True):
                        o.append(v)
                    size += 16 * (len(items) - at)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["band", "items", "xs"])
                out, size = ([], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["band", "items", "xs"])


def pair_sums(batches: Iterator[pa.RecordBatch], bands: int, most: int) -> Iterator[pa.RecordBatch]:
    """item_a < item_b and the pair's number, sums, products and squares, from rows of suffixes() sorted by band: the items
    of the band with those after them. Sums are kept for one band; pairs to be added are opened about most at a time."""
    import numpy as np
    import pyarrow as pa

    def summed(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(a):
            return a, b, v
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[:, order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[at], b[at], np.add.reduceat(v, at, axis=1)

    now, held, fresh, texts, waiting = None, [], 0, [], 0

    def fold() -> None:
        nonlocal held, fresh
        held, fresh = [summed(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))] if held else [], 0

    def add() -> None:
        nonlocal fresh, texts, waiting
        if not texts:
            return
        item, x = np.frombuffer(b"".join(t for t, _ in texts), np.int64), np.frombuffer(b"".join(t for _, t in texts), float)
        ends = np.repeat(sizes := np.cumsum([len(t) // 8 for t, _ in texts]), np.diff(sizes, prepend=0))
        first = np.flatnonzero(bands_of(item, bands) == now)
        some = ends[first] - first - 1
        upto = np.cumsum(some)
        texts, waiting, at = [], 0, 0
        while at < len(first):  # items of about that many pairs
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            n = some[at:to]
            i = np.repeat(first[at:to], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
            a, b = x[i], x[j]
            held.append(summed(item[i], item[j], np.stack([np.ones(len(a)), a, b, a * b, a * a, b * b])))
            fresh += len(held[-1][0])
            at = to
            if fresh > max(most, len(held[0][0])):
                fold()

    def given() -> Iterator[pa.RecordBatch]:
        add()
        fold()
        for a, b, v in held:
            for i in range(0, len(a), 100_000):
                cut = slice(i, i + 100_000)
                yield pa.RecordBatch.from_pydict({"item_a": pa.array(a[cut]), "item_b": pa.array(b[cut]), "n": pa.array(v[0, cut].astype(np.int64)), **{k: pa.array(v[m, cut]) for m, k in enumerate(("a", "b", "ab", "aa", "bb"), 1)}})
        held.clear()

    for batch in batches:
        for band, items, xs in zip(batch["band"].to_pylist(), batch["items"].to_pylist(), batch["xs"].to_pylist(), strict=True):
            if band != now:
                yield from given()
                now = band
            texts.append((items, xs))
            waiting += len(items)
            if waiting > 4 << 20:
                add()
    yield from given()


def item_similarity(ratings: DataFrame, user: str = "user", item: str = "item", rating: str = "rating", block: int | None = None, most: int = 2_000_000, among: DataFrame | None = None) -> DataFrame:
    """item_a < item_b, common, similarity: the products of deviations from the pair's means over its common users, by the
    roots of the squares' sums + 1. With among, a table of a few items, only pairs with one of those.

    Items are dealt to bands, of about block items or of about most pairs; a user's items are sent, as bytes, to the bands
    they are in, where pairs are opened and summed up by one task. So no pair is shuffled, and a user of many items is dealt
    over tasks; a user's items must fit in memory."""
    spark = ratings.sparkSession
    r = ratings.select(F.col(user).alias("u"), F.col(item).alias("item"), F.col(rating).cast("double").alias("x")).dropna()
    n = F.col("n")
    if among is not None:
        r = r.groupBy("u", "item").agg(F.max("x").alias("x"))
        some = F.broadcast(among.toDF("item").distinct())  # a few items
        a, b = r.join(some, "item").toDF("i", "u", "a"), r.join(some.withColumn("both", F.lit(True)), "item", "left").select("u", F.col("item").alias("j"), F.col("x").alias("b"), "both")
        low = F.col("i") < F.col("j")
        pairs = a.join(b, "u").filter(F.when(F.col("both"), low).otherwise(F.col("i") != F.col("j")))
        pairs = pairs.select(F.least("i", "j").alias("item_a"), F.greatest("i", "j").alias("item_b"), F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"))
        sums = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    else:
        kind = r.schema["item"].dataType
        whole = isinstance(kind, T.IntegralType)
        if not whole:  # other items are numbered in their order
            numbers = checkpointed(r.select("item").distinct().orderBy("item").select("item", F.monotonically_increasing_id().alias("number")))
            r = r.join(numbers, "item").select("u", F.col("number").alias("item"), "x")
        each = r.repartition("u").groupBy("u", "item").agg(F.max("x").alias("x")).groupBy("u").agg(F.sort_array(F.collect_list(F.struct(F.col("item").cast("long").alias("i"), "x"))).alias("s"))
        users = checkpointed(each.filter(F.size("s") > 1).select(F.col("s.i").alias("items"), F.col("s.x").alias("xs")))
        size = F.size("items").cast("double")
        if block is None:
            bands = max(1, math.ceil((users.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0) / most))
        else:
            bands = max(1, math.ceil(users.select(F.explode("items")).distinct().count() / block))
        tasks = min(bands, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = users.mapInArrow(lambda batches: suffixes(batches, bands), "band int, items binary, xs binary").repartition(tasks, "band").sortWithinPartitions("band")
        sums = dealt.mapInArrow(lambda batches: pair_sums(batches, bands, most), "item_a long, item_b long, n long, a double, b double, ab double, aa double, bb double")
        for c in ("item_a", "item_b"):
            sums = sums.withColumn(c, F.col(c).cast(kind)) if whole else sums.join(numbers.toDF("text", c), c).drop(c).withColumnRenamed("text", c)
    num = F.col("ab") - F.col("a") * F.col("b") / n
    den = F.sqrt(F.greatest(F.col("aa") - F.col("a") * F.col("a") / n, F.lit(0.0))) * F.sqrt(F.greatest(F.col("bb") - F.col("b") * F.col("b") / n, F.lit(0.0)))
    return sums.select("item_a", "item_b", n.alias("common"), (num / (den + 1)).alias("similarity"))


def recommend(ratings: DataFrame, similarities: DataFrame, n: int, user: str = "user", item: str = "item", rating: str = "rating") -> DataFrame:
    """user, rank, item, preference: each user's n items of the highest preference, the ratings of similar items by
    similarity, over the similarities' absolute sum + 1. Items of no preference (0) are left out; ties go to the smaller item."""
    s = similarities.filter("similarity <> 0")
    both = s.select("item_a", "item_b", "similarity").union(s.select("item_b", "item_a", "similarity")).toDF("rated", "item", "s")
    own = ratings.select(F.col(user).alias("user"), F.col(item).alias("rated"), F.col(rating).cast("double").alias("x"))
    found = own.join(both, "rated").groupBy("user", "item").agg((F.sum(F.col("s") * F.col("x")) / (F.sum(F.abs("s")) + 1)).alias("preference")).filter("preference <> 0")
    best = Window.partitionBy("user").orderBy(F.desc("preference"), "item")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("user", "rank", "item", "preference")


def k_centers(points: DataFrame, key: str, column: str, k: int) -> list[list[float]]:
    """Farthest-first centres: the point with the smallest key, then each time the point farthest from its nearest centre
    (of equals, the one with the smallest key). The squared distance to the nearest centre so far is kept with each point."""
    first = points.orderBy(key).select(column).first()
    centres = [list(map(float, first[0]))] if first else []
    near = points.select(F.col(key).alias("k"), F.col(column).alias("p"), F.lit(float("inf")).alias("d"))
    while first and len(centres) < k:
        near = checkpointed(near.select("k", "p", F.least("d", squared_distance(F.col("p"), centres[-1])).alias("d")))
        centres.append(list(map(float, near.agg(F.max_by("p", F.struct("d", -F.col("k")))).first()[0])))
    return centres


def k_medoids(points: DataFrame, key: str, column: str, k: int, most: int = 20) -> list[int]:
    """Keys of medoids: from farthest-first centres, points go to the nearest medoid and each cluster takes, of the points
    next to its mean, the one with the least sum of distances to the cluster's points, as long as that lowers the sum.

    Candidates are the 16 points nearest to the mean of each cluster, so a round is linear in the points; sums of
    distances are over all points of the cluster. Ties go to the smaller key."""
    rows = points.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("p")).filter("k IS NOT NULL AND p IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    start = k_centers(rows, "k", "p", k)
    if not start:
        return []
    chosen = [(r["k"], list(r["p"])) for r in rows.filter(F.exists(F.array(*(F.array(*map(F.lit, c)) for c in start)), lambda c: c == F.col("p"))).groupBy("p").agg(F.min("k").alias("k")).orderBy("k").collect()]  # k rows
    for _ in range(most):
        medoids = [p for _, p in chosen]
        own = rows.withColumn("c", nearest(F.col("p"), medoids))
        dim = len(medoids[0])
        means = {r["c"]: [r[f"m{i}"] for i in range(dim)] for r in own.groupBy("c").agg(*(F.avg(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(dim))).collect()}
        picks: dict[int, list] = {}
        for c, mean in means.items():
            near = own.filter(F.col("c") == c).orderBy(squared_distance(F.col("p"), mean), "k").limit(16).collect()
            picks[c] = [chosen[c], *((r["k"], list(r["p"])) for r in near if r["k"] != chosen[c][0])]
        sums = [F.sum(F.when(F.col("c") == c, F.sqrt(squared_distance(F.col("p"), p)))).alias(f"{c}_{i}") for c, some in picks.items() for i, (_, p) in enumerate(some)]
        total = own.agg(*sums).first()
        new = list(chosen)
        for c, some in picks.items():
            costs = [(total[f"{c}_{i}"], i > 0, some[i][0], i) for i in range(len(some))]
            least = min(costs)
            if least[0] < costs[0][0]:
                new[c] = some[least[3]]
        if new == chosen:
            break
        chosen = new
    rows.unpersist()
    return [x for x, _ in chosen]


def value_iteration(transition: list[list[list[float]]], cost: list[list[float]], discount: float, tolerance: float = 1e-9, most: int = 10_000) -> list[float]:
    """Least expected discounted costs of a small decision process: actions x states x states, costs actions x states."""
    import numpy as np

    p, c = np.array(transition, float), np.array(cost, float)
    v = np.zeros(p.shape[1])
    for _ in range(most):
        new = (p @ v * discount + c).min(axis=0)
        if np.abs(new - v).max() < tolerance:
            return new.tolist()
        v = new
    return v.tolist()


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-(x - mean) * (x - mean) / (2 * deviation * deviation)) / F.sqrt(F.lit(2 * 3.141592653589793 * deviation * deviation))


def transposed(cells: DataFrame) -> DataFrame:
    """A matrix as cells (i, j, v), turned over."""
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices as cells (i, j, v); missing cells are 0. A vector is a matrix of one column."""
    met = a.toDF("i", "k", "a").join(b.toDF("k", "j", "b"), "k")
    return met.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def with_column_at(cells: DataFrame, position: int, column: DataFrame) -> DataFrame:
    """A matrix with a further column (i, v) before that of the given number."""
    moved = cells.select("i", (F.col("j") + F.when(F.col("j") >= position, 1).otherwise(0)).alias("j"), "v")
    return moved.unionByName(column.select("i", F.lit(position).cast(cells.schema["j"].dataType).alias("j"), "v"))


def row_sums(cells: DataFrame, keep: Column | None = None) -> DataFrame:
    """i, v: the sum of each row's cells, or of those that keep holds for; rows without any have 0."""
    v = F.col("v") if keep is None else F.when(keep, F.col("v")).otherwise(F.lit(0))
    return cells.groupBy("i").agg(F.sum(v).alias("v"))
