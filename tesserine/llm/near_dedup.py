"""Near-duplicate detection by ProbMinHash over weighted word shingles, banding and exact verification.

Similarity. A text is read twice: as words parted by ASCII white space, and as bare words (runs of letters and digits),
both lower-cased. A reading's shingles are its runs of five words; a shorter text is one shingle. Two texts are as
similar as the most alike of: the probability Jaccard of their shingle counts, and the Jaccard of their shingle sets, in
either reading. A pair is a link if that is 0.8 or more (threshold). Bare readings without any word are alike to nothing.

Signature. A shingle of weight w is a Poisson process of rate w whose arrivals fall on random components of the
signature; a component keeps the shingle that arrived first. Two texts agree in a component with the probability Jaccard
similarity of their weights. Arrivals after the latest first arrival of all components change nothing, so a text ends
its processes there. Every measure has signatures of its own: for each reading one of the counts and, where shingles
repeat, one of the set (all weights 1; where nothing repeats the two are the same).

Banding. Components are banded (25 bands of 5: a pair of similarity 0.8 meets with probability 0.99995). Equal texts are
one node from the start. In each bucket, all members are compared with one centre, the member that meets most texts in
all its buckets; this is linear in a bucket's size and joins most of what belongs together.

The rest of a bucket. Texts in buckets whose members are then not all in one component are compared by an exact join on
rare shingles. Their shingles are put in one order, rare ones first (by a count table of fixed size; any order would be
right, this one makes groups small). What precedes the first shingle that two texts have in common is not common, so a
link has less than 1 - threshold of either text's weight before it: only shingles up to there are looked at, and a pair
is compared only where the weights a and b before its common shingle allow a similarity of
min(1 / (1/(1-a) + b/(1-b)), 1 / (a/(1-a) + 1/(1-b))), at most reached, of threshold or more, and where parities allow it:
a text's shingles are dealt over 512 bits, each bit says whether their number is odd, and two sets differ in at least as
many shingles as their bits differ. So no link between such texts is missing from the classes, wherever in a bucket they
are and however large it is; what many texts share comes last in their order and makes no pairs.

Verification. All pairs are compared exactly, by whole texts. Classes are the connected components of links, found by
alternating stars; tables between steps are files in the shared folder. No pair, link or component passes through the
driver.

Defined results: null text counts as empty; empty texts are equal texts, thus one class. Every row has a result;
repeated rows and equal ids get equal classes if their texts are equal. A class is named by its smallest id (null only
if it has no other). Ties among centres go to the larger digest. Very long texts are read whole. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import Tokens, bounded_batches, dropped, hash_strings, mix, ragged, released, slices, texts_of, unused, words, written

SHINGLE = 5
BARE = regex.compile(r"[\p{L}\p{N}]+")
#: Shingles (16 bytes each) that a worker keeps of the texts it has compared.
KEPT = 2_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the table of shingle counts (a byte each, broadcast): more shingles only make the order less exact.
CELLS = 1 << 22
#: Bits of the parities of a text's shingles, and the columns that hold them.
BITS = 512
PARITIES = [f"p{i}" for i in range(BITS // 64)]
#: Bits of the table by which rows whose text is not needed are left out before a shuffle (8 bytes a 64, broadcast).
SIEVE = 1 << 26
#: Rows of a shingle's group that are dealt to one task at a time.
BLOCK = 500


def shingled(hashes: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (ascending) and their counts, text after text, and each text's number of distinct shingles.

    hashes: those of the texts' words; bounds: where each text begins and ends among them."""
    lengths = np.diff(bounds)
    each = np.where(lengths > 0, np.maximum(1, lengths - n + 1), 0)
    first = ragged(bounds[:-1], each)
    # texts of fewer words are one shingle, whose missing words count as their places
    ends = np.cumsum(each)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    s = np.zeros(len(first), np.uint64)
    for j in range(n):
        word = padded[first + j]
        if j:
            word[ends[short[lengths[short] <= j]] - 1] = j
        word += s
        s = mix(word)
    owner = np.repeat(np.arange(len(lengths)), each)
    for x, y in zip((ends - each).tolist(), ends.tolist(), strict=True):
        s[x:y].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return s[starts], np.diff(np.append(starts, len(s))), np.bincount(owner[starts], minlength=len(lengths))


def readings_of(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The shingles of all texts for words as written and for bare words."""
    t = Tokens([words(x.lower()) for x in texts])
    written_ = hash_strings(t.words)
    # a word of letters and digits alone is its own bare word, with the same hash
    marked = [i for i, w in enumerate(t.words) if not w.isalnum()]
    bare = [BARE.findall(t.words[i]) for i in marked]
    counts = np.ones(len(t.words), np.int64)
    counts[marked] = np.fromiter(map(len, bare), np.int64, len(bare))
    starts = np.cumsum(counts) - counts
    plain = np.ones(len(t.words), bool)
    plain[marked] = False
    piece_hashes = np.zeros(int(counts.sum()), np.uint64)
    piece_hashes[starts[plain]] = written_[plain]
    piece_hashes[ragged(starts[marked], counts[marked])] = hash_strings(chain.from_iterable(bare))
    many = counts[t.codes]
    own = piece_hashes[ragged(starts[t.codes], many)]
    ends = np.concatenate([[0], np.cumsum(many)])
    return shingled(written_[t.codes], t.bounds), shingled(own, ends[t.bounds])


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct weightings of each text: the text of each weighting, hashes, weights, and each weighting's size.

    Those are the counts of words as written; the set of these where some repeat; and both for bare words where the
    shingles differ and there are any."""
    owners, hashes, weights, sizes = [], [], [], []
    first: tuple | None = None
    for s, c, n in readings_of(texts):
        bounds = np.concatenate([[0], np.cumsum(n)])
        take = np.ones(len(texts), bool)
        if first is not None:
            fs, fc, fn, fb = first
            same = n == fn
            # of texts with as many shingles: whether all shingles and counts agree
            at = np.flatnonzero(same & (n > 0))
            x, y = ragged(bounds[at], n[at]), ragged(fb[at], n[at])
            alike = (s[x] == fs[y]) & (c[x] == fc[y])
            same[at] = np.add.reduceat(alike.astype(np.int64), np.cumsum(n[at]) - n[at]) == n[at] if len(at) else same[at]
            take = ~same & (n > 0)
        repeats = np.zeros(len(texts), bool)
        repeats[np.repeat(np.arange(len(texts)), n)[c > 1]] = True
        for which, w in ((take, c), (take & repeats, np.ones_like(c))):
            at = np.flatnonzero(which)
            rows = ragged(bounds[at], n[at])
            owners.append(at)
            hashes.append(s[rows])
            weights.append(w[rows])
            sizes.append(n[at])
        first = first or (s, c, n, bounds)
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(weights), np.concatenate(sizes)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signatures (texts x m): all texts' processes run in rounds, one arrival of each open process a round."""
    texts = len(sizes)
    owner = np.repeat(np.arange(texts), sizes)
    least, sig, limit = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64), np.full(texts, np.inf)
    state, at, h, w, o = mix(hashes), np.zeros(len(hashes)), hashes, weights.astype(np.float64), owner
    while len(h):
        state = mix(state + STEP)
        at = at - np.log(uniform(state)) / w
        place = o * m + (mix(state ^ h) % np.uint64(m)).astype(np.int64)
        sooner = at < least[place]
        p, a, g = place[sooner], at[sooner], h[sooner]
        np.minimum.at(least, p, a)
        won = a == least[p]
        sig[p[won]] = g[won]
        still = np.unique(o) if len(o) < texts else slice(None)
        limit[still] = least.reshape(texts, m)[still].max(axis=1)
        going = at < limit[o]
        state, at, h, w, o = state[going], at[going], h[going], w[going], o[going]
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different between bands."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            k = mix(k * STEP + sig[:, b * rows + r])
        out[:, b] = k
    return out.view(np.int64)


def jaccards(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the set Jaccard and the probability Jaccard of two texts' shingles (hashes ascending, counts)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]):
        a, b = b, a
    j = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][j] == a[0])
    j = j[i]
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if plain >= 1 or not len(i):
        return plain
    total_a, total_b = a[1].sum(), b[1].sum()
    if total_a == len(a[0]) and total_b == len(b[0]):
        return plain
    wa, wb = a[1][i].astype(float), b[1][j].astype(float)
    # for a common shingle d, the sum over all shingles e of max(a_e / a_d, b_e / b_d): those with a_e / b_e above
    # d's ratio count by a, the others by b
    only_a, only_b = total_a - wa.sum(), total_b - wb.sum()
    ratio = wa / wb
    order = np.argsort(ratio)
    sa, sb, r = wa[order], wb[order], ratio[order]
    low = np.concatenate([[0], np.cumsum(sb)])[np.searchsorted(r, r, "left")] + only_b
    high = sa.sum() - np.concatenate([[0], np.cumsum(sa)])[np.searchsorted(r, r, "left")] + only_a
    return max(plain, float((1 / (high / sa + low / sb)).sum()))


def readings(texts: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's shingles and counts, for words as written and for bare words."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for s, c, n in readings_of(texts):
        bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
        for own, x, y in zip(out, bounds, bounds[1:]):
            own.append((s[x:y], c[x:y]))
    return out


def likeness(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The similarity of two texts by their readings."""
    as_written, bare = zip(x, y, strict=True)
    return max(jaccards(*as_written), jaccards(*bare) if len(bare[0][0]) and len(bare[1][0]) else 0.0)


def similarity(a: str, b: str) -> float:
    return likeness(*readings([a, b]))


def text_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, node (the text's 128-bit digest), t."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("k"), F.unhex(F.md5(t.cast("binary"))).alias("node"), t.alias("t"))


def banded(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """The distinct band keys of each row's text, for all its weightings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 1 << 20):
            owner, s, w, sizes = measured(texts_of(part, "t"))
            keys = band_keys(signatures(s, w, sizes, bands * per_band), bands, per_band)
            pairs = np.stack([np.repeat(owner, bands), keys.ravel()])
            pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
            new = np.ones(pairs.shape[1], bool)
            new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
            pairs = pairs[:, new]
            ends = np.searchsorted(pairs[0], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["k"], part["node"], pa.ListArray.from_arrays(ends, pa.array(pairs[1], pa.int64()))], ["k", "node", "bands"])
        released()

    return rows.mapInArrow(run, "k long, node binary, bands array<long>")


def sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose node is in wanted, and some others: those whose hash falls on the bit of one. No shuffle of rows."""

    def place(node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(SIEVE))

    bits = wanted.select(place("node").alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits"))
    there = rows.join(F.broadcast(bits), F.shiftright(place("node"), 6) == F.col("word"))  # at most SIEVE / 64 rows
    return there.filter(F.expr(f"(shiftright(bits, cast(pmod(xxhash64(node), {SIEVE}L) & 63 AS int)) & 1) = 1")).select(*rows.columns)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, t) are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        held = 0
        for part in slices(batches, "tb", 1 << 20):
            if held > KEPT:
                known.clear()
                held = 0
            nodes = [part[c].to_pylist() for c in ("a", "b")]
            new: dict[bytes, str] = {}
            for column, ids in zip(("ta", "tb"), nodes, strict=True):
                at = {x: i for i, x in enumerate(ids) if x not in known and x not in new}
                new |= zip(at, part[column].take(pa.array(list(at.values()), pa.int64())).to_pylist(), strict=True)
            # a megabyte of texts is shingled at a time, however long the other side's are
            some, size = [], 0
            for x in new:
                some.append(x)
                size += len(new[x])
                if size > 1 << 20:
                    known |= zip(some, readings([new[y] for y in some]), strict=True)
                    some, size = [], 0
            known |= zip(some, readings([new[y] for y in some]), strict=True)
            held += sum(64 + len(s) for x in new for s, _ in known[x])
            keep = [likeness(known[a], known[b]) >= threshold for a, b in zip(*nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        known.clear()
        released()

    return both.mapInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each linked node's component, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = now = None
    while state is None or now != state:
        state = now
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        dropped(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def counted(texts: DataFrame) -> np.ndarray:
    """A byte for each cell of shingles: four times the binary logarithm of how often its shingles occur in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            cell, n = np.unique(np.concatenate([s % np.uint64(CELLS) for s, _, _ in readings_of(texts_of(part, "t"))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n, pa.int64())], ["cell", "n"])

    sums = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    got = sums.select("cell", F.round(4 * F.log2("n")).cast("short").alias("level")).toArrow()  # at most CELLS rows
    levels = np.zeros(CELLS, np.uint8)
    levels[got["cell"].to_numpy()] = got["level"].to_numpy()
    return levels


def rare_shingles(texts: list[str], levels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles that may be the first which a text has in common with a similar one: the text, the shingle, the share
    of the text's weight that precedes it; and of its weighting the number of shingles (0 if weights differ) and parities."""
    owner, s, w, sizes = measured(texts)
    which = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((s, levels[s % np.uint64(CELLS)], which))
    s, w = s[order], w[order].astype(float)
    total = np.bincount(which, weights=w, minlength=len(sizes))
    before = np.cumsum(w) - w
    starts = np.cumsum(sizes) - sizes
    share = (before - np.repeat(before[starts[sizes > 0]], sizes[sizes > 0])) / total[which]
    near = share <= 1 - threshold + 1e-9
    sets = np.where(total == sizes, sizes, 0)
    odd = np.bincount(which * BITS + (s % np.uint64(BITS)).astype(np.int64), minlength=len(sizes) * BITS).astype(np.uint8) & 1
    parities = np.packbits(odd.reshape(len(sizes), BITS), axis=1).view(np.int64)
    which = which[near]
    return owner[which], s[near], share[near], sets[which], parities[which]


def rest_pairs(open_: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes of different components that may be links. open_: node, root, t."""
    shared = open_.sparkSession.sparkContext.broadcast(counted(open_))  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 1 << 20):
            owner, s, share, sets, parities = rare_shingles(texts_of(part, "t"), shared.value, threshold)
            at = pa.array(owner)
            columns = [part["node"].take(at), part["root"].take(at), pa.array(s.view(np.int64)), pa.array(share), pa.array(sets, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in parities.T)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "root", "s", "share", "sets", *PARITIES])
        released()

    rare = written(open_.mapInArrow(run, f"node binary, root binary, s long, share double, sets long, {', '.join(f'{p} long' for p in PARITIES)}"), "rare")
    groups = rare.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    most = lambda a, b: F.least(1 / (1 / (1 - a) + b / (1 - b)), 1 / (a / (1 - a) + 1 / (1 - b))) >= threshold - 1e-9
    live = written(rare.join(groups.filter("lo <> hi").select("s", "n", "least"), "s").filter(most(F.col("share"), F.col("least"))), "rare")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    kept = ["node", "root", "share", "sets", *PARITIES]
    left = live.select("s", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), *(F.col(c).alias(f"a_{c}") for c in kept))
    right = live.select("s", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *(F.col(c).alias(f"b_{c}") for c in kept))
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES))
    few = (F.col("a_sets") == 0) | (F.col("b_sets") == 0) | (differ <= (1 - threshold) / (1 + threshold) * (F.col("a_sets") + F.col("b_sets")) + 1e-6)
    met = left.join(right, ["s", "block"]).filter((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & most(F.col("a_share"), F.col("b_share")) & few)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def class_tables(docs: DataFrame, threshold: float, bands: int, per_band: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """k and node of every row; and of every node its class_id, class_size and whether it is the class's first."""
    bounded_batches(docs.sparkSession)
    rows = text_rows(docs, key, text)
    found = written(banded(rows, bands, per_band), "bands")
    nodes = written(found.groupBy("node").agg(F.min("k").alias("first"), F.min("bands").alias("bands")), "nodes")

    members = nodes.select("node", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(members.join(sizes, "key"), "buckets")
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets")).join(nodes.select("node", "first"), "node")
    meets = written(meets, "meets")
    heads = meets.select("node", F.col("first").alias("f"))
    texts = written(sieved(rows, heads).join(heads, "node").filter(F.col("k").eqNullSafe(F.col("f"))).select("node", "t").dropDuplicates(["node"]), "texts")

    placed = written(shared.join(meets.select("node", "meets"), "node"), "placed")
    centres = placed.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    pairs = placed.join(centres, "key").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).filter("a <> b").distinct()
    pairs = written(pairs, "pairs")
    links = written(verified(pairs, texts, threshold), "links")
    roots = written(components(links), "roots")

    labelled = shared.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = written(labelled, "labelled")
    open_ = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    apart = labelled.join(open_, "key").select("node", "root").distinct().join(texts, "node").select("node", "root", "t")
    rest = written(rest_pairs(written(apart, "apart"), threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(rest, texts, threshold), "links")
    if not more.isEmpty():
        roots = written(components(links.union(more)), "roots")

    copies = found.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("k").alias("first"))
    own = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("first").isNull(), "first", "node")
    classes = own.groupBy("root").agg(F.min(order).alias("head"), F.sum("copies").alias("class_size"))
    by_node = own.join(classes, "root").select("node", F.col("head.first").alias("class_id"), "class_size", (F.col("head.node") == F.col("node")).alias("is_head"))
    return found.select("k", "node"), by_node


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 25, per_band: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id and class_size for every row."""
    found, by_node = class_tables(docs, threshold, bands, per_band, key, text)
    return found.join(by_node, "node").select(F.col("k").alias("doc_id"), "class_id", "class_size")


def deduplicated(docs: DataFrame, threshold: float = 0.8, bands: int = 25, per_band: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class one, the row with the smallest id (of equal ids, the smallest digest).

    Texts are looked up by id and digest; of rows that agree in both, one stays."""
    _, by_node = class_tables(docs, threshold, bands, per_band, key, text)
    node, first, k, digest, n = (unused(docs, x) for x in ("node", "first", "k", "digest", "n"))
    heads = by_node.filter("is_head").select(F.col("node").alias(node), F.col("class_id").alias(first))
    keyed = docs.withColumns({k: F.col(key).cast("long"), digest: F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))})
    kept = keyed.join(heads, (F.col(digest) == F.col(node)) & F.col(k).eqNullSafe(F.col(first)))
    one = Window.partitionBy(digest, k).orderBy(F.lit(1))
    return kept.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
