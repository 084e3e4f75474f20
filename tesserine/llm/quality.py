"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with feature values x is sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the
pair sum is computed in linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2, summed over the factors.

Features: every distinct word, hashed to a slot, with the square root of its share of the document; the structure
statistics (shares of capitals, symbols, digits, separators, words that repeat their predecessor, distinct words, words
in other scripts' shapes, lines and repeated lines, mean word length); the metadata, which is the text's length in
characters and words. Statistics and metadata are cut into bins, one feature for each bin.

Fit: on the driver, by mini-batches with AdaGrad, over a sample of labelled rows whose size is a parameter.
Scores are calibrated by the labels' own rate, as the logistic loss gives probabilities.

Defined results: null text counts as empty and gets the score of a document with no words; documents with several
labels count once for each; repeated rows get equal scores; without labelled rows every score is 0.5. Whole texts are
read. Labels are read in training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Tokens, annotate, hash_strings, mix, slices, texts_of, unused, words

#: Bin edges of the share statistics, and of the statistics that count something.
SHARES = np.array([0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.9, 0.97])
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48, 96, 200, 400, 800, 1600, 3200, 6400, 25600])
#: Word classes, as patterns over whole words.
CLASSES = {
    "capitals": r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$",
    "no_letter": r"^[^\p{L}]+$",
    "symbol_run": r"[^\p{L}\p{N}\s]{2}",
    "digit": r"\p{Nd}",
    "marks_end": r"[!?]$",
    "link": r"://|@|www\.",
    "inner_capital": r"\p{Ll}\p{Lu}",
}
STATS = [*CLASSES, "repeats", "distinct", "per_line", "repeated_lines", "word_length", "words", "chars"]
COUNTED = {"per_line", "word_length", "words", "chars"}
BINS = 24


@dataclass
class Machine:
    """w0, linear weights and factors; the first len(STATS) * BINS features are the statistics' bins."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of the texts, one text after the other, and each text's number of features."""
    t = Tokens([words(x) for x in texts])
    n, owner, counts = len(texts), t.owner, np.diff(t.bounds)
    tokens = np.maximum(counts, 1)
    dictionary = pa.array(t.words, pa.string())

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=n) / tokens

    stats = {name: share(np.asarray(pc.match_substring_regex(dictionary, rule), dtype=np.float64)[t.codes]) if len(t.words) else np.zeros(n) for name, rule in CLASSES.items()}
    same = np.zeros(len(t.codes))
    if len(same):
        same[1:] = (t.codes[1:] == t.codes[:-1]) & (owner[1:] == owner[:-1])
    stats["repeats"] = share(same)
    # a text's distinct words: the key orders by text, then word
    key, tf = np.unique(owner * max(1, len(t.words)) + t.codes, return_counts=True)
    of, word = key // max(1, len(t.words)), key % max(1, len(t.words))
    stats["distinct"] = np.bincount(of, minlength=n) / tokens
    lengths = np.asarray(pc.utf8_length(dictionary), dtype=np.float64)
    stats["word_length"] = np.bincount(owner, weights=lengths[t.codes], minlength=n) / tokens if len(t.codes) else np.zeros(n)
    lines = [x.split("\n") for x in texts]
    stats["per_line"] = counts / np.array([len(x) for x in lines])
    stats["repeated_lines"] = np.array([1 - len(set(x)) / len(x) for x in lines])
    stats["words"], stats["chars"] = counts.astype(float), np.array([len(x) for x in texts], float)
    bins = np.stack([i * BINS + np.digitize(stats[s], COUNTS if s in COUNTED else SHARES) for i, s in enumerate(STATS)], axis=1)
    ids = len(STATS) * BINS + (mix(hash_strings(t.words)) % np.uint64(slots)).astype(np.int64)[word]
    values = np.sqrt(tf / tokens[of])
    # statistics first, then words
    own = np.bincount(of, minlength=n)
    sizes = own + len(STATS)
    starts = np.cumsum(sizes) - sizes
    all_ids, all_values = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.float64)
    at = (starts[:, None] + np.arange(len(STATS))).ravel()
    all_ids[at], all_values[at] = bins.ravel(), 1 / np.sqrt(len(STATS))
    rest = np.ones(len(all_ids), bool)
    rest[at] = False
    all_ids[rest], all_values[rest] = ids, values
    return all_ids, all_values, sizes


def raw_scores(m: Machine, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of each text before the sigmoid, and its factor sums, by the sum-of-squares identity."""
    starts = np.cumsum(sizes) - sizes
    vx = m.factors[ids] * values[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return m.bias + np.add.reduceat(m.linear[ids] * values, starts) + 0.5 * ((total * total).sum(axis=1) - squares), total


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, slots: int, factors: int = 8, epochs: int = 12, rate: float = 0.15, l2: float = 2e-4, batch: int = 64, seed: int = 3) -> Machine:
    rng = np.random.default_rng(seed)
    size = len(STATS) * BINS + slots
    share = min(0.999, max(0.001, float(labels.mean()))) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, factors)))
    g_linear, g_factors, g_bias = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            ids, values = (np.concatenate([samples[i][k] for i in chosen]) for k in (0, 1))
            sizes = np.array([len(samples[i][0]) for i in chosen])
            z, total = raw_scores(m, ids, values, sizes)
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(wrong, sizes) * values
            grad_v = each[:, None] * (np.repeat(total, sizes, axis=0) - m.factors[ids] * values[:, None])
            own, at = np.unique(ids, return_inverse=True)
            lin = np.bincount(at, weights=each, minlength=len(own)) + l2 * m.linear[own] / 10
            fac = np.stack([np.bincount(at, weights=grad_v[:, f], minlength=len(own)) for f in range(factors)], axis=1) + l2 * m.factors[own]
            g_linear[own] += lin * lin
            g_factors[own] += fac * fac
            g_bias += wrong.sum() ** 2
            m.linear[own] -= rate * lin / np.sqrt(g_linear[own])
            m.factors[own] -= rate * 0.3 * fac / np.sqrt(g_factors[own])
            m.bias -= rate * 0.3 * wrong.sum() / np.sqrt(g_bias)
    return m


def learn(docs: DataFrame, labels: DataFrame, learnable: F.Column, slots: int = 1 << 15, max_rows: int = 12_000, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Machine:
    """Fits on the learnable labelled rows, on about max_rows of them (a bound of the fit; chosen by a hash of the key)."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(F.col("y").isNotNull())
    rows = docs.filter(learnable).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = marked.count()
    if total > max_rows:
        some = F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / total))
        marked, rows = marked.filter(some), rows.filter(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            ids, values, sizes = features(texts_of(part, "t"), slots)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({
                "k": part["k"], "y": part["y"],
                "ids": pa.array([ids[e - s : e].astype(np.int32).tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
                "vals": pa.array([values[e - s : e].astype(np.float32).tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
            })

    joined = rows.join(marked, "k").select("k", F.col("y").cast("int").alias("y"), "t")
    got = [(r["y"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in joined.mapInArrow(run, "k long, y int, ids binary, vals binary").sort("k", "ids").toLocalIterator()]
    m = fit([(i.astype(np.int64), v.astype(np.float64)) for _, i, v in got], np.array([y for y, _, _ in got], float), slots, **options)
    return Machine(m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32))


def annotated(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of docs with their score, in one pass without a shuffle. The machine has a fixed number of slots."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value
        slots = len(m.linear) - len(STATS) * BINS

        def scores(texts: list[str | None]) -> list[pa.Array]:
            z, _ = raw_scores(m, *features([t or "" for t in texts], slots))
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return scores

    return annotate(docs, make, {name: "double"}, text)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    return annotated(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")), machine, "t").select("doc_id", "score")


def accepted(docs: DataFrame, machine: Machine, min_score: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score is min_score or more."""
    score = unused(docs, "quality")
    return annotated(docs, machine, text, score).filter(F.col(score) >= min_score).select(*(F.col(f"`{c}`") for c in docs.columns))
