"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Search. An item of which e words may be edited is cut into e + 1 blocks of equal lengths, or nearly so. Each edit falls into
one block at most, so a stretch of a document within e edits of the item holds one of its blocks whole, at a distance
of e words at most from where the block would be without edits. The blocks are kept as the levels of a trie (a set of
hashes for each length) and every word of a document goes down the trie; a block found there makes the window around it
a candidate.

Recall. 1: every match has a block that the search finds, wherever the edits lie, however many of the allowed ones there
are, and from items of min_words words on. Equal 64-bit hashes of different words or blocks could only add candidates.

Verification. The word edit distance between an item and the best stretch of the document around the window (any start
within the allowed edits, any end) is computed exactly; a match has at most max_edits * words of the item.

Words are parted by ASCII white space, lower-cased and stripped of all but letters and digits; those with neither are no
words. Items are broadcast in blocks of at most block_items; each block is
a pass over the documents. Documents need no shuffle; matches are few.

Defined results: null and empty texts match nothing, nor do items with fewer than min_words words; of several
windows where an item matches a document, the one with the fewest edits counts, then the first; repeated documents
and items give repeated matches, one for each pair of ids. Whole texts are searched. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Tokens, annotate, hash_strings, mix, ragged, slices, texts_of, unused, words

OTHER = regex.compile(r"[^\p{L}\p{N}]+")
NOTHING = np.uint64(0)
#: Pairs of a block and a place in a text that are compared at a time.
PAIRS = 1 << 18
SCHEMA = "doc_id long, item_id long, edits int, item_words int, start_word int"


@dataclass
class Plan:
    """The parameters of the search and the items' words (as hashes)."""

    ids: list[int]
    items: list[np.ndarray]
    max_edits: float

    def allowed(self, words: np.ndarray) -> np.ndarray:
        """The edits allowed to items of so many words."""
        return (self.max_edits * words).astype(np.int64)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of all words of the texts and the texts' bounds."""
    t = Tokens([words(x.lower()) for x in texts])
    bare = [w if w.isalnum() else OTHER.sub("", w) for w in t.words]
    h = np.where([bool(w) for w in bare], hash_strings(bare) | np.uint64(1), NOTHING)[t.codes] if len(t.codes) else np.zeros(0, np.uint64)
    kept = np.concatenate([[0], np.cumsum(h != NOTHING)])
    return h[h != NOTHING], kept[t.bounds]


class Searcher:
    """The items' blocks by length, as a trie of hashes."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.flat = np.concatenate([*plan.items, np.zeros(0, np.uint64)])
        self.lengths = np.array([len(x) for x in plan.items], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        many = plan.allowed(self.lengths) + 1
        item = np.repeat(np.arange(len(many)), many)
        nth = ragged(np.zeros(len(many), np.int64), many)
        offset = nth * self.lengths[item] // many[item]
        size = (nth + 1) * self.lengths[item] // many[item] - offset
        #: For each length: the hashes of longer blocks' beginnings; and the hashes, items and offsets of the blocks of that length.
        self.levels = []
        key = np.zeros(len(item), np.uint64)
        while len(item):
            level = len(self.levels)
            key = mix(key + self.flat[self.starts[item] + offset + level])
            ends = size == level + 1
            order = np.argsort(key[ends], kind="stable")
            self.levels.append((np.unique(key[~ends]), key[ends][order], item[ends][order], offset[ends][order]))
            key, item, offset, size = key[~ends], item[~ends], offset[~ends], size[~ends]
        #: For each item its words, hashed with the item.
        self.own = np.unique(self.mixed(np.repeat(np.arange(len(self.lengths)), self.lengths), self.flat))

    @staticmethod
    def mixed(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return words ^ (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, texts and where in words the item begins if nothing before the block is edited; some PAIRS at a time."""
        own, code = np.unique(words, return_inverse=True)
        end = np.repeat(bounds[1:], np.diff(bounds))
        at, key = np.arange(len(words)), None
        for level, (longer, keys, items, offsets) in enumerate(self.levels):
            if level:
                at, key = at[at + level < end[at]], key[at + level < end[at]]
                key = mix(key + words[at + level])
            else:
                # most words begin no block: one lookup for each distinct word
                first = mix(own)
                at = np.flatnonzero((among(first, longer) | among(first, keys))[code])
                key = first[code[at]]
            if len(keys):
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                found = np.flatnonzero(high > low)
                done = np.cumsum((high - low)[found])
                for f in np.split(found, np.searchsorted(done, np.arange(PAIRS, done[-1], PAIRS)) if len(done) else []):
                    which = ragged(low[f], (high - low)[f])
                    place = np.repeat(at[f], (high - low)[f])
                    yield items[which], np.searchsorted(bounds, place, "right") - 1, place - offsets[which]
            there = among(key, longer)
            at, key = at[there], key[there]

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, start) for the candidates within the allowed edits."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, text, begin in self.candidates(words, bounds) if len(words) else ():
            # items of one length at a time, so that patterns and areas are tables
            order = np.argsort(self.lengths[item], kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(self.lengths[item][order])) + 1):
                for s in range(0, len(group), 4096):
                    part = group[s : s + 4096]
                    if len(part):
                        self.compare(words, bounds, item[part], text[part], begin[part], best)
        return [(t, i, e, b) for (t, i), (e, b) in best.items()]

    def compare(self, words: np.ndarray, bounds: np.ndarray, item: np.ndarray, text: np.ndarray, begin: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to best what of some candidates, whose items are of one length, is within the allowed edits."""
        length = int(self.lengths[item[0]])
        allowed = int(self.plan.allowed(self.lengths[item[:1]])[0])
        low = np.maximum(bounds[text], begin - allowed)
        _, once = np.unique(np.stack([item, low]), axis=1, return_index=True)
        item, text, low = item[once], text[once], low[once]
        at = low[:, None] + np.arange(length + 2 * allowed)
        area = np.where(at < bounds[text + 1][:, None], words[np.minimum(at, len(words) - 1)], NOTHING)
        # an item's words that the area lacks each cost an edit
        likely = among(self.mixed(item[:, None], area), self.own).sum(axis=1) >= length - allowed
        item, text, low, area = item[likely], text[likely], low[likely], area[likely]
        edits = edit_distances(self.flat[self.starts[item][:, None] + np.arange(length)], area)
        for t, i, e, b in zip(text.tolist(), item.tolist(), edits.tolist(), (low - bounds[text]).tolist(), strict=True):
            if e <= allowed:
                best[t, i] = min(best.get((t, i), (e, b)), (e, b))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is one of known (ascending)."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(x.shape, bool)


def edit_distances(pattern: np.ndarray, areas: np.ndarray) -> np.ndarray:
    """The least edit distance between the pattern (one for all areas, or one for each) and any stretch of each area."""
    width = areas.shape[1]
    ramp = np.arange(width + 1)
    row = np.zeros((len(areas), width + 1), np.int64)
    for i, word in enumerate(pattern.T, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (areas != word[..., None]), row[:, 1:] + 1)
        # insertions: the least of new[j'] + (j - j') for j' <= j
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(axis=1)


def plans(benchmark: DataFrame, max_edits: float, min_words: int, block_items: int, item_key: str, item_text: str) -> Iterator[Plan]:
    """The items in blocks; one plan at least."""
    if not 0 <= max_edits < 1:
        raise ValueError("max_edits is a share of an item's words, below 1")
    block: list = []
    some = False
    rows = benchmark.select(F.col(item_key).cast("long").alias("k"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).toLocalIterator()
    for r in rows:
        block.append(r)
        if len(block) == block_items:
            yield plan_of(block, max_edits, min_words)
            block, some = [], True
    if block or not some:
        yield plan_of(block, max_edits, min_words)


def plan_of(block: list, max_edits: float, min_words: int) -> Plan:
    flat, bounds = hashed([r["t"] for r in block])
    items = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    usable = [i for i, w in enumerate(items) if len(w) >= max(1, min_words)]
    return Plan([block[i]["k"] for i in usable], [items[i] for i in usable], max_edits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, min_words: int = 5, block_items: int = 20_000, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_words, start_word for each document and item that match."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def search(plan: Plan) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(plan)  # at most block_items items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            searcher = Searcher(p)
            for part in slices(batches, "t"):
                ids = part["k"].to_pylist()
                got = searcher.matches(*hashed(texts_of(part, "t")))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[t] for t, _, _, _ in got], pa.int64()), "item_id": pa.array([p.ids[i] for _, i, _, _ in got], pa.int64()), "edits": pa.array([e for _, _, e, _ in got], pa.int32()),
                    "item_words": pa.array([len(p.items[i]) for _, i, _, _ in got], pa.int32()), "start_word": pa.array([b for _, _, _, b in got], pa.int32()),
                })

        return rows.mapInArrow(run, SCHEMA)

    found = [search(p) for p in plans(benchmark, max_edits, min_words, block_items, item_key, item_text)]
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, min_words: int = 5, block_items: int = 20_000, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item matches, in one pass for each block of items and without a shuffle."""
    columns, flag = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "leaks")
    for plan in plans(benchmark, max_edits, min_words, block_items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(plan)  # at most block_items items

        def make(shared: object = shared):
            searcher = Searcher(shared.value)

            def leaks(texts: list[str | None]) -> list[pa.Array]:
                flags = np.zeros(len(texts), bool)
                flags[[t for t, _, _, _ in searcher.matches(*hashed([t or "" for t in texts]))]] = True
                return [pa.array(flags)]

            return leaks

        docs = annotate(docs, make, {flag: "boolean"}, text).filter(~F.col(flag)).select(*columns)
    return docs
