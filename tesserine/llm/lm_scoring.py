"""Language-model scoring with a log-frequency Bloom filter.

Counts. Words and word pairs of the training texts are hashed to 64 bits and counted in each batch first; a batch ships,
for each partition of the hash space, its sorted distinct keys with their counts and the predecessors of its pairs as byte
strings, so that the shuffle holds 9 bytes for a word and 17 for a pair or little more. A partition adds up its keys.

Filter. A count c is quantised to level 1 + floor(log_base(c)). A partition's part of the filter is a bit array sized by
its own insertions: a key of level L is inserted together with each of 1..L. A lookup probes levels 1, 2, ... until one
is missing; errors are one-sided and fall with each level. Besides the filter, a partition keeps its words' exact counts
for the base score. Words without a count are known as such, and pairs with one have level 0 whatever the filter says.

Normalisers. A partition looks its own keys up in its filter, so that what the filter gets wrong is summed as it will be
answered: q(u), the sum of q(u,w) over the training pairs of u, is added up by predecessor over the partitions, and kept
with each word as 16 bits of its logarithm (a relative error of at most 0.0004); the sum of q(w) over all words is one
number. So the probabilities of all words that followed u and of the rest sum to 1, but for pairs that never occurred and
that the filter takes for others.

Scoring. Parts of bounded size together are broadcast. Where they are more, the texts are written in compressed slices, the
distinct keys of a slice are sent to the parts that hold them, and what those find is sent back to the slice: one pass and
about 6 bytes a token, however large the filter. Shuffle files go as soon as what they led to is written.
The levels and normalisers of all tokens, four bytes each, are then a table from which weights are fitted and scores
computed. The probability of word w after u is ``b * q(u,w) / q(u) + (1 - b) * p(w)``, q being the middle of the count's
level, p(w) = (q(w) + 0.5) / (sum of q + 0.5 * (V + 1)); b depends on u's level and is fitted by expectation maximisation
on leave-one-out counts of all training tokens (their counts by levels, a small table).

Sentence context: a text begins after the end token, and ends with it. The first token is scored after the end.

Defined results: null and empty texts are the end token alone. Repeated rows count once each in training and score
equally. With no training text all counts are 0, N and V are 0, and every probability is that of a count of 0.
Two words with equal 64-bit hashes (odds of 1 in 10^7 for 2 million words) would share a count. Ids that are null take
the fold of the empty id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Tokens, dropped, hash_strings, mix, parts_for, ragged, slices, texts_of, written

END = np.uint64(0xD1B54A32D192ED03)
PROBES, BITS_PER_KEY, BASE = 4, 8, 1.6
LEVELS = 64
#: Steps of the logarithm of a word's normaliser; 0 stands for none.
STEPS = 1500


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)) for counts of 1 and more, 0 for none."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def middle_counts() -> np.ndarray:
    """The count that stands for each level: the mean of the whole counts in it."""
    edges = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-6)
    out = np.zeros(LEVELS + 1)
    out[1:] = np.maximum((edges[:-1] + edges[1:] - 1) / 2, edges[:-1])
    return out


def log_codes(sums: np.ndarray) -> np.ndarray:
    """16-bit codes of sums of 1 and more (0 for none)."""
    return np.where(sums > 0, 1 + np.round(STEPS * np.log(np.maximum(sums, 1))), 0).astype(np.uint16)


def from_codes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp((codes.astype(np.float64) - 1) / STEPS), 0)


class Stream:
    """The tokens of a slice of texts, each text's end token included: distinct hashes, codes into them, and the bounds."""

    def __init__(self, texts: list[str]):
        # lower() and split() of bytes know ASCII letters and white space alone
        t = Tokens([x.encode().lower().split() for x in texts])
        self.bounds = t.bounds + np.arange(len(t.bounds))
        self.distinct = np.append(hash_strings(t.words), END) & ~np.uint64(1)
        self.codes = np.full(int(self.bounds[-1]), len(t.words), np.int64)
        if len(t.codes):
            self.codes[ragged(self.bounds[:-1], np.diff(t.bounds))] = t.codes

    def before(self) -> np.ndarray:
        """The code of each token's predecessor (the end token for the first of a text)."""
        return shifted(self.codes, self.bounds, len(self.distinct) - 1)

    def pairs(self) -> np.ndarray:
        """The key of each token after its predecessor."""
        left, right = self.distinct * np.uint64(0x9FB21C651E98DF25), mix(self.distinct)
        return mix(left[self.before()] + right[self.codes]) | np.uint64(1)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def insertions(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A key for each level up to a key's own."""
    return at_level(np.repeat(keys, levels), ragged(np.ones(len(keys), np.int64), levels).astype(np.uint64))


def at_level(keys: np.ndarray, level: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + level * np.uint64(0xC2B2AE3D27D4EB4F))


def places(keyed: np.ndarray, bits: np.ndarray, probe: int) -> np.ndarray:
    """Bit numbers below bits (under 2^32), by double hashing."""
    h = (keyed + np.uint64(probe) * ((keyed >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((h * bits.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, their counts added up, and what else belongs to a key."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts, *(x[order[new]] for x in others)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 and more follow in eight."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their gaps, about six bytes each, or as they are where that is no longer."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    packed = gaps.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + pack_counts((gaps >> np.uint64(40)).astype(np.int64))
    return packed if len(packed) < 8 * len(keys) else keys.tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 * n:
        return np.frombuffer(data, np.uint64)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(-1, 5)
    return np.cumsum(gaps.view(np.uint64)[:, 0] + (unpack_counts(data[5 * n :], n).astype(np.uint64) << np.uint64(40)), dtype=np.uint64)


def written_alone(df: DataFrame, tag: str) -> DataFrame:
    """written(), and the shuffle files behind the rows removed as soon as they are written."""
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")
    try:
        return written(df, tag)
    finally:
        conf.set(cleanup, before)


def count_parts(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """The filter's parts: part, bits, n_tokens and n_words, and the sorted word hashes with their counts."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, "t", 6 << 20):
            stream = Stream(texts_of(chunk, "t"))
            pair, at, pair_count = np.unique(stream.pairs(), return_index=True, return_counts=True)
            own_count = np.bincount(stream.codes, minlength=len(stream.distinct))
            kinds = [(stream.distinct[own_count > 0], own_count[own_count > 0], None), (pair, pair_count, stream.distinct[stream.before()[at]])]
            for keys, counts, before in kinds:
                where = part_of(keys, parts)
                order = np.argsort(where, kind="stable")
                keys, counts, where = keys[order], counts[order], where[order]
                before = np.zeros(0, np.uint64) if before is None else before[order]
                ends = np.searchsorted(where, np.arange(parts + 1))
                own = [p for p in range(parts) if ends[p] < ends[p + 1]]
                cut = [slice(ends[p], ends[p + 1]) for p in own]
                yield pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int32()), "keys": pa.array([keys[c].tobytes() for c in cut], pa.binary()), "counts": pa.array([pack_counts(counts[c]) for c in cut], pa.binary()), "before": pa.array([before[c].tobytes() for c in cut], pa.binary())})

    def build(part: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        total = {False: none[:2], True: none}  # words, pairs
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        size = 0

        def fold(pair: bool) -> tuple[np.ndarray, ...]:
            return summed(*map(np.concatenate, zip(total[pair], *held[pair], strict=True)))

        for batch in batches:
            for k, c, u in zip(*(batch[x].to_pylist() for x in ("keys", "counts", "before")), strict=True):
                got = np.frombuffer(k, np.uint64)
                row = (got, unpack_counts(c, len(got)))
                held[len(u) > 0].append((*row, np.frombuffer(u, np.uint64)) if u else row)
                size += len(got)
                if size > 2_000_000:
                    for pair in held:
                        total[pair], held[pair] = fold(pair), []
                    size = 0
        (words_, counts), (pairs, pair_counts, before) = fold(False), fold(True)
        keys, all_counts = np.concatenate([words_, pairs]), np.concatenate([counts, pair_counts])
        inserted = insertions(keys, levels_of(all_counts))
        bits = np.array([max(64, len(inserted) * BITS_PER_KEY)])
        field = np.zeros(int(bits[0] + 7) // 8 * 8, bool)
        for probe in range(PROBES):
            field[places(inserted, bits, probe)] = True
        del inserted
        packed = np.packbits(field, bitorder="little")
        answered = middle_counts()[probed(keys, levels_of(all_counts), packed, bits)]
        # what this part adds to the normaliser of each predecessor, for the part that holds the predecessor
        order = np.argsort(before, kind="stable")
        owner, mass = summed(before[order], answered[len(words_) :][order])
        to = part_of(owner, parts)
        order = np.argsort(to, kind="stable")
        owner, mass, to = owner[order], mass[order], to[order]
        ends = np.searchsorted(to, np.arange(parts + 1))
        own = [p for p in range(parts) if ends[p] < ends[p + 1]]
        sums = [{"to": p, "owner": owner[ends[p] : ends[p + 1]].tobytes(), "mass": mass[ends[p] : ends[p + 1]].tobytes()} for p in own]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part[0].as_py()], pa.int32()), "n_bits": pa.array([int(bits[0])], pa.int64()), "bits": [packed.tobytes()],
            "n_tokens": [int(counts.sum())], "n_words": [len(words_)], "word_mass": [float(answered[: len(words_)].sum())],
            "words": [words_.tobytes()], "word_counts": [counts.astype("<i8").tobytes()], "sums": pa.array([sums], pa.list_(pa.struct([("to", pa.int32()), ("owner", pa.binary()), ("mass", pa.binary())]))),
        })

    def normalisers(part: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, mass = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for o, m in zip(batch["owner"].to_pylist(), batch["mass"].to_pylist(), strict=True):
                owner, mass = summed(np.concatenate([owner, np.frombuffer(o, np.uint64)]), np.concatenate([mass, np.frombuffer(m)]))
        # every word of the part precedes something, so these are its words in their order
        yield pa.RecordBatch.from_pydict({"part": pa.array([part[0].as_py()], pa.int32()), "word_sums": [log_codes(mass).tobytes()]})

    shipped = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(ship, "part int, keys binary, counts binary, before binary")
    schema = "part int, n_bits long, bits binary, n_tokens long, n_words long, word_mass double, words binary, word_counts binary, sums array<struct<to:int,owner:binary,mass:binary>>"
    built = written_alone(shipped.groupBy("part").applyInArrow(build, schema), "lm")
    sums = built.select(F.inline("sums")).select(F.col("to").alias("part"), "owner", "mass").groupBy("part").applyInArrow(normalisers, "part int, word_sums binary")
    parts_ = written_alone(built.drop("sums").join(sums, "part", "left").withColumn("word_sums", F.coalesce("word_sums", F.lit(b""))), "lm")
    dropped(built)
    return parts_


def probed(keys: np.ndarray, known: np.ndarray, packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The levels that the filter answers for keys inserted up to a known level."""
    out = known.copy()
    open_ = np.arange(len(keys))
    while len(open_):
        keyed = at_level(keys[open_], (out[open_] + 1).astype(np.uint64))
        for probe in range(PROBES):
            at = places(keyed, bits, probe)
            hit = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            open_, keyed = open_[hit], keyed[hit]
        open_ = open_[out[open_] < LEVELS]
        out[open_] += 1
    return out


class Lookup:
    """A group of the filter's parts, ready for lookups of the keys that hash to them."""

    def __init__(self, rows: Iterable, parts: int):
        self.parts = parts
        self.here, self.size, self.base = np.zeros(parts, bool), np.full(parts, 64, np.int64), np.zeros(parts, np.int64)
        data, keys, counts, sums, at = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint16)], 0
        for r in rows:
            p = r["part"]
            self.here[p], self.size[p], self.base[p] = True, r["n_bits"], at
            data.append(np.frombuffer(r["bits"], np.uint8))
            keys.append(np.frombuffer(r["words"], np.uint64))
            many = np.frombuffer(r["word_counts"], "<i8")
            counts.append(many.astype(np.uint32) if many.max(initial=0) < 2**32 else many)
            sums.append(np.frombuffer(r["word_sums"], np.uint16))
            at += 8 * len(data[-1])
        self.bits, self.words, self.counts, self.sums = np.concatenate(data), np.concatenate(keys), np.concatenate(counts), np.concatenate(sums)
        # parts are ranges of the upper bits below the top ones, so the words need one more sort
        order = np.argsort(self.words)
        self.words, self.counts, self.sums = self.words[order], self.counts[order], self.sums[order]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level by repeated probes; 0 for keys of parts that aren't here."""
        out = np.zeros(len(keys), np.int64)
        part = part_of(keys, self.parts)
        open_ = np.flatnonzero(self.here[part])
        for level in range(1, LEVELS + 1):
            if not len(open_):
                break
            keyed = at_level(keys[open_], np.uint64(level))
            size, base = self.size[part[open_]], self.base[part[open_]]
            for probe in range(PROBES):
                at = base + places(keyed, size, probe)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                open_, keyed, size, base = open_[hit], keyed[hit], size[hit], base[hit]
            out[open_] = level
        return out

    def exact(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' counts, and the codes of their normalisers."""
        if not len(self.words):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        here = self.words[at] == keys
        return np.where(here, self.counts[at], 0).astype(np.int64), np.where(here, self.sums[at], 0).astype(np.int64)


def resolve(look: Lookup, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the exact count, its level by the filter, its pair's level, and the code of the normaliser for what
    follows it, as far as this group holds them."""
    exact, sums = look.exact(stream.distinct)
    level = np.where(exact > 0, look.levels(stream.distinct), 0)
    return exact[stream.codes], level[stream.codes], look.levels(stream.pairs()), sums[stream.codes]


def shifted(values: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """What each token's predecessor has; a text's first token gets what is given for it."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[bounds[:-1]] = first
    return out


def filter_bytes(parts: DataFrame) -> int:
    """What a broadcast of all parts holds."""
    return parts.agg(F.sum(F.octet_length("bits") + F.octet_length("words") + F.octet_length("word_counts") + F.octet_length("word_sums"))).first()[0] or 0


def by_text(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


KINDS = {"exact": "<i8", "level": "u1", "pair": "u1", "sums": "<u2"}


def joined(chunk: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(chunk[column].to_pylist()), KINDS[column]).astype(np.int64)


def bounds_of(chunk: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(chunk["level"]), np.int64))])


LOOKED_UP = "k long, held_out boolean, n_tokens long, n_known long, base_score double, level binary, pair binary, sums binary"


def figures(k: pa.Array, held_out: pa.Array, bounds: np.ndarray, found: tuple[np.ndarray, ...], n_tokens: int, n_words: int, end_level: int) -> pa.RecordBatch:
    """The texts' exact figures, and the levels and normalisers of their tokens and pairs."""
    exact, level, pair, sums = found
    first = bounds[:-1]
    # a pair of a word that never occurred never occurred
    pair = np.where((level > 0) & (shifted(level, bounds, end_level) > 0), pair, 0)
    blobs = [pa.array([x.tobytes() for x in by_text(v.astype(KINDS[c]), bounds)], pa.binary()) for c, v in (("level", level), ("pair", pair), ("sums", sums))]
    own = [np.diff(bounds), np.add.reduceat((exact > 0).astype(np.int64), first), np.add.reduceat(np.log10(unigram(exact, n_tokens, n_words)), first)]
    return pa.RecordBatch.from_arrays([k, held_out, *map(pa.array, own), *blobs], ["k", "held_out", "n_tokens", "n_known", "base_score", "level", "pair", "sums"])


def by_broadcast(docs: DataFrame, parts: DataFrame, n: int, n_tokens: int, n_words: int, end_level: int) -> DataFrame:
    """LOOKED_UP by one broadcast of all parts."""
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(parts.toLocalIterator(), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        for chunk in slices(batches, "t"):
            stream = Stream(texts_of(chunk, "t"))
            yield figures(chunk["k"], chunk["held_out"], stream.bounds, resolve(look, stream), n_tokens, n_words, end_level)

    table = written_alone(docs.mapInArrow(run, LOOKED_UP), "looked-up")
    shared.destroy()
    return table


def unpacked(blob: bytes, sizes: bytes) -> list[str]:
    """The texts of a row of sliced()."""
    ends = np.cumsum(np.frombuffer(sizes, "<i8"))
    data = pa.decompress(blob, int(ends[-1]), "zstd", asbytes=True)
    return [data[a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def sliced(docs: DataFrame) -> DataFrame:
    """The texts in rows of a slice each, compressed, so that a slice is the same whenever it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, chunk in enumerate(slices(batches, "t", 6 << 20)):
            texts = [x.encode() for x in texts_of(chunk, "t")]
            sizes = np.array([len(x) for x in texts], "<i8").tobytes()
            ks, held = (pa.array([chunk[c].to_pylist()], pa.list_(chunk[c].type)) for c in ("k", "held_out"))
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int64()), ks, held, pa.array([sizes], pa.binary()), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())], ["slice", "k", "held_out", "sizes", "texts"])

    return written_alone(docs.mapInArrow(run, "slice long, k array<long>, held_out array<boolean>, sizes binary, texts binary"), "slices")


def by_shuffle(docs: DataFrame, parts: DataFrame, n: int, n_tokens: int, n_words: int, end_level: int, parts_per_shard: int = 4) -> DataFrame:
    """LOOKED_UP by sending each slice's distinct keys to the parts that hold them, and what they found back to the slice."""
    shards = -(-n // parts_per_shard)
    texts = sliced(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sizes, blob in zip(*(batch[c] for c in ("slice", "sizes", "texts")), strict=True):
                stream = Stream(unpacked(blob.as_py(), sizes.as_py()))
                # parts are ranges of the hashes, so sorted keys are in the order of the shards
                asked = [np.unique(stream.distinct), np.unique(stream.pairs())]
                ends = [np.searchsorted(part_of(x, n) // parts_per_shard, np.arange(shards + 1)) for x in asked]
                own = [s for s in range(shards) if any(e[s] < e[s + 1] for e in ends)]
                word, pair = ([x[e[s] : e[s + 1]] for s in own] for x, e in zip(asked, ends, strict=True))
                counts = [pa.array([len(x) for x in k], pa.int32()) for k in (word, pair)]
                packed = [pa.array([pack_keys(x) for x in k], pa.binary()) for k in (word, pair)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([at.as_py()] * len(own), pa.int64()), *counts, *packed], ["shard", "slice", "n_asked", "n_pairs", "asked_words", "asked_pairs"])

    def answer(shard: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked = [], []
        for batch in batches:
            is_part = pc.is_valid(batch["part"])
            rows += batch.filter(is_part).to_pylist()
            asked.append(batch.filter(pc.invert(is_part)).select(["slice", "n_asked", "n_pairs", "asked_words", "asked_pairs"]))
        look = Lookup(rows, n)
        del rows
        for some in asked:
            for chunk in slices([some], "asked_pairs", 4 << 20):
                n_asked, n_pairs = chunk["n_asked"].to_pylist(), chunk["n_pairs"].to_pylist()
                word, pair = (np.concatenate([unpack_keys(x, m) for x, m in zip(chunk[c].to_pylist(), many, strict=True)]) for c, many in (("asked_words", n_asked), ("asked_pairs", n_pairs)))
                exact, sums = look.exact(word)
                found = {"exact": exact, "level": np.where(exact > 0, look.levels(word), 0), "pair": look.levels(pair), "sums": sums}
                cut = [by_text(found[c].astype(kind), np.cumsum([0, *(n_pairs if c == "pair" else n_asked)])) for c, kind in KINDS.items()]
                blobs = [pa.compress(b"".join(x.tobytes() for x in row), "zstd", asbytes=True) for row in zip(*cut, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard[0].as_py()] * len(chunk), pa.int32()), chunk["slice"], chunk["n_asked"], chunk["n_pairs"], pa.array(blobs, pa.binary())], ["shard", "slice", "n_asked", "n_pairs", "found"])

    def settle(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        own = next(r for r in rows if r["texts"] is not None)
        rows = sorted((r for r in rows if r["texts"] is None), key=lambda r: r["shard"])
        got: dict[str, list[np.ndarray]] = {c: [] for c in KINDS}
        for r in rows:
            counts = {c: r["n_pairs" if c == "pair" else "n_asked"] for c in KINDS}
            data, at = pa.decompress(r["found"], sum(np.dtype(KINDS[c]).itemsize * m for c, m in counts.items()), "zstd", asbytes=True), 0
            for c, m in counts.items():
                got[c].append(np.frombuffer(data, KINDS[c], m, at))
                at += got[c][-1].nbytes
        exact, level, pair, sums = (np.concatenate(got[c]).astype(np.int64) for c in KINDS)
        stream = Stream(unpacked(own["texts"], own["sizes"]))
        word_at = np.unique(stream.distinct, return_inverse=True)[1][stream.codes]
        pair_at = np.unique(stream.pairs(), return_inverse=True)[1]
        yield figures(pa.array(own["k"], pa.int64()), pa.array(own["held_out"], pa.bool_()), stream.bounds, (exact[word_at], level[word_at], pair[pair_at], sums[word_at]), n_tokens, n_words, end_level)

    asked = texts.select("slice", "sizes", "texts").mapInArrow(ask, "shard int, slice long, n_asked int, n_pairs int, asked_words binary, asked_pairs binary")
    held = parts.select(F.floor(F.col("part") / parts_per_shard).cast("int").alias("shard"), "part", "n_bits", "bits", "words", "word_counts", "word_sums")
    found = written_alone(asked.unionByName(held, allowMissingColumns=True).groupBy("shard").applyInArrow(answer, "shard int, slice long, n_asked int, n_pairs int, found binary"), "found")
    table = written_alone(texts.unionByName(found, allowMissingColumns=True).groupBy("slice").applyInArrow(settle, LOOKED_UP), "looked-up")
    dropped(texts)
    dropped(found)
    return table


def unigram(counts: np.ndarray, n_tokens: float, n_words: int) -> np.ndarray:
    return (counts + 0.5) / (n_tokens + 0.5 * (n_words + 1))


def fit_weights(table: dict[tuple[int, int, int], int], n_tokens: float, n_words: int, rounds: int = 30) -> np.ndarray:
    """The pair model's share for each level of the predecessor, from (pair level, predecessor level, word level) counts.

    Leave-one-out: a token's own occurrence is taken out of its counts. Levels without tokens have a share of 0."""
    middle = middle_counts()
    keys = np.array(list(table), np.int64).reshape(-1, 3)
    count = np.array(list(table.values()), float)
    pair, before, word = (middle[keys[:, i]] for i in range(3))
    p2 = np.maximum(0, pair - 1) / np.maximum(1, before - 1)
    p1 = unigram(np.maximum(0, word - 1), n_tokens, n_words)
    share = np.full(LEVELS + 1, 0.5)
    for _ in range(rounds if len(keys) else 0):
        b = share[keys[:, 1]]
        mine = b * np.minimum(1, p2)
        both = mine + (1 - b) * p1
        top = np.bincount(keys[:, 1], weights=count * mine / both, minlength=LEVELS + 1)
        all_ = np.bincount(keys[:, 1], weights=count, minlength=LEVELS + 1)
        share = np.where(all_ > 0, top / np.maximum(all_, 1), 0)
    return np.clip(share, 0, 0.999)


def probability(level: np.ndarray, pair: np.ndarray, before: np.ndarray, sums: np.ndarray, weights: np.ndarray, mass: float, n_words: int) -> np.ndarray:
    """Of tokens with these levels, levels of their pairs and predecessors, and codes of the predecessors' normalisers.
    After a word that never occurred, the unigram alone."""
    middle = middle_counts()
    b = np.where((before > 0) & (sums > 0), weights[before], 0)
    return b * np.minimum(1, middle[pair] / np.maximum(1, from_codes(sums))) + (1 - b) * unigram(middle, mass, n_words)[level]


def score(docs: DataFrame, held_out: F.Column, key: str = "doc_id", text: str = "text", max_broadcast_bytes: int = 160 << 20, bytes_per_part: int = 12 << 20) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    rows = docs.select(F.col(key).cast("long").alias("k"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = parts_for(rows, bytes_per_part, "t")
    parts = count_parts(rows.filter(~F.col("held_out")), "t", n)
    n_tokens, n_words, mass = (x or 0 for x in parts.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("word_mass")).first())
    end = np.array([END & ~np.uint64(1)])
    by_end = Lookup(parts.filter(F.col("part") == int(part_of(end, n)[0])).collect(), n)
    end_level, end_sums = int(by_end.levels(end)[0]), int(by_end.exact(end)[1][0])
    look_up = by_broadcast if filter_bytes(parts) <= max_broadcast_bytes else by_shuffle
    table = look_up(rows, parts, n, n_tokens, n_words, end_level)
    dropped(parts)
    width = LEVELS + 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(width**3, np.int64)
        for chunk in slices(batches, "level", 1 << 19):
            level, pair = joined(chunk, "level"), joined(chunk, "pair")
            cells += np.bincount((pair * width + shifted(level, bounds_of(chunk), end_level)) * width + level, minlength=width**3)
        code = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"code": code, "count": cells[code]})

    cells = table.filter(~F.col("held_out")).select("level", "pair").mapInArrow(tally, "code long, count long").groupBy("code").agg(F.sum("count").alias("count")).collect()  # at most 65 cubed
    weights = fit_weights({(r["code"] // width**2, r["code"] // width % width, r["code"] % width): r["count"] for r in cells}, mass, n_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, "level", 1 << 19):
            level, pair, sums, bounds = joined(chunk, "level"), joined(chunk, "pair"), joined(chunk, "sums"), bounds_of(chunk)
            p = probability(level, pair, shifted(level, bounds, end_level), shifted(sums, bounds, end_sums), weights, mass, n_words)
            scores = np.add.reduceat(np.log10(p), bounds[:-1])
            yield pa.RecordBatch.from_arrays([*(chunk[c] for c in ("k", "held_out", "n_tokens", "n_known", "base_score")), pa.array(scores)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = table.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
