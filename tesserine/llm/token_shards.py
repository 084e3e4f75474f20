"""Token-ID output: documents as raw id payloads in shards, found by key through a minimal perfect hash.

Layout. Documents are put in ascending order of their key and cut into shards. A shard is two files:
``.ids``, the raw ids of its documents one after the other (little-endian, 2 bytes where the vocabulary fits,
else 4), and ``.idx``, which maps each distinct key to a slot by a minimal perfect hash. A slot keeps a
fingerprint of its key, the first document with that key and how many there are; offsets give each document's
place in the payload. A keyed read is thus one hash walk, one comparison and one range read.

The hash is a cascade of bit arrays: at each level a key that alone claims its bit stays, the others go on to the
next; the number of bits set before a key's bit is its slot, so n keys have exactly the slots 0..n-1.

Recovery: a task writes its shard under a name of its own and reports it in its output rows, so a task that is
run again leaves an unlisted file and nothing else. Only files in the manifest are read.

Defined results: null text counts as empty (its document is the end id alone); a null key is a key of its own and
comes first; documents with equal keys follow each other, ordered by a hash of their text, and a keyed read returns
all of them; an empty table has an empty manifest; columns other than the key and the text are not read.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import fetch, fresh_path, mix, open_fs, parts_for, publish, slices, texts_of, words, written

MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long"
NULL_KEY = np.uint64(0x5851F42D4C957F2D)
#: Latin letters between marks: words that the tokenizer's own rules part into just these three. No apostrophes, which
#: make contractions, and none of the characters of special tokens.
PLAIN = re.compile(r'([-.,;:!?*"()\[\]#_/]*)([a-zß-öø-ÿ]+)([-.,;:!?*"()\[\]#_/]*)')
PROBES = ["word", "WORDS", "Größe", '("Naïve".', "#a_", "_-b/", "xyzzy;;", "ÀÉ?!"]
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokens never hold white space, so that words can be encoded one by one.

    Equal words have equal ids, so each distinct word is encoded once and kept, up to a number of words. Words of plain
    letters with marks around them are put together from their parts in small letters, which recur far more often than
    the words do, and go straight to the library's merges; all others take its whole way. Vocabularies for which the
    two ways differ on the probes only take the whole one.
    """

    def __init__(self, path: str, keep: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known, self.parts = Tokenizer.from_file(path), keep, {}, {}
        self.dtype = np.dtype("u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.by_parts = True
        self._learn(PROBES)
        quick, self.known = self.known, {}
        self.by_parts = False
        self._learn(PROBES)
        self.by_parts, self.known = quick == self.known, {}

    def _part(self, part: str) -> bytes:
        """The ids of a run of small letters or of marks."""
        got = self.parts.get(part)
        if got is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARS)
            got = self.parts[part] = array(self.kind, [t.id for t in self.merge(shown)]).tobytes()
        return got

    def _learn(self, new: list[str]) -> None:
        """Encodes words that aren't known yet."""
        if len(self.parts) > self.keep:
            self.parts = {}
        match, part, have, known, whole = PLAIN.fullmatch, self._part, self.parts.get, self.known, []
        for word in new:
            if self.by_parts and word.isascii() and word.isalpha():
                letters = word.lower()  # no marks: these letters alone
                known[word] = have(letters) or part(letters)
                continue
            found = match(word.lower()) if self.by_parts else None
            if found is None:
                whole.append(word)
                continue
            before, letters, after = found.groups()
            ids = have(letters) or part(letters)
            if before:
                ids = (have(before) or part(before)) + ids
            known[word] = ids + (have(after) or part(after)) if after else ids
        for word, got in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            known[word] = array(self.kind, got.ids).tobytes()

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """The ids of each text as raw bytes, with the end id where one is given."""
        lists = list(map(words, texts))
        if len(self.known) > self.keep:
            self.known = {}
        self._learn(list(set().union(*lists) - self.known.keys()))
        at, last = self.known.__getitem__, b"" if end is None else np.array([end], self.dtype).tobytes()
        return [b"".join(map(at, x)) + last for x in lists]


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a file: workers that run several tasks keep what they know."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit values, as a cascade of bit arrays."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little"), dtype=np.int64)])

    @staticmethod
    def _claim(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        sizes, marks, left = [], [], keys
        while len(left):
            if len(sizes) > 200:
                raise ValueError("the keys aren't distinct")
            size = max(8, int(len(left) * spread))
            at = cls._claim(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            marks.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(marks) if marks else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for keys that no level holds (other unknown keys get some slot: compare fingerprints)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self._claim(keys[open_], level, size) + self.base[level]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out


def key_hashes(keys: list[int | None]) -> np.ndarray:
    known = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    return np.where(np.array([k is None for k in keys], bool), NULL_KEY, mix(known)) if keys else np.zeros(0, np.uint64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: list[int | None], offsets: np.ndarray, width: int) -> bytes:
    """The .idx file for documents in key order; offsets: of ids, one more than documents."""
    hashes = key_hashes(keys)
    distinct, first, count = np.unique(hashes, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    by_slot = np.argsort(slot)
    out = io.BytesIO()
    nulls = np.array([k is None for k in keys], bool)
    np.savez(out, width=np.array([width]), sizes=table.sizes, bits=table.bits, prints=fingerprints(distinct[by_slot]), first=first[by_slot], count=count[by_slot], offsets=offsets, keys=np.array([0 if k is None else k for k in keys], np.int64), nulls=nulls)
    return out.getvalue()


class Shard:
    """Keyed and whole reads of one shard."""

    def __init__(self, path: str, ahead: int = 8 << 20):
        x = np.load(io.BytesIO(fetch(f"{path}.idx")))
        self.width, self.prints, self.first, self.count, self.offsets = int(x["width"][0]), x["prints"], x["first"], x["count"], x["offsets"]
        self.table = PerfectHash(x["sizes"], x["bits"])
        self.keys = [None if null else k for k, null in zip(x["keys"].tolist(), x["nulls"].tolist(), strict=True)]
        files, at = open_fs(f"{path}.ids")
        self.file, self.ahead, self.held, self.held_at = files.open_input_file(at), ahead, b"", 0

    def _read(self, start: int, n: int) -> bytes:
        if not self.held_at <= start <= start + n <= self.held_at + len(self.held):
            self.held, self.held_at = self.file.read_at(max(n, self.ahead), start), start
        return self.held[start - self.held_at : start - self.held_at + n]

    def entry(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]) * self.width, int(self.offsets[i + 1]) * self.width
        return np.frombuffer(self._read(a, b - a), f"<u{self.width}")

    def places(self, keys: list[int | None]) -> list[range]:
        """The documents of each key: hash, compare the fingerprint, take the stored range."""
        hashes = key_hashes(keys)
        slots = self.table.slots(hashes)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(hashes[known])
        return [range(int(self.first[s]), int(self.first[s] + self.count[s])) if ok else range(0) for s, ok in zip(slots.tolist(), known.tolist(), strict=True)]

    def get(self, key: int | None) -> list[np.ndarray]:
        return [self.entry(i) for i in self.places([key])[0]]


def write_shards(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", shard_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Encodes every document and writes the shards; returns their manifest, in the order of the shard column."""
    folder = folder or fresh_path(docs.sparkSession, "shards")
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    placed = rows.repartitionByRange(parts_for(rows, shard_bytes, "t"), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, keys, sizes = encoder(tokenizer), [], []
        shard = TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"

        def payload() -> Iterator[bytes]:
            for part in slices(batches, "t"):
                found = enc.encode(texts_of(part, "t"), end)
                keys.extend(part["k"].to_pylist())
                sizes.extend(map(len, found))
                yield b"".join(found)

        publish(f"{path}.ids", payload())
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) // enc.dtype.itemsize)]).astype(np.int64)
        publish(f"{path}.idx", index_bytes(keys, offsets, enc.dtype.itemsize))
        if keys:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(keys)], "n_tokens": [int(offsets[-1])], "first_key": pa.array([keys[0]], pa.int64()), "last_key": pa.array([keys[-1]], pa.int64())})

    return written(placed.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, each fetched by its key: doc_id, start, n_tokens, ids_crc32, shard."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    with_base = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                distinct = list(dict.fromkeys(shard.keys))
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for key, places in zip(distinct, shard.places(distinct), strict=True):
                    for i in places:
                        ids = shard.entry(i)
                        out["doc_id"].append(key)
                        out["start"].append(row["base"] + int(shard.offsets[i]))
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()} | {"shard": pa.array([row["shard"]] * len(out["doc_id"]), pa.int32())})

    return with_base.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(manifest: DataFrame, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Keyed access from the driver: the ids of each given key's documents, from the shards whose key range holds it."""
    out: dict[int | None, list[np.ndarray]] = {}
    for key in keys:
        near = manifest.filter(F.col("first_key").isNull() if key is None else (F.coalesce(F.col("first_key"), F.lit(-(2**63))) <= key) & (F.col("last_key") >= key))
        out[key] = [ids for row in near.orderBy("shard").toLocalIterator() for ids in Shard(row["path"]).get(key)]
    return out
