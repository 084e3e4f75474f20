"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

A text becomes pieces by merging, again and again, the adjacent pair whose piece has the highest score (the leftmost
of equals) until none is left. No piece of such a vocabulary holds the space mark after another character, and none
holds a line break, so merges never cross from a word into the next: a text is cut into units (leading marks and what
follows up to the next mark; line breaks alone) and each distinct unit is encoded once. Both conditions are verified
when a model is loaded; a model that breaks them has whole texts as units.

The agenda of a short unit is the row of its adjacent pairs' ranks, whose least is taken each time; longer units keep
a heap. Characters outside the vocabulary become byte pieces. Of many new short units, those of one length are rows of
a matrix, and a round takes the least of every row; units with characters outside the vocabulary go one by one.

Every unit that the agenda encodes is compared, batch by batch, with what the sentencepiece library makes of it;
a difference raises an error.

Defined results: null text counts as empty: the end id alone, decoded to the empty text. Repeated rows, ties in score
(leftmost first) and texts of any length are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import bounded_batches, released, slices, texts_of

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_MODELS: dict[str, "PieceModel"] = {}
NONE = 1 << 30
#: Units that a worker keeps from task to task.
FEW = 50_000
#: Units of one length that are merged as rows of a matrix: at least, and at most at a time.
ROWS = (16, 20_000)


class PieceModel:
    """A merge-type vocabulary: encodes and decodes as the library does, from the agenda alone."""

    def __init__(self, path: str, keep: int = 600_000, short: int = 48):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keep, self.short, self.known, self.plain = keep, short, {}, {}
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.control = {i for i in range(len(self.pieces)) if lib.is_control(i)}
        # equal scores have equal ranks, so that the leftmost pair goes first
        scores = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self._tabulate()
        self.cuts = not any(MARK in p.lstrip(MARK) or (("\n" in p) and len(p) > 1) for p in self.ids)
        self.units = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+") if self.cuts else re.compile("(?s).+")
        self.end = lib.eos_id()

    def _tabulate(self) -> None:
        """Arrays for merging in rows: ids of characters; of each pair of ids that make a piece, its rank and id."""
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        pairs = {a * len(self.pieces) + b: p for p in self.rank for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None}
        self.pair_keys = np.array([*sorted(pairs), 1 << 62], np.int64)
        made = [pairs[k] for k in self.pair_keys[:-1].tolist()]
        self.pair_ranks = np.array([*map(self.rank.__getitem__, made), NONE], np.int32)
        self.pair_ids = np.array([*map(self.ids.__getitem__, made), -1], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs of ids are in the table, its last place for those that make no piece."""
        key = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, key)
        at[self.pair_keys[at] != key] = -1
        return at

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pair_ranks[self._pairs(left, right)]

    def _merge_rows(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the rows of a matrix of ids; gives indexes of rows and what these become, as they are ready."""
        rows, agenda = np.arange(len(s)), self._ranks(s[:, :-1], s[:, 1:])
        while len(rows) and s.shape[1] > 1:
            at = agenda.argmin(axis=1)
            best = agenda[np.arange(len(rows)), at]
            ready = best == NONE
            if ready.any():
                yield rows[ready], s[ready]
                s, agenda, at, best, rows = (x[~ready] for x in (s, agenda, at, best, rows))
            (n, width), each = s.shape, np.arange(len(rows))
            s[each, at] = self.pair_ids[self._pairs(s[each, at], s[each, at + 1])]
            stays = np.ones((n, width), bool)
            stays[each, at + 1] = False
            s = s[stays].reshape(n, width - 1)
            stays = np.ones((n, width - 1), bool)
            stays[each, at] = False
            agenda = agenda[stays].reshape(n, width - 2)
            i = np.flatnonzero(at > 0)
            agenda[i, at[i] - 1] = self._ranks(s[i, at[i] - 1], s[i, at[i]])
            i = np.flatnonzero(at < width - 2)
            agenda[i, at[i]] = self._ranks(s[i, at[i]], s[i, at[i] + 1])
        yield rows, s

    def ids_of_units(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        out: list[list[int] | None] = [None] * len(units)
        if units:
            symbols = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
            lengths = np.fromiter(map(len, units), np.int64, len(units))
            starts = np.cumsum(lengths) - lengths
            lengths[np.minimum.reduceat(symbols, starts) < 0] = 0
            for length in range(1, self.short + 1):
                same = np.flatnonzero(lengths == length)
                for first in range(0, len(same) if len(same) >= ROWS[0] else 0, ROWS[1]):
                    some = same[first : first + ROWS[1]]
                    for rows, ids in self._merge_rows(symbols[starts[some][:, None] + np.arange(length)]):
                        for i, x in zip(some[rows].tolist(), ids.tolist(), strict=True):
                            out[i] = x
        return [self.unit_ids(u) if x is None else x for u, x in zip(units, out, strict=True)]

    def merge(self, unit: str) -> list[str]:
        """The pieces of a unit, by the agenda of its adjacent pairs."""
        return self._merge_row(list(unit)) if len(unit) <= self.short else self._merge_heap(list(unit))

    def _merge_row(self, parts: list[str]) -> list[str]:
        rank = self.rank.get
        agenda = [rank(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = rank(parts[i - 1] + parts[i], NONE)
            if i < len(agenda):
                agenda[i] = rank(parts[i] + parts[i + 1], NONE)
        return parts

    def _merge_heap(self, parts: list[str]) -> list[str]:
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (r := rank(pair := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(agenda, (r, i, pair))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            if not parts[i] or after[i] >= n or parts[i] + parts[j := after[i]] != pair:
                continue  # one of the two has since been merged with another
            parts[i], parts[j], after[i] = pair, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p]

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(unit):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
        return out

    def _checked(self, units: list[str]) -> list[list[int]]:
        """Ids of units by the agenda, compared with the library's: each as a text, after a line break where it has no mark."""
        found = self.ids_of_units(units)
        if self.cuts:
            lead = self.library.encode("\n")
            texts = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u for u in units]
            for u, mine, lib in zip(units, found, self.library.encode(texts, num_threads=1), strict=True):
                if (mine if u[0] == MARK else lead + mine) != lib and not (u.strip(MARK) == "" and len(u) == 1):
                    raise ValueError(f"the agenda and the library differ on {u!r}: {mine} and {lib}")
        return found

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids with the end id, the ids as decimals joined by spaces, the decoded text."""
        lists = [self.units.findall(f"{MARK}{x.replace(' ', MARK)}") if x else [] for x in texts]
        if len(self.known) > self.keep:
            self.known, self.plain = {}, {}
        new = list(set().union(*lists) - self.known.keys())
        for unit, ids in zip(new, self._checked(new), strict=True):
            self.known[unit] = " ".join(map(self.decimals.__getitem__, ids))
            self.plain[unit] = self._raw(ids).decode("utf-8", "replace")
        at, text_at, out = self.known.__getitem__, self.plain.__getitem__, []
        for units in lists:
            ids = " ".join([*map(at, units), str(self.end)])
            out.append((ids.count(" ") + 1, ids, "".join(map(text_at, units))[1:]))
        return out

    def forget(self) -> None:
        """Lets go of what is known of units, where that is much: the next task's units are mostly others."""
        if len(self.known) > FEW:
            self.known, self.plain = {}, {}

    def ids_of(self, text: str) -> list[int]:
        return [int(i) for i in self.encode([text])[0][1].split(" ")]

    def _raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    @staticmethod
    def _text(raw: bytes) -> str:
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids give nothing, the first piece's space goes."""
        return self._text(self._raw(ids))


def model(path: str) -> PieceModel:
    """The process's model for a file: workers that run several tasks keep what they know."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every document's ids and decoded text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part in slices(batches, "t", 2 << 20):
            rows = m.encode(texts_of(part, "t"))
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [part["k"], pa.array(np.fromiter((r[0] for r in rows), np.int64, len(rows))), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        m.forget()
        released()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, SCHEMA)
