"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters: the first letter's vector turned
n-1 places, times the second's turned n-2 places, and so on, elementwise. A document is the bundle (sum) of its
n-grams' vectors, a language's prototype the bundle of its training documents (each brought to unit length, so that
long ones don't drown the rest), and a document has the language whose prototype has the largest cosine with it.

Letters are lower-cased; a run of other characters is one gap symbol, which also opens and closes a text. The
letters a-z have slots of their own; other letters share the rest by their code point.

Defined results: null text and text without a letter get ``und`` and score 0. Ties go to the language that sorts
first. With nothing to learn from, every document is ``und``. Whole texts are read, repeated rows get equal results,
and columns other than key, text and language are not read (the language in training only).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import annotate, slices, unused

SLOTS = 128
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _letter_slots() -> np.ndarray:
    """The slot of each code point of the basic plane: 0 for what isn't a letter, 1-26 for a-z, others by remainder."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SLOTS - 27)
    return out


class Profiler:
    """Turns texts into hypervectors."""

    def __init__(self, dim: int = 512, n: int = 3, seed: int = 7):
        self.dim, self.n, self.slots = dim, n, _letter_slots()
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SLOTS, dim))
        # turned[j] is for the letter with j letters after it in the n-gram
        self.turned = [np.roll(base, j, axis=1) for j in range(n)]

    def symbols(self, text: str) -> np.ndarray:
        """The slots of the letters with single gaps between runs and at both ends; empty if there is no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = points >= 1 << 16
        s = self.slots[np.where(wide, 0, points)]
        if wide.any():
            s[wide] = [27 + int(c) % (SLOTS - 27) if unicodedata.category(chr(int(c)))[0] == "L" else 0 for c in points[wide]]
        if not s.any():
            return np.zeros(0, np.int64)
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        return s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of the text's n-grams; None without a letter."""
        s = self.symbols(text)
        if not len(s):
            return None
        s = np.concatenate([s, np.zeros(max(0, self.n - len(s)), np.int64)])
        code = np.zeros(len(s) - self.n + 1, np.int64)
        for j in range(self.n):
            code = code * SLOTS + s[j : j + len(code)]
        grams, counts = np.unique(code, return_counts=True)
        out = np.zeros(self.dim, np.float64)
        for start in range(0, len(grams), 4096):
            g, bound = grams[start : start + 4096], None
            for j in range(self.n):
                part = self.turned[j][g // SLOTS**j % SLOTS]
                bound = part if bound is None else bound * part
            out += counts[start : start + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


@dataclass
class Profiles:
    """Unit-length prototypes of the learned languages, in the order of their names."""

    langs: list[str]
    prototypes: np.ndarray
    dim: int
    n: int
    seed: int


def learn(docs: DataFrame, learnable: F.Column, dim: int = 512, n: int = 3, seed: int = 7, max_rows: int = 20_000, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from the learnable rows with a language, from about max_rows of them (a bound of the fit; chosen by a
    hash of the text, so that every row has the same chance and equal texts go together)."""
    rows = docs.filter(learnable & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"))
    total = docs.filter(learnable & F.col(lang).isNotNull()).select(lang).count()
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / total)))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dim, n, seed), {}
        for part in slices(batches, "t"):
            for name, t in zip(part["lang"].to_pylist(), part["t"].to_pylist(), strict=True):
                v = profiler.vector(t) if t else None
                if v is not None and (size := np.linalg.norm(v)):
                    sums[name] = sums.get(name, 0) + v / size
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dim, "i": pa.array(range(dim), pa.int32()), "v": v})

    # sums of a dimension, so one row for each language and dimension, however many tasks there are
    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(bundle, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        found.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["v"]
    langs = sorted(found)
    vectors = np.array([found[x] / (np.linalg.norm(found[x]) or 1) for x in langs]).reshape(len(langs), dim)
    return Profiles(langs, vectors, dim, n, seed)


def annotated(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of docs with the predicted language and its score (the cosine, 0 at least), in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x dim numbers

    def make():
        p = shared.value
        profiler = Profiler(p.dim, p.n, p.seed)

        def predict(texts: list[str | None]) -> list[pa.Array]:
            found, scores = [], []
            for t in texts:
                v = profiler.vector(t) if t and p.langs else None
                size = 0.0 if v is None else float(np.linalg.norm(v))
                if not size:
                    # letters whose bundle cancels out are a tie of all languages
                    found.append(UNKNOWN if v is None else p.langs[0])
                    scores.append(0.0)
                    continue
                cos = np.round(p.prototypes @ v / size, 9)
                best = int(np.argmax(cos))
                found.append(p.langs[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return predict

    return annotate(docs, make, {names[0]: "string", names[1]: "double"}, text)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return annotated(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")), profiles, "t").select("doc_id", "lang_pred", "score")


def accepted(docs: DataFrame, profiles: Profiles, min_score: float = 0.1, text: str = "text") -> DataFrame:
    """The rows of docs that have a language: those with a letter whose cosine with some prototype is high enough.

    Long texts need min_score. A short text has few n-grams and a low cosine even with its own language, so from 256
    characters down the bar falls with the logarithm of the length, to half of min_score for 16 characters and fewer."""
    lang, cosine = unused(docs, "lang_found"), unused(docs, "cosine")
    size = F.log2(F.greatest(F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(16)))
    bar = F.lit(min_score) * F.least(F.lit(1.0), F.lit(0.5) + (size - 4) / 8)
    found = annotated(docs, profiles, text, (lang, cosine))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(cosine) >= bar)).select(*(F.col(f"`{c}`") for c in docs.columns))
