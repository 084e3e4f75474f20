"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A text is cut into pre-tokens (the space mark and a run of characters other than ASCII white space). Under a unigram
model a pre-token's best segmentation is the one with the highest sum of piece scores; the forward score of a prefix
(the best sum up to there, and the number of its pieces) depends on that prefix alone. So the distinct pre-tokens of
a batch are put in a trie, forward scores are computed once for each node, that is once for each shared prefix, and
the counts at terminal nodes are stored. Walking the sorted pre-tokens visits the trie in depth-first order with one
path of nodes in memory.

Pieces and their order are those of a public vocabulary file; a piece's score is its log probability under Zipf's law
for its place in that order. A character that no piece covers counts one token for each byte, each with a fixed low
score. Ties in score go to fewer tokens.

Defined results: null and empty texts have no pre-tokens and no tokens. Repeated rows get equal counts, whole texts are
counted, pre-tokens may have any length. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Tokens, slices, texts_of, words

MARK = "▁"
_MODELS: dict[str, "UnigramTrie"] = {}


class UnigramTrie:
    """Piece scores, and the terminal counts of the pre-tokens seen so far (up to a number of them)."""

    def __init__(self, scores: dict[str, float], byte_score: float | None = None, keep: int = 1_000_000):
        self.scores, self.keep, self.known = scores, keep, {}
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 5.0 if byte_score is None else byte_score

    @classmethod
    def load(cls, path: str) -> UnigramTrie:
        """Pieces of a sentencepiece file, in their order of rank; scores by Zipf's law."""
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        # single characters come last in a file of merges although they are frequent: they keep a place, but a low one
        order = sorted(usable, key=lambda i: (-lib.get_score(i), i))
        total = math.log(sum(1 / (r + 1) for r in range(len(order))))
        return cls({lib.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(order)})

    def insert(self, pre_tokens: list[str]) -> None:
        """Forward scores along the trie of the pre-tokens; stores their counts."""
        get, longest, byte_score = self.scores.get, self.longest, self.byte_score
        best, count, last = [0.0], [0], ""
        for token in sorted(pre_tokens):
            shared = len(commonprefix((last, token)))
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(token) + 1):
                n = len(token[i - 1].encode("utf-8", "surrogatepass"))
                top, fewest = best[i - 1] + n * byte_score, count[i - 1] + n
                for start in range(max(0, i - longest), i):
                    score = get(token[start:i])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and count[start] < fewest - 1:
                            top, fewest = score, count[start] + 1
                best.append(top)
                count.append(fewest)
            self.known[token] = count[-1]
            last = token

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        t = Tokens([words(x) for x in texts])
        if len(self.known) > self.keep:
            self.known = {}
        marked = [MARK + w for w in t.words]
        self.insert([w for w in marked if w not in self.known])
        each = np.fromiter(map(self.known.__getitem__, marked), np.int64, len(marked))
        sums = np.concatenate([[0], np.cumsum(each[t.codes] if len(marked) else np.zeros(0, np.int64))])
        return np.diff(t.bounds), sums[t.bounds[1:]] - sums[t.bounds[:-1]]


def trie(path: str) -> UnigramTrie:
    """The process's trie for a file: workers that run several tasks keep what they know."""
    if path not in _MODELS:
        _MODELS[path] = UnigramTrie.load(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = trie(model_path)
        for part in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part["k"], *map(pa.array, m.counts(texts_of(part, "t")))], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
