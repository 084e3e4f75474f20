"""What keeps the training-data operators within their limits of memory and time, on small tables."""

import random

import public_tokenizers
import pyarrow as pa

from tesserine.llm import near_dedup, sentencepieces, token_shards


def test_workers_keep_little(spark):
    """Batches of texts are small, and a worker lets go of a task's units."""
    from tesserine.llm import common

    random.seed(7)
    docs = spark.createDataFrame([(i, " ".join("".join(random.choices("aeinrst", k=9)) for _ in range(2000))) for i in range(1000)], "doc_id long, text string").coalesce(1)

    def probe(batches):
        m = sentencepieces.model(public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes], "known": [len(m.known)]})

    digests = sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert digests.agg({"n_tokens": "sum"}).first()[0] > 0
    seen = docs.mapInArrow(probe, "n long, known long").collect()
    assert max(r["n"] for r in seen) < 2 * common.BATCH_BYTES
    assert max(r["known"] for r in seen) <= sentencepieces.FEW


def test_units_in_rows(monkeypatch):
    """Units of the vocabulary's characters are merged many at a time, with the same ids as one by one."""
    m = sentencepieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(8)
    units = ["▁" * random.randint(0, 1) + "".join(random.choices("aeinrsth.,-E", k=random.randint(1, 60))) for _ in range(4000)] + ["日本", "▁🙂a", "\n", "▁"]
    want = [m.unit_ids(u) for u in units]
    alone = []
    monkeypatch.setattr(m, "unit_ids", lambda u, f=m.unit_ids: alone.append(u) or f(u))
    assert m._checked(units) == want
    assert all(len(u) > m.short or len(u) < 3 for u in alone)


def test_plain_words_are_hashed_once(monkeypatch):
    """Bare words that stand as such in a text take its words' hashes; marks, short and empty texts change nothing."""
    hashed = []
    monkeypatch.setattr(near_dedup, "hash_strings", lambda words, f=near_dedup.hash_strings: f([hashed.append(w) or w for w in words]))
    texts = ["one two three four five six", "One, (two) three-four; five six!", "", "!! ?", "x", "a-b c"]
    plain = ["one two three four five six", "one two three four five six", "", "", "x", "a b c"]
    bare = [r[1] for r in near_dedup.readings(texts)]
    assert hashed.count("x") == 1
    for (s, c), ((want, many), _) in zip(bare, near_dedup.readings(plain), strict=True):
        assert s.tolist() == want.tolist() and c.tolist() == many.tolist()


def test_plain_words_need_no_pattern(monkeypatch):
    """Words of ASCII letters alone are put together without the pattern, with the library's ids."""
    e = token_shards.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    tried = []

    class Pattern:
        def fullmatch(self, word, f=token_shards.PLAIN.fullmatch):
            tried.append(word)
            return f(word)

    monkeypatch.setattr(token_shards, "PLAIN", Pattern())
    for text in ("Some WORDS, and more; one. (two) Größe! it's 3rd x_ __ . a.b don't, end", ",", "A", ""):
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(x, "little") for x in zip(*[iter(e.encode([text])[0])] * e.dtype.itemsize)] == want
    assert not {"some", "and", "end", "a"} & set(tried)
    assert {"words,", "(two)", "größe!"} <= set(tried)
