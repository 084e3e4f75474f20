"""Near-duplicates against a plain reading of the definition, over all pairs."""

import collections
import random

import numpy as np
import pytest
import regex

from tesserine.llm import near_dedup


def plain_readings(text):
    lower = text.lower()
    for w in (regex.findall("[^\x20\x09-\x0d]+", lower), regex.findall(r"[\p{L}\p{N}]+", lower)):
        n = len(w)
        yield collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, n - 4))) if n else collections.Counter()


def plain_similarity(a, b):
    """Set and probability Jaccard by their definitions."""
    best = 0.0
    for bare, (x, y) in enumerate(zip(plain_readings(a), plain_readings(b), strict=True)):
        if not x or not y:
            best = max(best, float(not x and not y and not bare))
            continue
        best = max(best, len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
        both = x.keys() | y.keys()
        best = max(best, sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in both) for d in x.keys() & y.keys()))
    return best


def classes(texts, alike):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if find(i) != find(j) and alike(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}


def worder(seed):
    draw = random.Random(seed)
    return draw, lambda: "".join(draw.choices("abcdefghijklmnop", k=6))


def test_likeness():
    """The similarity is the one of the definition, for texts with repeats, marks and short ones."""
    draw = random.Random(6)
    base = [draw.choice("abcdefgh") * draw.randrange(1, 5) + draw.choice(("", "", ".")) for _ in range(60)]
    texts = ["", "  ", "!", "? !", "a", "A"]
    for _ in range(30):
        x = list(base)
        for _ in range(draw.randrange(8)):
            at = draw.randrange(len(x))
            x[at : at + draw.randrange(3)] = draw.choice(([], ["new"], x[at : at + 20], [x[at] + "!"]))
        texts.append(" ".join(x))
    for a in texts:
        for b in texts:
            assert near_dedup.similarity(a, b) == pytest.approx(plain_similarity(a, b), abs=1e-9)
    assert near_dedup.similarity("!", "? !") == 0 and near_dedup.similarity("", "  ") == 1


def test_weightings():
    """A text has a weighting for each reading and for its set only where these differ."""
    texts = ["a b c d e f", "a, b c d e f", "a b c d e a b c d e", "a. b c d e a. b c d e", "", "! ?"]
    owner, s, w, sizes = near_dedup.measured(texts)
    assert collections.Counter(owner.tolist()) == {0: 1, 1: 2, 2: 2, 3: 4, 4: 1, 5: 1}
    assert len(s) == len(w) == sizes.sum()


def test_near_dedup(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = near_dedup.readings([t for _, t in rows])
    want = classes(rows, lambda i, j: near_dedup.likeness(sets[i], sets[j]) >= 0.8)
    assert got == {rows[i][0]: rows[c][0] for i, c in want.items()}
    assert near_dedup.deduplicated(docs).count() == len(set(got.values()))
    by = collections.defaultdict(set)
    for r in near_dedup.near_duplicates(odd).collect():
        by[r["doc_id"]].add(r["class_id"])
    assert by[0] == by[1] == by[2] == {0} and by[9] == by[10] == {9} and by[3] == {3}
    clashing = odd.selectExpr("*", "1 AS k_", "2 AS node", "3 AS digest", "4 AS first", "5 AS n")
    assert near_dedup.deduplicated(clashing).columns == clashing.columns
    assert {r["node"] for r in near_dedup.deduplicated(clashing).collect()} == {2}
    assert near_dedup.near_duplicates(none).count() == near_dedup.deduplicated(none).count() == 0


def test_marks_and_repeats(spark):
    """Copies alike only without their marks, or only as sets, are found though their words as written and counts differ."""
    draw, word = worder(3)
    texts = []
    for _ in range(40):
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(w + "," if draw.random() < 0.15 else w for w in base)]
        # a refrain of twenty words, once and thirty times: equal sets but for the seams
        texts += [" ".join(x := [word() for _ in range(60)]), " ".join([*x, *x[:20] * 30])]
    assert near_dedup.similarity(texts[0], texts[1]) == 1 and near_dedup.similarity(texts[2], texts[3]) >= 0.8
    assert found(spark, texts) == {i: i - i % 2 for i in range(len(texts))}


def test_large_buckets(spark):
    """Families of alike texts that all share most of a passage: large buckets of many components."""
    draw, word = worder(5)
    base, texts = [word() for _ in range(200)], []
    for _ in range(80):
        family = base[:165] + [word() for _ in range(35)]
        for _ in range(4):
            at = draw.randrange(150)
            texts.append(" ".join(family[:at] + [word() for _ in range(draw.randrange(12))] + family[at:]))
    sets = near_dedup.readings(texts)
    want = classes(texts, lambda i, j: near_dedup.likeness(sets[i], sets[j]) >= 0.8)
    assert len(set(want.values())) > 40
    assert found(spark, texts) == want


def test_crowds(spark):
    """Pairs of alike texts scattered over a crowd of 1300 that share a passage too short to link them: every pair is found."""
    _, word = worder(9)
    base, texts = [word() for _ in range(133)], []
    for _ in range(650):
        own = [word() for _ in range(7)]
        # the two have 136 of 150 shingles in common, any two others 129
        texts += [" ".join([*base, *own, *(word() for _ in range(14))]) for _ in range(2)]
    assert near_dedup.similarity(texts[0], texts[1]) >= 0.8 > near_dedup.similarity(texts[0], texts[2])
    assert found(spark, texts) == {i: i - i % 2 for i in range(1300)}


def test_group_of_edited_copies(spark):
    """A group of 2,200 copies of one text with one to six words replaced, dropped or doubled: recall over all pairs."""
    draw, word = worder(11)
    base, texts = [word() for _ in range(120)], []
    for _ in range(2200):
        x = list(base)
        for _ in range(draw.choice((1, 2, 3, 4, 5, 6))):
            at = draw.randrange(len(x))
            x[at : at + 1] = draw.choice(([word()], [], [x[at]] * 2))
        texts.append(" ".join(x))
    every = [near_dedup.readings([t])[0] for t in texts]
    names = {h: i for i, h in enumerate(sorted({int(h) for r in every for h in r[0][0]}))}
    bits = np.zeros((len(texts), len(names)), np.float32)
    for i, r in enumerate(every):
        bits[i, [names[int(h)] for h in r[0][0]]] = 1
    common, n = bits @ bits.T, bits.sum(axis=1)
    # set Jaccard for all pairs at once; the other measures for pairs that come near
    share = common / (n[:, None] + n - common)
    alike = share >= 0.8
    for i, j in zip(*np.nonzero(np.triu((share >= 0.7) & (share < 0.8), 1)), strict=True):
        if sum(every[i][0][1]) != n[i] or sum(every[j][0][1]) != n[j]:
            alike[i, j] = alike[j, i] = near_dedup.likeness(every[i], every[j]) >= 0.8
    want = classes(texts, lambda i, j: alike[i, j])
    assert len(set(want.values())) > 100
    assert found(spark, texts) == want


def test_rare_shingles_lose_no_pair():
    """Every alike pair has a common shingle that both put forward, in any order of the shingles and within all bounds."""
    draw, word = worder(8)
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(120):
        x = list(base)
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(x))
            x[at : at + draw.randrange(3)] = draw.choice(([], [word()], x[at : at + 12], [x[at] + "!"]))
        texts.append(" ".join(x))
    for seed in (0, 1):
        levels = np.random.default_rng(seed).integers(0, 3, near_dedup.CELLS).astype(np.uint8)
        owner, s, share, sets, parities = near_dedup.rare_shingles(texts, levels, 0.8)
        rows = collections.defaultdict(dict)
        for i, o in enumerate(owner.tolist()):
            rows[o].setdefault(int(s[i]), []).append(i)
        for x in range(len(texts)):
            for y in range(x):
                if near_dedup.similarity(texts[x], texts[y]) < 0.8:
                    continue
                ok = False
                for shingle in rows[x].keys() & rows[y].keys():
                    for i in rows[x][shingle]:
                        for j in rows[y][shingle]:
                            a, b = share[i], share[j]
                            most = min(1 / (1 / (1 - a) + b / (1 - b)), 1 / (a / (1 - a) + 1 / (1 - b)))
                            differ = sum(int(v).bit_count() for v in (parities[i] ^ parities[j]).view(np.uint64))
                            ok |= most >= 0.8 - 1e-9 and (not sets[i] or not sets[j] or differ <= (sets[i] + sets[j]) / 9 + 1e-6)
                assert ok
