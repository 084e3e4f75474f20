"""The training-data operators against brute force, round trips and held-out rows, on small tables."""

import collections
import hashlib
import io
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserine.llm import decontaminate, language_id, lm_scoring, quality, sentencepieces, token_counts, token_shards, topk_search, warc
from tesserine.llm.common import crc_mod
from tesserine.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

def test_token_shards(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for docs in (documents(spark), odd):
        manifest = token_shards.write_shards(docs, path, 1, shard_bytes=20_000)
        got = token_shards.read_shards(manifest).collect()
        want = collections.Counter()
        for r in docs.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
        assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
        got.sort(key=lambda r: r["start"])
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()[:-1]
        keys = [-math.inf if r["doc_id"] is None else r["doc_id"] for r in got]
        assert keys == sorted(keys)
    assert len(token_shards.lookup(manifest, [3, 10**9])[3]) == 2
    assert token_shards.lookup(manifest, [10**9])[10**9] == []
    assert token_shards.read_shards(token_shards.write_shards(none, path, 1)).count() == 0


def test_words_by_parts():
    e = token_shards.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.by_parts and not e.known
    random.seed(3)
    some = ["".join(random.choice('abcXYZßéÀÿ.,;:!?*"()[]#_/-\'1²ªº|<>Kİſﬁ') for _ in range(random.randint(1, 9))) for _ in range(5000)] + ["<|endoftext|>", "a<|endoftext|>b", "ΣΑΣ", "e\u0301a."]
    for word, ids in zip(some, e.encode(some), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == e.tokenizer.encode(word, add_special_tokens=False).ids
    assert not token_shards.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_parts


def test_lm_scoring(spark, odd, none):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    for docs, bound in ((documents(spark), 1 << 30), (documents(spark), 100_000), (odd, 1 << 30)):
        got = collections.defaultdict(list)
        for r in lm_scoring.score(docs, crc_mod("doc_id", 5) == 1, max_broadcast_bytes=bound).collect():
            got[r["doc_id"]].append(r)
        tokens = [(r["doc_id"], [*re.findall("[^\x20\x09-\x0d]+", low(r["text"] or "")), None]) for r in docs.collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
        c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        for i, ws in tokens:
            base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0 for r in got[i])
    assert lm_scoring.score(none, crc_mod("doc_id", 5) == 1).count() == 0


def test_lm_score_by_brute_force(spark):
    """The masses sum to 1, and scores are those of a plain walk over words with what the filter answers."""
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", low(x)), None] for i, x in texts.items()}
    n = lm_scoring.parts_for(docs, 12 << 20, "text")
    look = lm_scoring.Lookup(lm_scoring.count_parts(docs.filter(crc_mod("doc_id", 5) != 1), "text", n).collect(), n)
    middle = lm_scoring.middle_counts()
    keys, pairs = {}, {}
    for i, x in texts.items():
        stream = lm_scoring.Stream([x])
        keys |= zip(tokens[i], stream.distinct[stream.codes].tolist(), strict=True)
        pairs |= zip(zip([None, *tokens[i][:-1]], tokens[i], strict=True), stream.pairs().tolist(), strict=True)
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    seen = {(u, w) for i, ws in tokens.items() if not held[i] for u, w in zip([None, *ws[:-1]], ws, strict=True)}
    level = dict(zip(keys, look.levels(np.array(list(keys.values()), np.uint64)).tolist(), strict=True))
    level = {w: n if counts[w] else 0 for w, n in level.items()}
    pair = dict(zip(pairs, look.levels(np.array(list(pairs.values()), np.uint64)).tolist(), strict=True))
    kept = dict(zip(keys, lm_scoring.from_codes(look.exact(np.array(list(keys.values()), np.uint64))[1]).tolist(), strict=True))
    sums = collections.Counter()
    for u, w in seen:
        assert pair[u, w] > 0
        sums[u] += middle[pair[u, w]]
    assert set(sums) == {w for w in kept if kept[w]} and all(abs(sums[u] / kept[u] - 1) < 0.001 for u in sums)
    mass = sum(middle[level[w]] for w in counts)
    total = mass + 0.5 * (len(counts) + 1)
    assert abs(sum((middle[level[w]] + 0.5) / total for w in counts) + 0.5 / total - 1) < 1e-9
    table = collections.Counter()
    for i, ws in tokens.items():
        if not held[i]:
            table.update((pair[u, w], level[u], level[w]) for u, w in zip([None, *ws[:-1]], ws, strict=True))
    weights = lm_scoring.fit_weights(table, mass, len(counts))
    assert 0.05 < weights.max() < 1
    for r in lm_scoring.score(docs, crc_mod("doc_id", 5) == 1).collect():
        want, ws = 0.0, tokens[r["doc_id"]]
        for u, w in zip([None, *ws[:-1]], ws, strict=True):
            b = weights[level[u]] if counts[u] else 0
            q = middle[pair[u, w]] / kept[u] if counts[u] and counts[w] else 0
            want += math.log10(b * min(1, q) + (1 - b) * (middle[level[w]] + 0.5) / total)
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))


def test_lm_scoring_beyond_one_broadcast(spark, odd, none):
    """Parts that aren't broadcast give the same figures, on tables, empty ones and where nothing is learned."""
    for docs, held in ((documents(spark), crc_mod("doc_id", 5) == 1), (odd, crc_mod("doc_id", 5) == 1), (odd, F.lit(True)), (none, crc_mod("doc_id", 5) == 1)):
        want, got = (sorted(lm_scoring.score(docs, held, max_broadcast_bytes=b, bytes_per_part=20_000).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])) for b in (1 << 30, -1))
        assert len(want) == docs.count() == len(got)
        for a, b in zip(want, got, strict=True):
            assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_lm_scoring_disk(spark, tmp_path, monkeypatch):
    """Beyond one broadcast, what lies on disk at once is a few times the texts, whatever the number of parts."""
    docs = documents(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    folders = [pathlib.Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    monkeypatch.setattr("tesserine.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    old = {f for d in folders for f in d.rglob("shuffle_*.data")}
    tables, write = [], lm_scoring.written

    def measured(df, tag):
        out = write(df, tag)
        tables.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return out

    monkeypatch.setattr(lm_scoring, "written", measured)
    assert lm_scoring.score(docs, crc_mod("doc_id", 5) == 1, max_broadcast_bytes=100_000, bytes_per_part=50_000).count() == docs.count()
    assert max(tables) < 2.5 * size
    for _ in range(50):
        left = sum(f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data") if f not in old)
        if left < 0.2 * size:
            break
        time.sleep(0.2)
    assert left < 0.2 * size


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 700_000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        data = lm_scoring.pack_keys(keys)
        assert lm_scoring.unpack_keys(data, len(keys)).tolist() == keys.tolist() and len(data) <= 8 * len(keys)
    assert len(data) < 6.2 * len(keys)


def test_token_counts(spark, odd, none):
    m = token_counts.trie(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(word):
        best = [(0.0, 0)] + [None] * len(word)
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + n * m.byte_score, best[i - 1][1] - n)]
            options += [(m.scores[word[j:i]] + best[j][0], best[j][1] - 1) for j in range(i) if word[j:i] in m.scores]
            best[i] = max(options)
        return -best[-1][1]

    for docs in (documents(spark).limit(40), odd):
        rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
        want = collections.Counter((i, len(ws), sum(brute("▁" + w) for w in ws)) for i, x in rows for ws in [re.findall("[^\x20\x09-\x0d]+", x or "")])
        assert set(want) == {tuple(r) for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert token_counts.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_topk_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 20).tolist(), 1) for i in range(300)] + [(7, [0.5] * 20, 1), (50, [float("nan")] * 20, 1), (100, None, 1), (None, [1.0] * 20, 1), (401, [1.0, None], 1), (150, [3.0, 4.0], 1), (402, [2.0, 2.0], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(t, F.col("vec_id") % 50 == 0, k=5, block_rows=4).collect()}
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    want = {}
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk_search.top_k(t.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_search_large_components(spark):
    """Scores beyond exact floating point and beyond a long; blocks of queries one after the other."""
    rows = [(0, [1e15, 3.0]), (1, [1e15, 5.0]), (2, [1e30, 1.0]), (3, [-1e30, 1.0]), (4, [2.0**40, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    scaled = {i: [max(-most - 1, min(most, math.floor(256 * x))) for x in v] for i, v in rows}
    want = []
    for q in scaled:
        found = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(scaled[q], scaled[c], strict=True)))), c) for c in scaled if c != q)
        want += [(q, n, c, -s) for n, (s, c) in enumerate(found[:3], 1)]
    for size in (2, 2048):
        got = topk_search.top_k(vectors, F.lit(True), k=3, block_rows=size).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_decontaminate(spark, odd, none):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    plain = lambda x: " ".join(w for w in (re.sub(r"[\W_]", "", w) for w in x.lower().split()) if w)
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    whole = {(r["doc_id"], i) for r in docs.collect() for i, x in items.items() if f" {x} " in f" {plain(r['text'])} "}
    assert whole <= got
    assert {d for d, _ in got} == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}
    item = next(iter(items.values())).split()
    item[3] = "changed"
    one = spark.createDataFrame([(1, "before " * 30 + " ".join(item) + " after" * 30)], "doc_id long, text string")
    assert decontaminate.find_leaks(one, bench.limit(1)).first()["edits"] == 1
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(none, bench).count() == decontaminate.find_leaks(odd, bench.filter("false")).count() == 0


def planted(spark, items, leaks):
    """find_leaks over one document for each leak (a list of words) between other words: the pairs of ids found."""
    draw = random.Random(3)
    around = lambda: " ".join(f"o{draw.randrange(10**6)}" for _ in range(50))
    docs = spark.createDataFrame([(i, f"{around()} {' '.join(x)} {around()}") for i, x in enumerate(leaks)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}


def test_decontaminate_edits_anywhere(spark):
    """All allowed edits side by side, at an item's start, middle or end: words replaced, left out or put in."""
    items, leaks = [], []
    for n in (20, 40, 60, 100):
        for at in (0, n // 2 - n // 10, n - n // 5):
            for change in range(3):
                item = [f"w{len(items)}x{i}" for i in range(n)]
                new = [f"n{i}" for i in range(n // 5)] if change != 1 else []
                items.append(item)
                leaks.append(item[:at] + new + item[at + (n // 5 if change != 2 else 0) :])
    assert planted(spark, items, leaks) == {(i, i) for i in range(len(items))}


def test_decontaminate_short_items(spark):
    """Whole copies of items of few words in the middle of a text, and copies with one edit."""
    items = [[f"w{n}x{k}x{i}" for i in range(n)] for n in (5, 6, 7, 8, 9) for k in range(20)]
    same = {(i, i) for i in range(len(items))}
    assert planted(spark, items, items) == same
    assert planted(spark, items, [[*x[: k % len(x)], "new", *x[k % len(x) + 1 :]] for k, x in enumerate(items)]) == same
    assert planted(spark, [x[:4] for x in items], [x[:4] for x in items]) == set()


def test_decontaminate_against_all_windows(spark):
    """Random edits up to and past the limit, over words that repeat: the same pairs as all windows compared."""
    draw = random.Random(8)
    word = lambda: f"w{min(draw.randrange(1, 400), draw.randrange(1, 400))}"
    items, texts = [[word() for _ in range(draw.randrange(5, 60))] for _ in range(150)], []
    for x in items:
        x = list(x)
        for _ in range(len(x) // 5 + draw.choice((0, 0, 0, 1))):
            at = draw.randrange(len(x))
            x[at : at + 1] = draw.choice(([], [word()], [x[at], word()]))
        texts.append([*(word() for _ in range(draw.randrange(20))), *x, *(word() for _ in range(draw.randrange(20)))])
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    area = np.zeros((len(texts), max(map(len, texts))), np.int64)
    for i, x in enumerate(texts):
        area[i, : len(x)] = [int(w[1:]) for w in x]
    for k, x in enumerate(items):
        for i, e in enumerate(decontaminate.edit_distances(np.array([int(w[1:]) for w in x]), area).tolist()):
            if e <= len(x) // 5:
                want[i, k] = e
    assert got == want and len(want) > 100


def test_edit_distances():
    random.seed(5)
    for _ in range(50):
        a, b = ([random.randrange(1, 4) for _ in range(n)] for n in (6, 10))
        d = [[0] * 11 for _ in range(7)]
        for i in range(1, 7):
            d[i][0] = i
            for j in range(1, 11):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        assert decontaminate.edit_distances(np.array(a), np.array([b]))[0] == min(d[6])


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = quality.learn(docs, labels, crc_mod("doc_id", 4) != 2)
    held = quality.score(docs.filter(crc_mod("doc_id", 4) == 2), m).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.7) == r["quality"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, m).collect())
    assert quality.score(odd, m).count() == odd.count()
    assert quality.accepted(odd, m).columns == odd.columns
    assert quality.score(none, m).count() == 0
    assert quality.score(odd, quality.learn(docs, labels.filter("false"), F.lit(True))).filter("score between 0 and 1").count() == odd.count()


def test_pair_sum():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    ids, x = np.arange(9), rng.normal(size=9)
    want = 0.3 + m.linear @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(quality.raw_scores(m, ids, x, np.array([9]))[0][0] - want) < 1e-9


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language_id.learn(docs, crc_mod("doc_id", 4) != 2)
    held = language_id.identify(docs.filter(crc_mod("doc_id", 4) == 2), p).join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    got = {r["doc_id"]: r for r in language_id.identify(odd, p).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["lang_pred"] != "und"
    assert language_id.accepted(odd, p).columns == odd.columns
    assert language_id.identify(none, p).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(none, F.lit(True))).collect()} == {"und"}


def test_language_accepted(spark):
    """Texts in languages and letters that weren't learned go, learned ones stay, columns of any name pass through."""
    docs = documents(spark)
    p = language_id.learn(docs, F.lit(True))
    draw = random.Random(1)
    letters = lambda n: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(n))
    foreign = ["Это предложение написано по-русски, и его никто не учил. " * 4, "这是一个没有学过的中文句子。" * 12, letters(100), letters(400)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(foreign)], "doc_id long, text string, lang_found string")
    assert language_id.accepted(rows, p).count() == 0
    kept = language_id.accepted(docs.withColumn("cosine", F.lit("mine")), p)
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert {r["cosine"] for r in kept.collect()} == {"mine"}


def test_sentencepieces(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepieces.model(path)
    random.seed(4)
    texts = [r["text"] or "" for r in odd.collect()] + ["".join(random.choice("ab the  \n\té漢🙂▁<s>\r\x00in er") for _ in range(random.randint(1, 90))) for _ in range(300)]
    for x in texts:
        ids = m.ids_of(x)
        assert ids == [*m.library.encode(x), 2]
        assert m.decode(ids) == m.library.decode(ids)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for docs in (documents(spark), odd):
        want = collections.Counter()
        for r in docs.collect():
            ids = [*m.library.encode(r["text"] or ""), 2]
            want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(m.library.decode(ids))] += 1
        assert want == collections.Counter(tuple(r) for r in sentencepieces.encode_documents(docs, path).collect())
    assert sentencepieces.encode_documents(none, path).count() == 0


def test_warc(spark):
    rows = [(i, f"http://x/{i}", h, 1) for i, h in enumerate(["a" * 50, "b", "a" * 50, None, "", "<p>é</p>", "a" * 50])] + [(None, None, "b", 1), (9, "u\r\nX: y", "line\r\n\r\nline", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    for i, _, h, _ in rows:
        r, data = got[i], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest_of(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0
    assert warc.read_archives(warc.write_archives(pages, min_revisit_bytes=10)).filter("record_type = 'revisit'").count() == 2


def test_warc_damage():
    import zstandard

    record = warc.record_bytes(1, "http://x/", b"payload", warc.digest_of(b"payload"), None, "2000-01-01T00:00:00Z")
    archive = b"".join(warc.archive_frames([record] * 3, zstandard.train_dictionary(1024, [record + bytes([i]) * 20 for i in range(200)]).as_bytes()))
    assert len(list(warc.read_archive(io.BytesIO(archive)))) == 3
    for bad in (archive[:-3], archive[:20]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    for bad in (record[:-1], record.replace(b"WARC-Date", b"X-Date"), b"HTTP" + record):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        warc.row_of(warc.parse_record(record.replace(b"payload\r", b"Payload\r")))


def test_pipeline(spark, none):
    import corpus_pipeline

    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    docs, step = documents(spark), documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert (step := stage(spark, step, SF)).columns == docs.columns
    assert {r["doc_id"] for r in step.collect()} == kept and kept
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*docs.columns), SF).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        got = QUERIES[name](spark, SF)
        want = con.execute(ORACLES[name])
        at = [d[0] for d in want.description]
        assert sorted(tuple(r[c] for c in at) for r in got.collect()) == sorted(want.fetchall())
