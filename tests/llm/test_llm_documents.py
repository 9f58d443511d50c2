import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trelliq.llm import langid, quality, sharding, shingles, url_filter

SF = "/root/testdata/sf0.01"


def sets(rows, words):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, words, t):
    s = sets(rows, words)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(s[a] & s[b])
            if both and both * t.denominator >= t.numerator * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def near(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 20, 60, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(rng.choice(["  ", " ", "\n\t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return rows + ["", None, "   ", "\t\n", "A b", "a  B", "É é", "é É"]


@pytest.mark.parametrize("words, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_jaccard_against_all_pairs(spark, words, t):
    rows = list(enumerate(near(random.Random(words), 45)))
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "doc_id long, text string, n int, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_groups(df, words, t).collect()}
    assert got == brute(rows, words, t)


def test_jaccard_large_cell_and_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CELL", 7)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(80)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(40)] + base[:50])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(4, 5)).collect()}
    assert got == brute(rows, 3, Fraction(4, 5))


def test_jaccard_empty_and_repeated(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in shingles.jaccard_groups(df).collect()} == {(3, 3), (5, 3)}
    assert shingles.jaccard_groups(df.limit(0)).count() == 0


def test_jaccard_of_documents_with_several_texts(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(60)) for p in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, a + " end"), (9, "alone in here now"), (None, a), (None, "nobody else has this")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in shingles.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for (i, _), c in got.items() if i in (1, 2, 3, 4)} == {1} and got[9, 2] == 9 and got[None, 58] == 1 and got[None, 2] is None


def test_jaccard_of_one_very_long_text(spark):
    words = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-100])), (3, "short text here"), (4, "x" * 3_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (399_998, 1), 2: (399_898, 1), 3: (1, 3), 4: (1, 4)}


def test_jaccard_large_groups_in_parts(spark, monkeypatch):
    """Groups beyond a task's size, with copies on either side of the similarity: parts, shared members and searches across."""
    monkeypatch.setattr(shingles, "CELL", 5)
    monkeypatch.setattr(shingles, "FAN_OUT", 3)
    monkeypatch.setattr(shingles, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(shingles, "HOT_ROWS", 8)
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}v{i}" for i in range(70)]
        for i in range(40):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(70)] = f"x{rng.randrange(10_000)}"
            rows.append((g * 100 + i, " ".join(copy)))
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, Fraction(4, 5)).collect()}
    assert got == brute(rows, 3, Fraction(4, 5))


def test_entries_that_share_lead_similar_sets_together():
    import numpy as np

    rng = np.random.default_rng(5)
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)):
        for _ in range(200):
            n = int(rng.integers(1, 60))
            every = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
            x = np.unique(every[:n])
            y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(n * float(t) * rng.uniform(0.9, 1.2)))], every[n : n + int(rng.integers(0, n // 4 + 1))]]))
            both = len(np.intersect1d(x, y))
            if both * t.denominator < t.numerator * (len(x) + len(y) - both) or (len(x) == len(y) == both):
                continue
            frequent = np.sort(rng.permutation(every)[:n])
            doc, key, smaller = shingles.entries(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), frequent, t)
            small = int(len(y) < len(x))
            assert set(key[(doc == small) & smaller]) & set(key[doc != small])


def test_count_tree_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    p = rng.poisson(4, (300, 16)).astype(np.int32)
    p[150:] = np.maximum(0, p[:150] + rng.integers(-1, 2, (150, 16)))
    n = p.sum(1)
    tree = shingles.CountTree(p, n)
    for i in range(0, 300, 7):
        bound = np.minimum(p, p[i]).sum(1)
        want = {j for j in range(300) if min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and bound[j] >= 0.8 / 1.8 * (n[i] + n[j]) - 1e-6}
        assert want <= set(tree.search(p[i], int(n[i]), 0.8).tolist())


def test_shards(spark):
    rows = [(i, f"text {i % 40}" if i % 3 else "hot" * 5) for i in range(500)] + [(500, None), (501, None), (502, ""), (503, ""), (7, "text 7"), (7, "text 7")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    for shards in (1, 4, 16):
        p = sharding.shard_documents(df, shards).toPandas()
        assert len(p) == len(rows) and set(p.law) == {"rows"} and p.grown_shard.isna().all()
        counts = p.groupby("shard").size().reindex(range(shards), fill_value=0)
        assert counts.max() - counts.min() <= 1
        for _, g in p.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        for r, (_, t) in zip(sorted(p.itertuples(), key=lambda r: (r.doc_id, r.size)), sorted(rows, key=lambda r: (r[0], len(r[1] or ""))), strict=True):
            assert r.size == len((t or "").encode()) + 1 and (t is None or r.text_crc32 == zlib.crc32(t.encode()))
    hot = p[p.text_crc32 == zlib.crc32(b"hot" * 5)]
    small = p[(p.text_crc32 == zlib.crc32(b"text 5"))]
    assert small.shard.nunique() == 1 and hot.shard.nunique() <= 8
    assert sharding.shard_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("singly", [64, 2])
def test_shards_hold_every_group_whole(spark, monkeypatch, singly):
    monkeypatch.setattr(sharding, "SINGLY", singly, raising=False)
    rng = random.Random(6)
    texts, k = ["hot"] * 2000, 0
    while len(texts) < 4400:
        texts += [f"group {k}"] * min(150, int(2 * rng.paretovariate(0.9)))
        k += 1
    texts += [f"alone {i}" for i in range(6000 - len(texts))]
    p = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).toPandas()
    counts = p.groupby("shard").size()
    assert len(p) == 6000 and counts.max() - counts.min() <= 1
    spread = p.assign(text=[texts[i] for i in p.doc_id]).groupby("text").shard.nunique()
    assert spread["hot"] <= 6 and (spread.drop("hot") == 1).all()


def test_urls(spark):
    cases = [
        ("http://x.com/a", "x.com", "/a", "com/", "allow"), ("https://EXAMPLE.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("http://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
        ("http://com", "com", "", None, None), ("http://xcom/en/", "xcom", "/en/", None, None), ("a://b?x/y", "b", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://y://z/p", "y:", "//z/p", None, None), ("http://a.net/es", "a.net", "/es", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)] + [(0, cases[0][0], "x")], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_urls_native(spark):
    plan = url_filter.judge_urls(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_model_learns(spark):
    rows = [(i, f"http://good{i % 7}.com/news/{i}") for i in range(300)] + [(1000 + i, f"http://bad{i % 7}.net/es/win/{i}") for i in range(300)] + [(5000, "http://good3.org/news/5"), (5001, "http://bad3.org/es/win/5")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_url_scores_against_plain_counting(spark):
    import math
    from collections import Counter

    import numpy as np

    rng = random.Random(8)
    urls = [f"http://{rng.choice(['ab', 'cd', 'É'])}{rng.randrange(9)}.{tld}/{rng.choice(['es', 'fr', 'x'])}/{rng.randrange(99)}?q={rng.choice(['one', 'two'])}#F" for tld in ("com", "net", "org") for _ in range(60)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0], "none", None])], "page_id long, url string")
    got = url_filter.judge_urls(df).collect()
    text = lambda u: "" if u is None or "://" not in u else (lambda r: re.match(r"[^/?#]*", r)[0].translate({c: c + 32 for c in range(65, 91)}) + r[len(re.match(r"[^/?#]*", r)[0]) :])(u.split("://", 1)[1])
    held = {r.page_id: r for r in got}
    ruled = {text(u): held[i].verdict for i, u in enumerate(urls) if held[i].rule}
    keys = {r._u: r.k for r in spark.createDataFrame([(u,) for u in {text(u) for u in [*urls, None]}], "_u string").selectExpr("_u", "pmod(xxhash64(_u), 5) k").collect()}
    counts = {v: Counter() for v in ("allow", "block")}
    grams = lambda u: [("\x02" * 3 + u + "\x03")[i : i + 4] for i in range(len(u) + 1)]
    for u, v in ruled.items():
        if keys[u]:
            for g in grams(u):
                for k in range(5):
                    counts[v][k, "n", g[4 - k :]] += 1  # the last k characters
                    counts[v][k, "c", g[3 - k : 3]] += 1  # the k before the last

    def p(v, g):
        out = 1 / 256
        for k in range(1, 5):
            out = (counts[v][k, "n", g[4 - k :]] + 4 * out) / (counts[v][k - 1, "c", g[4 - k : 3]] + 4)
        return out

    for r, u in zip(sorted(got, key=lambda r: r.page_id), [*urls, urls[0], "none", None], strict=True):
        want = np.mean([math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(text(u))])
        assert abs(r.score - want) < 1e-9, u
    free = [r for r in got if r.rule is None]
    assert max((r.score for r in free if r.verdict == "block"), default=-9) < min((r.score for r in free if r.verdict == "allow"), default=9)
    # the whole URL counts: two that differ behind the path have scores of their own
    pair = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://a.org/x?q=one", "http://a.org/x?zzz"])], "page_id long, url string")
    assert len({r.score for r in url_filter.judge_urls(pair).filter(f"page_id >= {len(urls)}").collect()}) == 2


def test_shards_cut_fewer_links_than_hashed_ones(spark):
    """Equal texts are linked; of all such pairs a propagated shard cuts far less than shards by a hash of the id."""
    rng = random.Random(2)
    texts = [f"group {rng.randrange(300)}" for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = sharding.shard_documents(df, 8).toPandas()
    shard = dict(zip(p.doc_id, p.shard, strict=True))
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t, []).append(i)
    pairs = [(a, b) for g in by.values() for k, a in enumerate(g) for b in g[:k]]
    cut = sum(shard[a] != shard[b] for a, b in pairs)
    hashed = sum(zlib.crc32(str(a).encode()) % 8 != zlib.crc32(str(b).encode()) % 8 for a, b in pairs)
    assert hashed > 0.8 * len(pairs) and cut < 0.02 * len(pairs)


def test_quality_weights_against_a_plain_solution(spark):
    import numpy as np
    import pyarrow as pa

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    held = docs.join(labels.filter("quality IS NOT NULL"), "doc_id").select("doc_id", "text", "quality").toPandas()
    held = held[[zlib.crc32(str(i).encode()) % 5 != 0 for i in held.doc_id]]
    x = np.stack(list(quality.statistics(pa.array(held.text.tolist(), pa.string()))))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale[model.scale != 1], x.std(0)[model.scale != 1])
    z = model.basis(x)
    # the features approximate a Gaussian kernel of the standardised statistics
    u = np.clip((x[:40] - model.mean) / model.scale, -8, 8)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / (2 * quality.WIDTH**2))
    waves = z[:40, 1 + x.shape[1] :]
    assert np.abs(waves @ waves.T - kernel).mean() < 0.1
    penalty = np.eye(z.shape[1]) * quality.RIDGE * len(x) / z.shape[1]
    penalty[0, 0] = 1e-9
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ held.quality.to_numpy(float)), z @ model.weights, atol=1e-6)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "a" * 100_000, "x"), (-1, None, "x")], "doc_id long, text string, score string")
    extra = quality.score_documents(odd, model).collect()
    assert len(extra) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in extra)
    p = quality.score_documents(docs, model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    held = p[[zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id]]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert quality.score_documents(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs.limit(5), none).collect()} == {0.5}


def test_isotonic():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    knots, values = quality.isotonic(s, (s + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 — …"), (4, "漢字"), (5, "x"), (5, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.label_documents(odd, model, spans=True).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "und" and got[1][1] == 0 and got[4][0] in model.langs and got[5][0] in model.langs
    p = langid.label_documents(docs, model).toPandas()
    held = p[[zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert langid.label_documents(docs.limit(0), model).count() == 0
    one = docs.filter("lang = 'en'").first().text.split()[:60]
    two = docs.filter("lang = 'de'").first().text.split()[:60]
    spans = langid.label_documents(spark.createDataFrame([(1, " ".join(one + two))], "doc_id long, text string"), model, spans=True).first().lang_spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[1].first_word - len(one)) <= 3
    empty = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.label_documents(docs.limit(3), empty).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the house and the garden {i}", "en") for i in range(3000)] + [(10_000 + i, f"der hund und die katze {i}", "de") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, train_docs=20)
    assert model.langs == ["de", "en"]
    got = langid.label_documents(df.filter("lang = 'de'"), model).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["de"]


def test_no_letter_in_characters_of_many_bytes():
    import numpy as np
    import pyarrow as pa

    m = langid.LanguageModel(["a", "b"], np.zeros((1 << 16, 2), np.float32), np.zeros((1 << langid.BITS, 2), np.float32), np.ones((13, 2), bool))
    none = ["😀😀😀", "★★★ 12", "。。。", "٠١٢٣٤", "😀 " * 500, "", None, *[c * n for c in ("😀", "。", "１", "٣", "！") for n in (1, 2, 8, 9, 1000)]]
    some = ["x 😀😀😀", "漢字漢字漢字", "é 😀😀😀", "★★★ я"]
    names, scores = m.label(pa.array(none + some, pa.string()))
    assert names.to_pylist() == ["und"] * len(none) + ["a"] * len(some)
    assert scores.to_pylist()[: len(none)] == [0.0] * len(none) and min(scores.to_pylist()[len(none) :]) > 0


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    m = langid.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.zeros((1, 3)), np.ones((13, 3), bool))
    sizes = [0, 1, 5, 3, 0, 6]
    scores = (rng.normal(size=(sum(sizes), 3)) * 10).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    path = m.paths(scores, first)
    for a, b in zip(first, first[1:], strict=False):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023,E731
        if b > a:
            assert abs(value(path[a:b].tolist()) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-3
