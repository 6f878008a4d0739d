"""URL filter, language identification and toxicity."""

import hashlib
import math
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import language, toxicity, urls
from tidewater.llm.queries import URL_RULES


def judged(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    return [r.asDict() for r in urls.judge_urls(df, URL_RULES).orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/ES/x?y#z": ("a.example.org", "/ES/x", "org/"), "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/"), "https://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1"),
        "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/"), "http://b.com/fr/": ("b.com", "/fr/", "com/fr/"), "http://b.com/de/x": ("b.com", "/de/x", "com/de/"), "http://com?x": ("com", "", None), "http://x.org": ("x.org", "", None),
        "no scheme.org/": ("", "", None), "a://b://c/d": ("b:", "//c/d", None), "": ("", "", None), "http://Ünder.ORG/é": ("Ünder.org", "/é", "org/"),
    }
    rows = judged(spark, [*cases, None])
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [*cases.values(), ("", "", None)]
    assert [r["verdict"] for r in rows if r["rule"]] == ["allow", "block", "block", "allow", "allow", "block", "allow"]
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def plain_differences(rows):
    """Scores by a plain recursion over dictionaries: of rows (url, judged, half), by all models."""
    k = urls.ORDER
    padded = lambda u: urls.START * (k - 1) + "".join(c.lower() if c.isascii() else c for c in u or "") + urls.END
    counts = {}
    for url, judged, half in rows:
        if judged:
            for i in range(len(padded(url)) - k + 1):
                g = padded(url)[i : i + k]
                for n in range(1, k + 1):
                    counts.setdefault((judged, half), Counter())[g[-n:]] += 1
    after = {}
    for model, c in [*counts.items(), *((j, sum((c for (x, _), c in counts.items() if x == j), Counter())) for j in ("allow", "block"))]:
        after[model] = held = {}
        for g, n in c.items():
            held.setdefault((len(g), g[:-1]), []).append(n)
        after[model, "c"] = c

    def p(model, g):
        if not g:
            return 1 / urls.ALPHABET
        q, held = p(model, g[1:]), after.get(model, {}).get((len(g), g[:-1]), [])
        return (after[model, "c"][g] + len(held) * q) / (sum(held) + len(held)) if held else q

    def score(url, half=None):
        t = padded(url)
        of = lambda j: j if half is None else (j, 1 - half)
        each = [math.log(p(of("allow"), t[i : i + k]) / p(of("block"), t[i : i + k])) for i in range(len(t) - k + 1)]
        return sum(each) / len(each)

    return score


def test_scores_equal_a_plain_markov_model(spark, monkeypatch):
    rng = random.Random(1)
    sites = ["a.com/fr/", "b.com/de/", "c.org/", "d.example.org/en/1", "d.example.org/en/2", "e.net/", "f.io/x?q="]
    rows = [(i, f"HTTPS://{rng.choice(sites)}{''.join(rng.choice('abé0123/-') for _ in range(rng.randrange(12)))}") for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None), (501, "no scheme"), (None, rows[0][1])], "page_id long, url string")
    found = urls.judge_urls(df, URL_RULES).collect()
    half = {r["url"]: r["h"] for r in df.selectExpr("url", "pmod(xxhash64(url), 2) AS h").collect()}
    by_id = {r["page_id"]: r for r in found}
    url_of = {**dict(rows), 500: None, 501: "no scheme", None: rows[0][1]}
    score = plain_differences([(u, by_id[i]["verdict"] if by_id[i]["rule"] else None, half[u]) for i, u in url_of.items()])
    for i, u in url_of.items():
        assert by_id[i]["score"] == pytest.approx(score(u), abs=1e-4)
    cut = found[0]["threshold"]
    own = [(score(u, half[u]), by_id[i]["verdict"]) for i, u in url_of.items() if by_id[i]["rule"]]
    errors = lambda t: sum(s < t for s, v in own if v == "allow") / sum(v == "allow" for _, v in own) + sum(s >= t for s, v in own if v == "block") / sum(v == "block" for _, v in own)
    assert errors(cut) <= min(errors(-5 + 0.01 * k) for k in range(1000)) + 0.05
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, urls.judge_urls(df, URL_RULES).collect())) == sorted(map(str, found))


def test_only_the_most_frequent_grams_are_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, f"http://{rng.choice(['a.com/fr/', 'b.com/de/', 'e.net/'])}{rng.randrange(10**6)}") for i in range(150)], "page_id long, url string")
    want, sent, broadcast = sorted(map(str, urls.judge_urls(df, URL_RULES).collect())), [], F.broadcast
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", 30)
    monkeypatch.setattr(urls.F, "broadcast", lambda rows: (sent.append(rows.count()), broadcast(rows))[1])
    assert sorted(map(str, urls.judge_urls(df, URL_RULES).collect())) == want
    assert len(sent) == 1 and 0 < sent[0] <= 30


def test_url_edge_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/1"), (1, "http://x.net/1"), (2, "h://" + "x" * 200_000), (None, "http://x.net/1"), (None, None)], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS score", "2 AS row", "3 AS gram", "4 AS half")
    rows = urls.judge_urls(df, URL_RULES).collect()
    assert len(rows) == 5 and all(r["verdict"] == "allow" and r["score"] == 0 for r in rows)
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0


def texts_of(lang, rng, n):
    words = {"en": ["the", "thing", "and", "other", "when"], "fr": ["les", "eaux", "avec", "été", "pour"]}[lang]
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_on_held_out_texts(spark, awkward, empty):
    rng = random.Random(2)
    rows = [(i, texts_of(lang := "en" if i % 2 else "fr", rng, 30), lang) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(df.where(~out), sample=100, landmarks=20)
    got = language.identify(df.where(out), model).join(df, F.col("key") == F.col("doc_id"))
    assert got.where("lang_pred <> lang").count() == 0 and got.where("score < 0 OR score > 1").count() == 0
    found = {r["key"]: r["lang_pred"] for r in language.identify(awkward, model).collect()}
    assert [found[i] for i in (2, 3, 4, 9)] == ["und"] * 4 and found[10] in ("en", "fr")
    assert language.identify(empty, model).count() == 0 and language.fit(empty) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    kept = language.keep_identified(awkward, language.fit(awkward))
    assert kept.columns == awkward.columns and {2, 3, 4, 9}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == awkward.count() - 4


def test_predictions_decide_what_is_kept(spark):
    rng = random.Random(5)
    rows = [(i, texts_of(("en", "fr")[i % 2], rng, 30), ("en", "fr")[i % 2]) for i in range(80)]
    other = [(100, "Съешь ещё этих мягких французских булок", None), (101, "12 34", None), (102, None, "en"), (103, texts_of("fr", rng, 30), "en")]
    df = spark.createDataFrame(rows + other, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "'y' AS key")
    model = language.fit(df.where("doc_id < 80"))
    kept = lambda **how: {r["doc_id"] for r in language.keep_identified(df, model, **how).collect()}
    assert kept() == {*range(80), 103}
    assert kept(languages=("en",)) == set(range(0, 80, 2))
    assert kept(least=0.0) == {*range(80), 100, 103}


def test_sample_takes_the_first_rows_of_each_language(spark):
    """Ties and repeated ids too, whatever share of the rows a language has."""
    rows = [(i // 2, f"t{i}", "en" if i % 50 else "fr") for i in range(3000)]
    got = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40).collect()
    key = lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])
    want = [sorted(key(r) for r in rows if r[2] == lang)[:20] for lang in ("en", "fr")]
    assert len(got) == 40 and all({key((r["doc_id"],)) for r in got if r["lang"] == lang} <= set(w) for lang, w in zip(("en", "fr"), want))


def test_letters_decide_without_a_language_model(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "汉字", None), (3, "12 !?", None), (4, None, None)], "doc_id long, text string, lang string")
    assert language.fit(df) is None
    assert {r["doc_id"] for r in language.keep_identified(df, language.fit(df)).collect()} == {1, 2}


def test_kernel_is_that_of_shared_ngrams():
    def features(t):
        b = (" " + t + " ").encode()
        return {b[i : i + n] for n in language.LENGTHS for i in range(len(b) - n + 1)}

    a, b = "hello there", "other hello"
    model = language.Classifier.fit([a.encode(), b.encode()], ["x", "y"], 2, 1e-3)
    want = len(features(a) & features(b)) / math.sqrt(len(features(a)) * len(features(b)))
    assert model.kernel([b.encode()])[0, 0] == pytest.approx(want)


def test_toxicity_on_held_out_texts(spark, awkward, empty):
    rng = random.Random(3)
    insult = lambda: "lostra" + rng.choice(["un", "chaft", "wei"])
    rows, labels = [], []
    for i in range(600):
        words = texts_of("en", rng, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = insult()
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, weights = toxicity.fit(df, known.where("doc_id % 3 <> 1"))
    got = toxicity.score(df, model, weights).join(known, "doc_id").where("doc_id % 3 = 1")
    assert got.where("predicted <> toxic").count() == 0 and got.where("score < 0 OR score > 1").count() == 0
    assert toxicity.score(awkward, model, weights).count() == awkward.count()
    assert toxicity.score(empty, model, weights).count() == 0
    assert toxicity.fit(empty, known) == (None, 0.0) and toxicity.fit(df, known.limit(0)) == (None, 0.0)
    assert toxicity.fit(df, known.where("toxic = 1")) == (None, 1.0)


def test_models_are_distributions():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, toxicity.SYMBOLS**toxicity.ORDER) * (rng.random(toxicity.SYMBOLS**toxicity.ORDER) < 0.01)
    shared = toxicity.Model._shared(counts)
    assert shared.reshape(-1, toxicity.SYMBOLS).sum(1) == pytest.approx(1)
    assert toxicity.Model._top(counts, shared).reshape(-1, toxicity.SYMBOLS).sum(1) == pytest.approx(1)


def test_toxic_words_of_ordinary_characters(spark, monkeypatch):
    """Both classes have the same grams of four characters; only the whole words differ."""
    rng = random.Random(4)
    pairs = (("taenelo", "mieneru"), ("taeneru", "mienelo"))
    rows = [(i, " ".join([*texts_of("en", rng, 20).split(), *pairs[i % 4 == 0], "Été"])) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted, weights = toxicity.fit(df, known.where("doc_id % 3 <> 1"))
    got = toxicity.score(df, fitted, weights).join(known, "doc_id").where("doc_id % 3 = 1")
    assert got.count() == 133 and got.where("predicted <> toxic").count() == 0


def test_text_without_spaces_costs_in_proportion(spark):
    """Three copies of a long run: every beginning of the whole run would be a node of its length."""
    import tracemalloc

    rng = random.Random(8)
    run = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    long = run(340_000)
    assert b"".join(toxicity.words(long.encode())) == long.encode() and max(map(len, toxicity.words(long.encode()))) <= 4 * toxicity.LONGEST
    mixed = "short " + "é" * 100 + " words, " + "x" * 48
    assert [len(w.decode()) for w in toxicity.words(mixed.encode())] == [5, 48, 48, 4, 5, 48]
    counted = [(w, [3, 0, 0, 0]) for w in sorted(set(toxicity.words(long[:40_000].encode())))]
    columns = [pa.array([w for w, _ in counted], pa.binary()), *[pa.array([n[i] for _, n in counted], pa.int64()) for i in range(4)]]
    tracemalloc.start()
    began = time.process_time()
    nodes = sum(b.num_rows for b in toxicity._noded(3)(iter([pa.RecordBatch.from_arrays(columns, ["word", *toxicity.KINDS])])))
    assert nodes > 30_000 and tracemalloc.get_traced_memory()[1] < 150e6 and time.process_time() - began < 20
    tracemalloc.stop()
    part = long[:60_000]
    df = spark.createDataFrame([(i, part if i < 3 else f"{run(30)} words {i}", i % 2) for i in range(12)], "doc_id long, text string, toxic int")
    fitted, weights = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, fitted, weights).collect()}
    assert len(got) == 12 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("words", [0, 1_000_000])
def test_toxicity_is_equal_by_arrays_and_joins(spark, awkward, monkeypatch, words):
    known = awkward.selectExpr("doc_id", "if(doc_id % 2 = 0, 1, 0) AS toxic")
    fitted, weights = toxicity.fit(awkward, known)
    scores = lambda: sorted((r["doc_id"] or -1, round(r["score"], 5)) for r in toxicity.score(awkward, fitted, weights).collect())
    whole = scores()
    monkeypatch.setattr(toxicity, "AT_ONCE", -1)
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", words)
    assert scores() == whole


@pytest.mark.parametrize("cutoff", [1, 2, 3])
def test_word_differences_equal_plain_recursion(spark, cutoff):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(make() for _ in range(12))) for i in range(60)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    fitted, _ = toxicity.fit(df, known, cutoff=cutoff)
    counts = Counter()
    for i, text in rows:
        for w in text.split():
            for k in range(toxicity.SHORTEST + 1, len(w) + 2):
                counts[i % 3 == 0, (w + "$")[:k]] += 1

    kept = {g for _, g in counts if counts[True, g] + counts[False, g] >= cutoff}

    def p(toxic, gram, q):
        held = {g: n for (c, g), n in counts.items() if c == toxic and n and len(g) == len(gram) and g[:-1] == gram[:-1]}
        one, two = (sum(n == k for (c, g), n in counts.items() if c == toxic and g in kept) for k in (1, 2))
        d = one / (one + 2 * two)
        own = max(held.get(gram, 0) - d, 0) if gram in kept else 0
        free = sum(d if g in kept else n for g, n in held.items())
        # A beginning that is no node tells nothing of what follows it.
        before = sum(n for (_, g), n in counts.items() if len(g) == len(gram) and g[:-1] == gram[:-1]) >= cutoff
        return (own + free * q) / sum(held.values()) if held and before else q

    tests = [*{w for _, text in rows for w in text.split()}][:40] + [make() + "zab" for _ in range(10)]
    found = {r["word"]: r["word2"] for r in toxicity.word_differences(spark.createDataFrame([(w,) for w in tests], "text string"), fitted, (2,)).collect()}
    model = fitted.models[2]
    for w in tests:
        code, want = toxicity.beginnings([w.encode()])[2], 0.0
        for k in range(1, len(w) + 2):
            q = [float(x[code[k - 1]]) for x in (model.toxic, model.ordinary)]
            both = [p(c, (w + "$")[:k], x) if k > toxicity.SHORTEST else x for c, x in zip((True, False), q)]
            want += math.log(both[0] / both[1])
        assert found[toxicity.xxhash.xxh64_intdigest(w.encode()) - (1 << 64) * (toxicity.xxhash.xxh64_intdigest(w.encode()) >> 63)] == pytest.approx(want, abs=1e-3)
