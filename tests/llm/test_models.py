"""The trained operators: held-out accuracy, exact inference against enumeration, edge cases."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import html_extract as H
from tessel.llm import language_id as L
from tessel.llm import quality_crf as Q
from tessel.llm import toxicity as T
from tessel.llm.html_pages import labelled_pages
from tessel.llm.learning import held_out, training_labels

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, "one"), (None, "two words"), (5, "x" * 30_000), (5, "x" * 30_000), (6, "word " * 20_000), (7, "a\n" * 3000), (8, "123 456 !!!")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in ODD], "doc_id bigint, text string, lang_pred string, score double")


@pytest.fixture(scope="module")
def data(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    return read("documents"), read("labels")


def test_folds(spark):
    rows = spark.range(50).withColumn("h", held_out(F.col("id")))
    for r in rows.collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    chosen = training_labels(labels, "doc_id", ["quality"], 30).collect()
    assert len(chosen) == 30 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in chosen)


# -- quality
def test_crf_marginals_are_exact():
    rng = np.random.default_rng(0)
    emissions, move = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    lengths = np.array([5, 3, 1])
    p, pairs, logz = Q.marginals(emissions, lengths, move)
    for c, n in enumerate(lengths):
        total, good, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emissions[c, t] for t in range(n) if labels[t]) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                seen[a, b] += weight
        assert np.allclose(p[c, :n], good / total) and np.allclose(pairs[c], seen / total) and np.isclose(logz[c], np.log(total))


@needs_data
def test_quality_on_held_out_documents(data, odd):
    docs, labels = data
    model = Q.trained(docs, labels)
    rows = Q.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert Q.accepted(docs, model).count() == Q.scored(docs, model).where("predicted = 1").count()
    out = Q.scored(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert Q.accepted(odd, model).columns == odd.columns
    assert Q.scored(odd.limit(0), model).count() == 0


def test_quality_learns_from_all_lines(spark):
    clean, junk = "The river was calm, and the old boats lay still.\n", "$$ || BUY || 99 !! ##\n"
    texts = [clean * (300 + i) if i % 2 else clean * 250 + junk * (250 + i) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = Q.trained(docs, labels)
    # The first 200 lines of both kinds are alike; only what follows tells them apart.
    junk_score, clean_score = Q.quality([(junk * 50).encode(), (clean * 50).encode()], model)
    assert junk_score < 0.2 < 0.6 < clean_score


def test_quality_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = Q.trained(odd, empty)
    assert {round(r["score"], 6) for r in Q.scored(odd, model).collect()} == {0.5}


# -- language
@needs_data
def test_language_on_held_out_documents(data, odd):
    docs, _ = data
    model = L.trained(docs)
    assert sum(len(g) for g in model.families) == 4 and 1 < len(model.families) < 4
    rows = L.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    out = {(r["doc_id"], r["lang_pred"]) for r in L.identified(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= out and all(0 <= r["score"] <= 1 for r in L.identified(odd, model).collect())
    assert L.identified(odd.limit(0), model).count() == 0


def test_language_without_training_texts(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.trained(empty) is None
    assert {r["lang_pred"] for r in L.identified(odd, None).collect()} == {"und"}
    one = spark.createDataFrame([(i, "hello there", "xx") for i in range(30)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in L.identified(one, L.trained(one)).collect()} == {"xx"}


def test_letters_are_what_unicode_calls_letters(spark):
    import unicodedata

    texts = ["½ ² ③", "²", "Ⅷ", "٣ 4", "𝟘 𐄇", "a½", "x²y", "日本", "é", "_", "ª"]
    for t in texts:
        assert L.words_of(t) == [w for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()], t
    one = spark.createDataFrame([(i, "hello there", "xx") for i in range(30)], "doc_id bigint, text string, lang string")
    out = L.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), L.trained(one)).collect()
    assert {texts[r["doc_id"]] for r in out if r["lang_pred"] == "und"} == {"½ ² ③", "²", "Ⅷ", "٣ 4", "𝟘 𐄇", "_"}


def test_svm_against_a_plain_solver():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    sign = np.where(x @ np.array([2.0, -1, 0.5, 0, 0, 0]) + 0.3 * rng.normal(size=120) > 0.4, 1.0, -1.0)
    weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
    data = np.hstack([x, np.ones((120, 1))]).astype(float)

    def loss(w):
        return (weight * np.maximum(0, 1 - sign * (data @ w)) ** 2).sum() + 0.5e-4 * (w**2).sum()

    plain = np.zeros(7)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - sign * (data @ plain))
        plain -= 0.02 * (1e-4 * plain - 2 * (weight * slack * sign) @ data)
    w, b = L.svm(x, sign, rounds=1500)
    assert loss(np.append(w, b)) < 1.02 * loss(plain) + 1e-4
    assert np.mean((x @ w + b > 0) == (data @ plain > 0)) > 0.97


def test_language_query_against_brute_force(spark):
    """Family first, then duels inside it, from plain features of the whole text."""
    rng = np.random.default_rng(6)
    model = L.Model([["a", "b", "c"], ["d"]], [(0, "a", "b"), (0, "a", "c"), (0, "b", "c")], rng.normal(size=(L.DIMENSIONS, 5)), rng.normal(size=5))
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "öl", "x"], size=n)) for n in (1, 2, 5, 40, 3000)] + ["ONE two", "tie tie"]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, t in enumerate(texts):
        out = L.text_features(t).astype(float) @ model.weights + model.bias
        if out[1] > out[0]:
            assert got[i] == "d"
            continue
        wins = {n: [0, 0.0] for n in "abc"}
        for (_, p, q), m in zip(model.pairs, out[2:]):
            wins[p if m >= 0 else q][0] += 1
            wins[p][1] += m
            wins[q][1] -= m
        assert got[i] == max("abc", key=lambda n: (*wins[n], n))


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 7} text{i % 7} {'abcdefg'[i % 7] * 4}", f"l{i % 7}") for i in range(700)] + [(5, "same row", "l0")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    a, b = L.trained(docs, per_language=20), L.trained(docs.repartition(7), per_language=20)
    assert sorted(n for g in a.families for n in g) == [f"l{k}" for k in range(7)]
    assert a.families == b.families and np.allclose(a.weights, b.weights)
    few = L.trained(docs, train_docs=4)  # a bound on languages as well: those with most texts
    assert 0 < len([n for g in few.families for n in g]) <= 4


def test_remembered_scores_are_the_scores():
    rng = np.random.default_rng(2)
    model = L.Model([["a", "b"], ["c"]], [(0, "a", "b")], rng.normal(size=(L.DIMENSIONS, 3)), rng.normal(size=3))
    scorer = L.Scorer(model)
    text = "Some words and some more words"
    expected = L.text_features(text) @ model.weights + model.bias
    for _ in range(2):
        assert np.allclose(scorer.outputs(L.words_of(text)), expected, atol=1e-5)


# -- toxicity
@needs_data
def test_toxicity_on_held_out_documents(data, odd):
    docs, labels = data
    model = T.trained(docs, labels)
    rows = T.severity(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("held_out").collect()
    hit = [r["toxic"] for r in rows if r["label"] == 1]
    false = [r["toxic"] for r in rows if r["label"] == 0]
    assert sum(hit) / len(hit) > 0.6 and sum(false) / len(false) < 0.05  # few toxic ones are held out here
    assert list(model.thresholds) == sorted(model.thresholds)
    out = T.severity(odd, model).collect()
    assert len(out) == len(ODD) and not any(r["toxic"] for r in out)
    assert T.severity(odd.limit(0), model).count() == 0


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(4)
    x = (rng.random((600, 6)) < 0.4).astype(float)
    score = x @ np.array([3.0, 2.0, 1.0, 0, 0, 0])
    grade = (score > 1).astype(int) + (score > 3) + (score > 4)
    w, thresholds = T.fit(x, grade)
    assert w[0] > w[1] > w[2] > max(w[3:]) and all(w >= 0) and list(thresholds) == sorted(thresholds)
    model = T.Model({i: float(v) for i, v in enumerate(w)}, thresholds)
    expected = [model.severity({i for i in range(6) if row[i]})[0] for row in x]
    assert np.corrcoef(expected, grade)[0, 1] > 0.9


def test_ordinal_fit_has_the_largest_likelihood():
    """The fit against plain evaluation of the cumulative-link likelihood around it."""
    rng = np.random.default_rng(8)
    x = (rng.random((300, 5)) < 0.5).astype(float)
    grade = np.clip(np.digitize(x @ np.array([2.0, 1.5, 0.5, 0, 0]) + rng.logistic(size=300), [1.5, 3.0, 4.5]), 0, 3)
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())

    def loss(w, thresholds):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - thresholds[None, :])))
        chance = [np.prod([1.0]) * ((1.0 if g == 0 else above[i, g - 1]) - (0.0 if g == 3 else above[i, g])) for i, g in enumerate(grade)]
        return -(weight * np.log(chance)).sum() + 0.5e-5 * (w**2).sum()

    w, thresholds = T.fit(x, grade, rounds=2000, rate=0.02)
    least = loss(w, thresholds)
    for _ in range(300):
        near = np.maximum(0, w + rng.normal(size=5) * 0.05), np.sort(thresholds + rng.normal(size=3) * 0.05)
        assert loss(*near) > least - 2e-4
    assert loss(np.maximum(0, w * 0.7), thresholds) > least and loss(w, thresholds + 0.5) > least


def test_toxicity_query_is_the_plain_sum(spark):
    """Scores of the query's way (words remembered, features by word) against one plain pass over each text; columns that clash are ignored."""
    features = T.words_of("kill hate awful")
    weights = {f: 1.0 + k / 7 for k, w in enumerate(sorted(features)) for f in T.word_features(w)[:2]}
    model = T.Model(weights, np.array([2.0, 3.0, 5.0]))
    texts = ["hate hate and kill", "awful day", "a fine day", None, "", "KILL! awful, hate", "word " * 5000 + "hate"]
    df = spark.createDataFrame([(i, t, 9.0, 3, True) for i, t in enumerate(texts)], "doc_id bigint, text string, severity double, grade int, toxic boolean")
    for r in T.severity(df, model).collect():
        hits = {f for w in T.words_of(texts[r["doc_id"]] or "") for f in T.word_features(w) if f in weights}
        above = [1 / (1 + np.exp(-(sum(weights[f] for f in hits) - t))) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert np.isclose(r["severity"], sum(above)) and np.isclose(r["p_toxic"], above[0]) and r["grade"] == int(np.argmax(each))
        assert r["toxic"] == (above[0] >= 0.5)


def test_toxicity_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert not any(r["toxic"] for r in T.severity(odd, T.trained(odd, empty)).collect())


# -- pages
def test_sum_product_is_exact():
    rng = np.random.default_rng(1)
    page = H.parse("<div>a<p>b</p><ul><li>c<li>d</ul></div><p>e")
    forest = H.Forest.of([page])
    n = len(page.parents)
    own, tie = rng.normal(size=n), rng.normal(size=(2, 2))
    p, pairs = H.sum_product(forest, own, tie)
    total, main, seen = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(own[i] for i in range(n) if labels[i]) + sum(tie[labels[page.parents[i]], labels[i]] for i in range(1, n)))
        total += weight
        main += weight * np.array(labels)
        for i in range(1, n):
            seen[i, labels[page.parents[i]], labels[i]] += weight
    assert np.allclose(p, main / total) and np.allclose(pairs[1:], (seen / total)[1:])


def test_unseen_labelled_pages():
    model = H.default_model()
    pages = [H.parse(s) for s in labelled_pages(150, seed=123)]
    forest, label = H.Forest.of(pages), np.array([m for p in pages for m in p.marks])
    chars = np.array([c for p in pages for c in p.chars])
    found = H.sum_product(forest, model.own(forest), model.tie)[0] > 0.5
    assert (chars * (found == label)).sum() / chars.sum() > 0.9


ARTICLE = "<article><h1>The  title</h1><p>First &amp; second\n line.</p><p><b>Bold text here.<br><p>Nested para.</p></article>"
PAGES = [
    (1, f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/x>Home</a></nav>{ARTICLE}<footer>&copy; me</footer></body></html>", "The title\nFirst & second line.\nBold text here.\nNested para."),
    (2, f"<body><div class='cookie-notice'>We use cookies.</div><aside class=sidebar>Links <a href=1>a</a></aside>{ARTICLE}<section class=comments><p>I liked this very much. Great!</p></section><form><input>Sign up</form>", "The title\nFirst & second line.\nBold text here.\nNested para."),
    (3, None, ""),
    (4, "", ""),
    (5, "<nav><a href=1>x</a></nav>", ""),
    (6, "<p", None),
    (7, "<article><p>a &lt;b&gt; &#233;&nbsp;c</p></article><!-- <p>no</p> -->", "a <b> é c"),
    (8, '<div class="a>b" title=\'x>y\'><<>>&amp', None),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h, _ in PAGES] + [(None, None, PAGES[0][1], "x")], "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: r for r in H.extracted(df).collect()}
    assert len(out) == len(PAGES) + 1
    for i, _, text in PAGES:
        assert out[i]["url"] == f"u{i}" and out[i]["n_chars"] == len(out[i]["text"])
        if text is not None:
            assert out[i]["text"] == text, i
    assert out[None]["text"] == PAGES[0][2]
    assert H.extracted(df.limit(0)).count() == 0


def test_parser_is_linear():
    """Pages that make a backtracking or stack-walking parser quadratic: ten times the size may take 25 times the time, not 100."""
    import time

    def seconds(page):
        began = time.perf_counter()
        H.Forest.of([H.parse(page)])
        return time.perf_counter() - began

    for one in ('<a "', '<a ">"', "<", "<!--", "<script>"):
        assert seconds(one * 60_000) < 25 * max(0.02, seconds(one * 6000)), one
    nested = ("<div>{}</p>", "<span class=a>{}<hr>", "<b class=x><div><span class=y>{}</b>", "<li><p class=z>{}</td>")
    for start, end in (n.split("{}") for n in nested):
        assert seconds(start * 10_000 + end * 10_000) < 25 * max(0.05, seconds(start * 1000 + end * 1000)), start


def test_parser_closes_what_html_closes():
    shown = lambda s: ["".join(raw for _, raw in b) for b in H.parse(s).blocks]
    assert shown("<p>a<div>b</div><ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert shown("a<!-- b > c -->d<! e>f") == ["adf"] or shown("a<!-- b > c -->d<! e>f") == ["a", "d", "f"]
    assert shown("x < y <!-- z") == ["x < y "] and shown("<p title='a>b'>c</p>") == ["c"]
    assert shown('<p title="a>b</p>c') == ["b", "c"]  # a quote that stays open: the tag ends at its first >
    page = H.parse("<div><b class=x>a<p>b</b>c</p></div>d")
    assert [node for block in page.blocks for node, _ in block] == [2, 3, 3, 0]


def test_pages_of_other_names_and_layouts():
    """Pages written by hand with names that the training pages don't have; what counts is the tags, the links and the text."""
    words = "The council met on Tuesday and agreed on the plan. Work on the bridge begins in spring, as the engineers had hoped."
    body = "".join(f"<p>{words} Part {i} follows soon.</p>" for i in range(6))
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(8))
    pages = [
        f"<body><nav class=zq1><ul>{links}</ul></nav><article class=kx77><h1>Bridge news</h1>{body}</article><footer class=qq>About us <a href=/a>a</a> <a href=/b>b</a></footer></body>",
        f"<body><header><a href=/>Start</a></header><main><div class=blorp>{body}</div></main><aside class=vv>{links}</aside></body>",
        f"<html><body><div class=xyzzy>{body}</div><footer>Imprint <a href=/i>i</a></footer></body></html>",
    ]
    for text in H.main_texts(pages, H.default_model()):
        assert text.count("council met on Tuesday") == 6 and "Section 3" not in text and "Imprint" not in text and "About us" not in text


def test_extraction_of_repeated_and_long_pages(spark):
    long = "<article>" + "<p>A sentence of the story, told at some length.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long), (2, "v", PAGES[0][1]), (2, "v", PAGES[0][1])], "page_id bigint, url string, html string")
    out = sorted((r["page_id"], r["n_chars"]) for r in H.extracted(df).collect())
    assert out[0] == (1, 20_000 * len("A sentence of the story, told at some length.\n") - 1) and out[1] == out[2]


def test_parser_takes_anything():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "text ", "&amp;", "<", ">", "\"", "<li>", "<table>", "<td>", "</table>", "<script>", "</script>", "<!--", "-->", "<a href='", "<br/>"]
    for _ in range(500):
        H.main_texts(["".join(rng.choices(parts, k=rng.randint(0, 40)))], H.default_model())
    H.main_texts(["<div>" * 5000 + "deep"], H.default_model())
