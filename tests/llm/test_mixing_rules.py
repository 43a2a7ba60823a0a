"""Mixing and rule ledger against plain recomputation, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tessel.llm import mixing as M
from tessel.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string, source string, size string, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], DDL)


def filled(sizes, weights, epochs=3):
    """Water filling the slow way: take out what is above its cap until nothing is."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weights.items() if s not in capped}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in share if share[s] > epochs * sizes[s]}
        if not over:
            return capped | share
        capped |= {s: epochs * sizes[s] for s in over}


MIXES = {
    "plain": [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(400)],
    "capped": [(i, "w " * 5, "big" if i % 50 else f"small{i % 3}") for i in range(300)],
    "odd": [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (None, "x y z", None), (4, "x " * 40, "é"), (4, "x " * 40, "é"), (5, "one", "a"), (6, "w " * 3000, "b")],
}


@pytest.mark.parametrize("name", MIXES)
def test_mix(spark, name):
    rows = MIXES[name]
    out = [r.asDict() for r in M.training_order(table(spark, rows)).collect()]
    assert len(out) == len(rows)
    key = lambda s: (s is None, (s or "").encode())
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=key))}
    targets = filled(sizes, weights)
    taken = Counter()
    by_text = {(i, size_of(t)): s for i, t, s in rows}
    for r in out:
        s = by_text[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["copies"] == 0)
        taken[s] += r["taken"]
    assert all(taken[s] == math.floor(targets[s] + 1e-9) for s in sizes)
    places = [r["position"] for r in out if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    again = [r.asDict() for r in M.training_order(table(spark, rows[::-1]).repartition(3)).collect()]
    order = lambda rs: sorted((str(r["doc_id"]), r["taken"], r["position"] or -1) for r in rs)
    assert order(out) == order(again)


def test_mixed_repeats_whole_rows(spark):
    df = table(spark, MIXES["capped"])
    out = M.mixed(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["copies"] for r in M.mix(df).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == {k: v for k, v in copies.items() if v}
    assert M.mixed(df.limit(0)).count() == 0 and M.training_order(df.limit(0)).count() == 0


def test_no_bucket_holds_a_source(spark):
    df = table(spark, [(i, "w", "one") for i in range(5000)])
    sized = M.mix(df, bucket_rows=100)
    assert sized.agg({"taken": "sum"}).collect()[0][0] == 5000
    assert "Python" not in sized._jdf.queryExecution().toString()


@pytest.mark.parametrize("knots", [*M.SCHEDULES, ((0, 0), (0.5, 2), (1, 0)), ((0, 1), (0.25, 0), (0.75, 0), (1, 3))])
def test_schedules_invert(spark, knots):
    from pyspark.sql import functions as F

    total = M.integral(knots)
    pieces = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("at", "t", "w", "slope"), s)]) for s in M.segments(knots)])
    rows = spark.range(51).select((F.col("id") / 50 * total).alias("c")).withColumn("t", M._time_at(F.col("c"), pieces)).collect()

    def weight(t):
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
        return knots[-1][1]

    for r in rows:
        steps = 4000
        area = sum(weight((i + 0.5) * r["t"] / steps) for i in range(steps)) * r["t"] / steps
        assert abs(area - r["c"]) < 2e-3


# -- rules
TEXTS = ["", None, "one", "a b c a b c", "a b a b a b", "x\ny\nx\n \nx", "### %%% word", "ABC DEF g", " \x0b\x0c", "w " * 49, "w " * 50, "w1 " * 30 + " ".join(f"v{i}" for i in range(40)), "é ü a b é ü", "l\r\nl\r\nl", " ".join(f"t{i % 600}" for i in range(3000))]


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text))


def test_ledger(spark):
    df = spark.createDataFrame([(i if i else None, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int, failed string")
    out = {r["doc_id"]: r for r in R.judged(df).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = out[i if i else None]
        m = measures(t)
        assert tuple(r[c] for c in R.MEASURES) == m, t
        base = m[0] < 50 or 100 * m[5] > 50 * m[0]
        assert r["base_failed"] == base and (not r["kept"] or not base)
        bits = [m[0] < 50, 100 * m[5] > 50 * m[0], 10 * m[2] > m[0], m[1] < 2 * m[0] or m[1] > 15 * m[0], 10 * m[4] > 3 * m[3], 2 * m[6] > m[1]]
        assert r["failed"] == sum(b << k for k, b in enumerate(bits))
    assert R.judged(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    book = R.ledger(df)
    rows = book.collect()
    assert "Python" not in book._jdf.queryExecution().toString()
    policy = R.Policy("t", ("few_words", "symbols"), ("word_length", "capitals"), 1)
    out = {r["rule"]: r for r in R.ablations(book, policy).collect()}

    def accepted(failed, without=0):
        failed &= ~without
        return not failed & 0b101 and bin(failed & 0b101000).count("1") <= 1

    for i, rule in enumerate(R.RULES):
        has = [r["failed"] for r in rows if r["failed"] >> i & 1]
        beside = 0
        for f in has:
            beside |= f & ~(1 << i)
        assert out[rule.name]["fails"] == len(has) and out[rule.name]["beside"] == beside
        assert out[rule.name]["only"] == sum(not accepted(r["failed"]) and accepted(r["failed"], 1 << i) for r in rows)
