"""Exact and near dedup against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import near_dedup as N
from tessel.llm.exact_dedup import PatriciaTrie, common_length, deduplicated, exact_dedup

DOCS = "doc_id bigint, text string, keep_id string, kept int"  # columns that clash with result names


@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_holds_what_a_dict_holds(keys):
    trie, expected = PatriciaTrie(), defaultdict(list)
    for i, k in enumerate(keys):
        trie.terminal(k).add(i, i, i, 1, False)
        expected[k].append(i)
    found = sorted((t.smallest, t.largest, t.count, t.owner) for t in trie.close())
    assert found == sorted((min(v), max(v), len(v), min(v)) for v in expected.values())


@given(st.lists(st.binary(max_size=6), max_size=60), st.integers(0, 3000))
def test_subtrees_spill_and_the_rest_stays(keys, goal):
    trie, found = PatriciaTrie(), []
    for i, k in enumerate(keys):
        terminal = trie.terminal(k)
        trie.hold(terminal, 100)
        terminal.add(k, i, i, 1, False)
    found = [m for t in trie.spill(goal) for m in t.members]
    assert trie.bytes <= goal
    assert sorted(found + [m for t in trie.close() for m in t.members]) == sorted(keys)


@given(st.lists(st.binary(max_size=5), max_size=60), st.integers(1, 2000))
def test_complete_subtrees_spill_in_order(keys, budget):
    """As the second tries are used: strings in order, each string's copies in one terminal."""
    trie, found, last = PatriciaTrie(), [], None
    for i, k in enumerate(sorted(keys)):
        if trie.bytes > budget and k != last:
            found += list(trie.spill_before(k))
        last = k
        terminal = trie.terminal(k)
        trie.hold(terminal, 100)
        terminal.add(k, i, i, 1, False)
    found += list(trie.close())
    assert sorted((t.members[0], t.count) for t in found) == sorted((k, keys.count(k)) for k in set(keys))


def test_common_length():
    assert common_length(b"abcd", b"xxabxd", 2) == 2
    assert common_length(b"ab", b"ab", 0) == 2
    assert common_length(b"a", b"b", 0) == 0


def exact(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS)
    return [r.asDict() for r in exact_dedup(df, **options).collect()]


ROWS = [(1, "a", "x", 0), (2, "a", "x", 0), (3, "", "x", 0), (4, None, "x", 0), (5, "A", "x", 0), (None, "a", "x", 0), (None, "only", "x", 0), (7, "dup", "x", 0), (7, "dup", "x", 0), (8, "é" * 9000, None, 0)]


@pytest.mark.parametrize("keep,trie_bytes", [("largest", 1 << 20), ("smallest", 1 << 20), ("largest", 1)])
def test_exact_dedup(spark, keep, trie_bytes):
    out = exact(spark, ROWS, keep=keep, trie_bytes=trie_bytes)
    assert len(out) == len(ROWS)
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    pick = max if keep == "largest" else min
    for r in out:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == pick([i for i in ids if i is not None], default=None)
    kept = defaultdict(int)
    for r in out:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_of_nothing_and_with_normalisation(spark):
    from pyspark.sql import functions as F

    assert exact(spark, []) == []
    out = exact(spark, ROWS, normalize=F.lower)
    assert {r["group_size"] for r in out if r["doc_id"] in (1, 2, 5)} == {4}


def test_deduplicated_keeps_whole_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    out = deduplicated(df, keep="largest")
    assert out.schema.simpleString() == df.schema.simpleString()
    small = deduplicated(df.repartition(3), keep="largest", trie_bytes=1)
    assert sorted(map(str, small.collect())) == sorted(map(str, out.collect()))
    kept = {(r["doc_id"], r["text"][:4], r["keep_id"]) for r in out.collect()}
    assert kept == {(None, "only", "x"), (4, "", "x"), (5, "A", "x"), (7, "dup", "x"), (8, "éééé", None), (2, "a", "x")}
    assert out.count() == 6
    assert deduplicated(df.limit(0)).count() == 0


# -- near dedup
def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_of(rows):
    """Lists of row numbers that links join."""
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_ = [sets(t) for _, t in rows]
    for i, a in enumerate(all_):
        for j in range(i):
            b = all_[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    found = defaultdict(list)
    for i in range(len(rows)):
        found[find(i)].append(i)
    return list(found.values())


def brute(rows):
    out = [None] * len(rows)
    for members in components_of(rows):
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[i] = (rows[i][0], len(sets(rows[i][1])), least)
    return out


def family(rng, base, copies, edits):
    """Copies of a text with a few words exchanged: near the base, not always near each other."""
    out = []
    for _ in range(copies):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    base = " ".join(rng.choices(words, k=146))
    texts += [base, *family(rng, base, 60, 3), *family(rng, base, 30, 5)]
    texts += family(rng, texts[0] + " " + base, 10, 2)
    texts += ["a b c d", "A  b\tc d", "a b c", "", None, " \n ", texts[5], texts[5], texts[5].upper(), "one", "one"]
    rng.shuffle(texts)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, component_id string, kept int").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = N.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, survivors(rows)))


def survivors(rows):
    """The ids of what stays: documents without words, and of each component its smallest id once (null if it has none)."""
    named, out = components_of(rows), []
    for members in named:
        if not sets(rows[members[0]][1]):
            out += [rows[i][0] for i in members]
        else:
            out.append(min((rows[i][0] for i in members if rows[i][0] is not None), default=None))
    return out


def test_unique_texts_survive_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (5, b), (7, c), (7, b), (9, d), (9, d), (None, "x y"), (None, "x y"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = sorted(((r["doc_id"], r["text"]) for r in N.without_near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, a), (5, b), (7, c), (9, d), (None, "x y"), (3, None), (3, "")], key=str)
    marked = N.near_duplicates(df).collect()
    assert len(marked) == len(rows) and {r["component_id"] for r in marked if r["kept"] is False} == {5}


def test_ids_of_other_types_are_refused(spark):
    df = spark.createDataFrame([(1.2, "a b c"), (1.7, "a b c")], "doc_id double, text string")
    for operator in (N.near_duplicates, N.without_near_duplicates, exact_dedup, deduplicated):
        with pytest.raises(TypeError):
            operator(df)


def test_string_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [("b", base), ("a", base.upper()), ("c", base + " more"), (None, "other words"), ("d", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()}
    assert got == {"b": ("a", False), "a": ("a", True), "c": ("a", False), None: (None, True), "d": ("d", True)}
    assert {r["doc_id"] for r in N.without_near_duplicates(df).collect()} == {"a", None, "d"}
    out = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(spark.createDataFrame([("b", "x"), ("a", "x")], "doc_id string, text string")).collect()}
    assert out == {"b": ("a", False), "a": ("a", True)}


def test_hot_keys_are_dealt_in_parts(spark, monkeypatch):
    """The way of tables too large to broadcast, with one family of copies and texts of some thousand words."""
    from tessel.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    base = " ".join(rng.choices([f"t{i}" for i in range(900)], k=3000))
    rows = list(enumerate([base] * 15 + family(rng, base, 25, 20) + [f"own {i} words here at last" for i in range(10)]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_near_duplicates_of_nothing(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [r.asDict() for r in N.near_duplicates(spark.createDataFrame([(5, None)], "doc_id bigint, text string")).collect()] == [{"doc_id": 5, "n_shingles": 0, "component_id": 5, "kept": True}]


def test_late_links_are_found(spark, monkeypatch):
    """Small blocks and copies whose hub is not near all of them."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "HUB_PARTNERS", 3)
    rng = random.Random(11)
    base = " ".join(f"q{i}" for i in range(120))
    chain = [base]
    for _ in range(25):
        chain += family(rng, chain[-1], 1, 2)
    rows = list(enumerate(chain + family(rng, base, 20, 4)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    for shared, own in ((3000, 500), (500, 100), (2000, 3000)):
        a, b, c = (np.unique(N._finish(rng.integers(0, 2**63, n, dtype=np.uint64))) for n in (shared, own, own))
        x, y = np.union1d(a, b), np.union1d(a, c)
        guess, based_on = N.estimates(N.registers(x), N.registers(y)[None], len(x), np.array([len(y)]))
        exact_ = shared / (shared + 2 * own)
        assert abs(guess[0] - exact_) < 5 * np.sqrt(exact_ * (1 - exact_) / based_on[0])
    assert 0 < N.chance_matches(np.array([1000]), np.array([1000]))[0] < 0.001


@settings(max_examples=50)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
def test_registers_keep_zeros_and_mantissa(values):
    h = np.unique(np.array(values, np.uint64))
    regs = N.registers(h)
    for bucket in {int(v) >> 56 for v in h}:
        low = min(int(v) for v in h if int(v) >> 56 == bucket)
        rest = (low >> 3) & ((1 << 53) - 1)
        zeros = 53 - rest.bit_length()
        mantissa = (rest << 11 >> rest.bit_length()) - 1024 if rest else 0
        assert int(regs[bucket]) == (zeros << 10 | mantissa) + 1
    assert len(N.band_keys(regs)) == N.BANDS
