"""Packing, tokens and edit-aware counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import packing as P
from tessel.llm import token_counts as C
from tessel.llm.tokens import ids_for, vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = (vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", " ", "a", "don't  stop\n\n x", "<|endoftext|> in text", "naïve café", "日本語テキスト", "emoji 🙂🙃 x", "\x1c\x1d \x85x", "ⅷ ² ½ ٣", "a b   c", "𝒳𝒴 𐐷", "ͰẞꞮ new", "1234567890" * 30, "a" * 3000, "!!!???---", "'s 'll 'x", "\t\t\r\n \r\n"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_library(exact, text):
    assert ids_for(*PATHS)(text).tolist() == exact(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_on_any_text(text):
    ids = ids_for(*PATHS)
    assert ids(text).tolist() == ids.exact.encode(text, add_special_tokens=False).ids


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)]
    assert P.cut(2049) == [(0, 1), (1, 2048)] and P.cut(4096) == [(0, 2048), (2048, 2048)]


@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_everything_once(lengths):
    bins = P.best_two_fit(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= max(1, 2 * -(-sum(lengths) // 64)) or not lengths


def test_two_pieces_replace_the_smallest():
    # Greedy takes 6 + 3; with 3 exchanged for 2 + 2 the bin of 10 is full.
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in P.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]
    left = P.Unpacked([5, 4, 3, 3])
    assert left.best_two(7, 5) == (3, 4) and left.best_two(6, 5) == (3, 3) and left.best_two(5, 5) is None


def test_near_the_bound():
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)]
    assert len(P.best_two_fit(lengths)) <= -(-sum(lengths) // 2048) + 2


def test_groups_lose_no_sequences(spark, monkeypatch):
    rng = random.Random(4)
    lengths = [rng.randint(1, 60) for _ in range(1500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "_id bigint, length bigint").selectExpr("_id", "0 piece", "0L start", "length", "_id ids_crc32")
    monkeypatch.setattr(P, "pieces", lambda docs, **_: docs)
    out = P.pack(df, id_col="_id", capacity=100, group_pieces=100).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["_id"] for r in out) == list(range(1500)) and all(r["length"] == lengths[r["_id"]] for r in out)
    for members in bins.values():
        ends = [0]
        for offset, n in sorted(members):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 100
    # Fifteen groups on their own would end with about a bin too many each.
    assert len(bins) <= len(P.best_two_fit(lengths, 100)) + 2


def test_copies_are_packed_apart():
    rng = random.Random(6)
    lengths, owners = [], []
    for i in range(400):
        n = rng.randint(1, 60)
        for _ in range(rng.choice([1, 1, 2, 3])):
            lengths.append(n)
            owners.append(i)
    bins = P.best_two_fit(lengths, 100, owners)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 and len({owners[i] for i in b}) == len(b) for b in bins)
    assert len(bins) <= -(-sum(lengths) // 100) + 3
    assert P.best_two_fit([3, 3, 3], 10, ["a"] * 3) == [[2], [1], [0]]


def test_pack_in_training_order(spark, tmp_path):
    """Files hold the order; groups are ranges of it, passes of a document lie in different sequences."""
    rng = random.Random(8)
    rows = [(i % 300, " ".join(["w"] * rng.randint(1, 700)) if i < 300 else "", 1) for i in range(600)]
    rows = [(d, rows[d][1], n) for d, _, n in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, position int").repartitionByRange(4, "position", "doc_id").write.parquet(str(tmp_path / "mix"))
    docs = spark.read.parquet(str(tmp_path / "mix"))
    out = P.pack(docs, order=P.stored_order(docs), group_pieces=64).collect()
    assert len(out) == 600 and sorted(r["position"] for r in out) == list(range(600))
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for members in by_sequence.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["position"] for r in members] == sorted(r["position"] for r in members)
        assert len({r["doc_id"] for r in members}) == len(members)
        assert [r["offset"] for r in members] == [sum(m["length"] for m in members[:k]) for k in range(len(members))]
        assert sum(r["length"] for r in members) <= 2048
    # Most sequences lie inside one range of places; later rounds join neighbours.
    inside = sum(members[-1]["position"] // 64 == members[0]["position"] // 64 for members in by_sequence.values())
    assert 2 * inside > len(by_sequence)
    assert len(by_sequence) <= -(-sum(r["length"] for r in out) // 2048) + 6
    files = {r["doc_id"]: r["position"] for r in out if r["piece"] == 0}
    assert files and P.stored_order(spark.range(1)) is None


def test_pack(spark, exact):
    texts = [*ODD, None, "word " * 5000, "x y z", "x y z"]
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    out = P.pack(df, group_pieces=8).collect()
    ids = {i: [*exact(t or ""), 0] for i, t, _ in rows}
    pieces = {}
    for r in out:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and len(own) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, all_ in ids.items():
        want = [(k, *c) for k, c in enumerate(P.cut(len(all_)))] * (2 if i == 5 else 1)
        assert sorted(pieces[i]) == sorted(want)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = P.sequences(df, group_pieces=8).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in out)
    assert {r["sequence_id"]: len(r["ids"]) for r in whole} == {s: sum(n for _, n in p) for s, p in by_sequence.items()}
    assert P.pack(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        P.pack(df.selectExpr("doc_id + 0.5D doc_id", "text"))


def test_pack_string_ids(spark, exact):
    df = spark.createDataFrame([("a", "x y"), (None, "z"), ("a", "x y")], "doc_id string, text string")
    out = sorted(((r["doc_id"], r["length"]) for r in P.pack(df).collect()), key=str)
    assert out == [("a", len(exact("x y")) + 1)] * 2 + [(None, len(exact("z")) + 1)]


# -- counts
PARTS = ["a", "b's", " ", "  ", "\n", "don't", "12", "3", "...", "é", " x", "'", "s", "ll", " \n "]


@pytest.mark.parametrize("seed", range(4))
def test_edits_keep_the_tree_right(seed):
    rng, ids = random.Random(seed), ids_for(*PATHS)
    counts = C.Counts(ids)
    for _ in range(60):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 400)))
        tree = C.TokenTree(text, counts)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 200]))
            new = "".join(rng.choices(PARTS, k=rng.choice([0, 1, 3, 150])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.tokens == len(ids(text)) and tree.chars == len(text)


def test_small_edits_touch_little():
    tree = C.TokenTree("word and more " * 3000, C.Counts(ids_for(*PATHS)))
    before = tree.encoded
    tree.edit(20_000, 20_003, "xyz")
    assert tree.encoded - before <= 4 * C.LEAF
    with pytest.raises(ValueError):
        tree.edit(0, 10**9, "")


def test_edits_close_together_are_made_together():
    ids = ids_for(*PATHS)
    counts = C.Counts(ids)
    # Repeated lines all over a text: each pre-token that stays is encoded once for the tree and at most about once for the edits.
    text = "\n".join(["the same line again"] * 20_000)
    before, after, pieces, again = C.counted(text, C.without_repeated_lines(text), ids, counts)
    assert (before, after) == (len(ids(text)), len(ids("the same line again"))) and again <= 4 * C.LEAF
    mixed = "\n".join(f"line {i % 700} of many" for i in range(6000))
    _, after, pieces, again = C.counted(mixed, C.without_repeated_lines(mixed), ids, counts)
    assert after == len(ids("\n".join(f"line {i} of many" for i in range(700)))) and again < pieces
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 300)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 6))), reverse=True)
        edits = [(a, b, rng.choice(["", "x", " yy "])) for b, a in zip(cuts[::2], cuts[1::2])]
        assert C._applied(text, C.together(text, edits, 20)) == C._applied(text, edits)
        assert C.counted(text, edits, ids, counts)[1] == len(ids(C._applied(text, edits)))
    assert C.together("abcdef", [(0, 1, "x"), (4, 5, "y")]) == [(0, 1, "x"), (4, 5, "y")]  # forward edits stay as they are


def test_stored_trees_are_edited(spark, tmp_path, exact):
    from pyspark.sql import functions as F

    texts = [*ODD, None, "word and more " * 4000, "same", "same"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    C.token_trees(df).write.parquet(str(tmp_path / "trees"))
    trees = spark.read.parquet(str(tmp_path / "trees"))
    assert {r["doc_id"]: r["n_tokens"] for r in trees.collect()} == {i: len(exact(t or "")) for i, t in enumerate(texts)}
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("new ").alias("new")))
    out = {r["doc_id"]: r for r in C.edited_trees(trees, edits).collect()}
    for i, t in enumerate(texts):
        assert out[i]["n_tokens"] == len(exact("new " + (t or ""))) and "".join(leaf["text"] for leaf in out[i]["leaves"]) == "new " + (t or "")
    long = out[len(ODD) + 1]
    assert long["n_encoded_again"] <= 3 * C.LEAF
    assert C.edited_trees(trees.limit(0), edits).count() == 0


def test_token_counts(spark, exact):
    from pyspark.sql import functions as F

    texts = [*ODD, None, "a b\nc\na b\n\na b", "same\nsame", "x" * 50_000]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    out = {r["doc_id"]: r for r in C.token_counts(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        lines, seen, kept = t.split("\n"), set(), []
        for line in lines:
            if not line.strip() or line not in seen:
                kept.append(line)
            seen.add(line)
        r = out[i if i else None]
        assert r["n_tokens"] == len(exact(t))
        assert r["n_tokens_after"] == len(exact("\n".join(kept))) and r["n_edits"] == len(lines) - len(kept)
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("new ").alias("new")))
    out = {r["doc_id"]: r for r in C.token_counts(df, edits=edits).collect()}
    assert all(out[i if i else None]["n_tokens_after"] == len(exact("new " + (t or ""))) for i, t in enumerate(texts))
    assert C.token_counts(df.limit(0)).count() == 0
