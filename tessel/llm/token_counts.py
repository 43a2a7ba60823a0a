"""Edit-aware token counts: segment trees over pre-tokens.

A document's pre-tokens (the pieces within which byte-pair merges happen) are
the leaves' content; a leaf holds up to LEAF of them with its character and
token sums, and inner nodes add up their children. An edit re-splits and
re-encodes only the leaves that it touches, one pre-token of context before it,
and what follows until the old borders are met again; sums change along the
paths to the root. Edits close to each other are made together, so that a leaf
is encoded once for all of them. Counts before and after come out of the same
tree. token_trees keeps the trees as a table, which edited_trees goes on from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import Ids, ids_for, vocabulary

LEAF = 64
CACHE_PIECES = 200_000
#: Characters between edits below which they are made together: about what a leaf holds.
REACH = 256
#: Fixed value: the byte-level BPE's pre-token pattern in terms of the standard re module, for texts of stable characters.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Counts(dict):
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, ids: Ids) -> None:
        super().__init__()
        self.ids = ids

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n = len(self.ids(piece))
        return n


@dataclass
class Leaf:
    """A run of pre-tokens as its text, with their token sum. Leaves begin and end between pre-tokens, so the text alone splits alike."""

    text: str
    tokens: int

    @property
    def chars(self) -> int:
        return len(self.text)

    @property
    def pieces(self) -> list[str]:
        return PIECE.findall(self.text)


class TokenTree:
    """The segment tree of one text, or of leaves made before. encoded counts the pre-tokens that were ever looked up."""

    def __init__(self, text: str, counts: Counts, leaves: list[Leaf] | None = None) -> None:
        self.counts, self.encoded = counts, 0
        self.levels: list[list] = [leaves or self._leaves(PIECE.findall(text)) or [Leaf("", 0)]]
        self._sum_up()

    def _leaves(self, pieces: list[str]) -> list[Leaf]:
        self.encoded += len(pieces)
        parts = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return [Leaf("".join(p), sum(map(self.counts.__getitem__, p))) for p in parts]

    def _sum_up(self, changed_from: int = 0) -> None:
        """Add up the inner levels from the pair that holds leaf changed_from on (all of them after a split or merge of leaves)."""
        below = [(leaf.chars, leaf.tokens) for leaf in self.levels[0]] if changed_from == 0 or len(self.levels) < 2 else None
        if below is None:
            first = changed_from // 2 * 2
            tail = [(leaf.chars, leaf.tokens) for leaf in self.levels[0][first:]]
            depth = 1
            while True:
                sums = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(tail[::2], [*tail[1::2], (0, 0)][: (len(tail) + 1) // 2])]
                level = self.levels[depth] if depth < len(self.levels) else []
                level[first // 2 :] = sums
                if depth == len(self.levels):
                    self.levels.append(level)
                if len(level) == 1:
                    del self.levels[depth + 1 :]
                    return
                first = first // 2 // 2 * 2
                tail = level[first:]
                depth += 1
        self.levels = self.levels[:1]
        while len(below) > 1 or len(self.levels) < 2:
            below = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(below[::2], [*below[1::2], (0, 0)][: (len(below) + 1) // 2])]
            self.levels.append(below)

    def _set(self, at: int, leaf: Leaf) -> None:
        """Replace one leaf and repair the sums on its path."""
        self.levels[0][at] = leaf
        for depth in range(1, len(self.levels)):
            below = self.levels[depth - 1]
            at //= 2
            pair = [(x.chars, x.tokens) if depth == 1 else x for x in below[2 * at : 2 * at + 2]]
            self.levels[depth][at] = (sum(p[0] for p in pair), sum(p[1] for p in pair))

    @property
    def chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place, and the place where it starts."""
        at, start = 0, 0
        for depth in range(len(self.levels) - 1, 0, -1):
            below = self.levels[depth - 1]
            left = below[2 * at].chars if depth == 1 else below[2 * at][0]
            at *= 2
            if place >= start + left and at + 1 < len(below):
                start += left
                at += 1
        return at, start

    def text(self) -> str:
        return "".join(leaf.text for leaf in self.levels[0])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start..end by new."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"edit {start}..{end} is outside a text of {self.chars} characters")
        leaves = self.levels[0]
        first, first_at = self._find(start)
        if first and start - first_at <= len(next(iter(leaves[first].pieces), "")):
            first -= 1  # the pre-token before may join or lose characters
            first_at -= leaves[first].chars
        while first and not leaves[first].text:
            first -= 1
            first_at -= leaves[first].chars
        last, last_at = self._find(max(end - 1, start))
        last_end = last_at + leaves[last].chars
        region = "".join(leaf.text for leaf in leaves[first : last + 1])
        region = region[: start - first_at] + new + region[end - first_at :]
        changed = start - first_at + len(new)
        # Context: what follows may split otherwise; go on leaf by leaf until an old border is a new one as well.
        while True:
            ahead = last + 1
            context = ""
            while ahead < len(leaves) and not context:
                context = leaves[ahead].text
                ahead += 1
            pieces, at = [], 0
            for found in PIECE.finditer(region + context):
                if at >= len(region):
                    break
                pieces.append(found.group())
                at = found.end()
            if not context or (at == len(region) and len(region) >= changed):
                break
            region += context
            last = ahead - 1
            last_end += len(context)
        made = self._leaves(pieces)
        if len(made) == last - first + 1 and len(made) == 1:
            self._set(first, made[0])
        else:
            leaves[first : last + 1] = made or ([] if len(leaves) > last - first + 1 else [Leaf("", 0)])
            self._sum_up(max(0, first - 1))


def without_repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, new) that take out lines with a word that occurred before, last edit first."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            if line in seen:
                edits.append((max(0, at - 1), end, ""))
            seen.add(line)
        at = end + 1
    return edits[::-1]


def together(text: str, edits: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Edits that go backwards through the text without touching each other, with those less than reach apart made one.

    Edits in any other order stay as they are: each is about the text that the
    ones before it left.
    """
    if any(later[1] > earlier[0] or later[0] > later[1] for earlier, later in zip(edits, edits[1:])) or any(not 0 <= a <= b <= len(text) for a, b, _ in edits):
        return edits
    out: list[tuple[int, int, str]] = []
    parts: list[str] = []  # of the edit that grows to the left, last part first
    for start, end, new in edits:
        if out and out[-1][0] - end < reach:
            parts += [text[end : out[-1][0]], new]
            out[-1] = (start, out[-1][1], "")
        else:
            if out:
                out[-1] = (*out[-1][:2], "".join(reversed(parts)))
            parts = [new]
            out.append((start, end, ""))
    if out:
        out[-1] = (*out[-1][:2], "".join(reversed(parts)))
    return out


def counted(text: str, edits: list[tuple[int, int, str]], ids: Ids, counts: Counts) -> tuple[int, int, int, int]:
    """Tokens before and after the edits, pre-tokens of the text, and pre-tokens encoded again for the edits."""
    if not _plain(text, edits, ids):
        return len(ids(text)), len(ids(_applied(text, edits))) if edits else len(ids(text)), 0, 0
    tree = TokenTree(text, counts)
    before, pieces = tree.tokens, tree.encoded
    for start, end, new in together(text, edits):
        tree.edit(start, end, new)
    return before, tree.tokens, pieces, tree.encoded - pieces


def _plain(text: str, edits: list[tuple[int, int, str]], ids: Ids) -> bool:
    return ids.is_plain(text) and all(ids.is_plain(new) for *_, new in edits)


def _applied(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, new in edits:
        text = text[:start] + new + text[end:]
    return text


def _run(json_path: str, ranks_path: str | None, pattern: str | None, has_edits: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(json_path, ranks_path, pattern)
        counts = Counts(ids)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                given = part.column("_edits").to_pylist() if has_edits else [None] * len(part)
                rows = []
                for text, edits in zip(part.column("_text").to_pylist(), given):
                    edits = [(e["start"], e["end"], e["new"] or "") for e in edits or []] if has_edits else without_repeated_lines(text)
                    before, after, pieces, again = counted(text, edits, ids, counts)
                    rows.append((before, after, len(edits), pieces, again))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], names=["_id", "n_tokens", "n_tokens_after", "n_edits", "n_pieces", "n_encoded_again"])

    return run


_TREE = "array<struct<text string, tokens bigint>>"


def _grow(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable:
    """(id, text) in, (id, leaves, n_tokens) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(json_path, ranks_path, pattern)
        counts = Counts(ids)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                trees = []
                for text in part.column("_text").to_pylist():
                    leaves = TokenTree(text, counts).levels[0] if ids.is_plain(text) else [Leaf(text, len(ids(text)))]
                    trees.append([{"text": leaf.text, "tokens": leaf.tokens} for leaf in leaves])
                yield _tree_batch(part.column("_id"), trees)

    return run


def _regrow(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable:
    """(id, leaves, edits) in, (id, leaves, n_tokens, n_encoded_again) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(json_path, ranks_path, pattern)
        counts = Counts(ids)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                trees, again = [], []
                for leaves, edits in zip(part.column("_leaves").to_pylist(), part.column("_edits").to_pylist()):
                    edits = [(e["start"], e["end"], e["new"] or "") for e in edits or []]
                    held = [Leaf(leaf["text"], leaf["tokens"]) for leaf in leaves or []]
                    text = "".join(leaf.text for leaf in held)
                    if _plain(text, edits, ids):
                        tree = TokenTree("", counts, held)
                        for start, end, new in together(text, edits):
                            tree.edit(start, end, new)
                        held = tree.levels[0]
                        again.append(tree.encoded)
                    else:
                        after = _applied(text, edits)
                        held = [Leaf(after, len(ids(after)))] if edits else held
                        again.append(0)
                    trees.append([{"text": leaf.text, "tokens": leaf.tokens} for leaf in held])
                yield _tree_batch(part.column("_id"), trees, again)

    return run


def _tree_batch(id_: pa.Array, trees: list, again: list | None = None) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())]))
    columns = [id_, pa.array(trees, kind), pa.array([sum(leaf["tokens"] for leaf in t) for t in trees], pa.int64())]
    if again is not None:
        columns.append(pa.array(again, pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=["_id", "leaves", "n_tokens", "n_encoded_again"][: len(columns)])


def _files(tokenizer: str | None, ranks: str | None) -> tuple[str, str | None, str | None]:
    """Paths of the vocabulary, by default the public one, and its pre-token pattern."""
    import public_tokenizers

    if tokenizer is None:
        tokenizer, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    return tokenizer, ranks, public_tokenizers.PATTERN if ranks else None


def token_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document: the id, leaves (text and tokens of each leaf) and n_tokens, to be written and edited later.

    Cases as in token_counts. A text whose pre-tokens depend on a Unicode version is one leaf.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    out = rows.mapInArrow(_grow(*_files(tokenizer, ranks)), f"_id {dict(rows.dtypes)['_id']}, leaves {_TREE}, n_tokens bigint")
    return out.withColumnRenamed("_id", id_col)


def edited_trees(trees: DataFrame, edits: Column, *, id_col: str = "doc_id", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Trees of token_trees after edits (array<struct<start, end, new>> over trees): the id, leaves, n_tokens, n_encoded_again.

    Only leaves that an edit touches are split and encoded. Null leaves are an
    empty text; the rest as in token_counts.
    """
    rows = trees.select(F.col(f"`{id_col}`").alias("_id"), F.col("leaves").alias("_leaves"), edits.alias("_edits"))
    out = rows.mapInArrow(_regrow(*_files(tokenizer, ranks)), f"_id {dict(rows.dtypes)['_id']}, leaves {_TREE}, n_tokens bigint, n_encoded_again bigint")
    return out.withColumnRenamed("_id", id_col)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document: the id, n_tokens, n_tokens_after, n_edits, n_pieces, n_encoded_again.

    edits is an array<struct<start, end, new>> column over docs, applied one after
    the other to the text as it then stands; without it, the edits take out
    repeated lines. Texts whose pre-tokens depend on a Unicode version are encoded
    whole (n_pieces is then 0).

    Defined cases: a null text counts as the empty text (0 tokens); null edits
    are none, a null replacement is the empty string; an edit outside its text is
    an error; null ids are kept; repeated rows are counted once each; an empty
    table gives an empty result; other columns are ignored.
    """
    more = [] if edits is None else [edits.alias("_edits")]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"), *more)
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(_run(*_files(tokenizer, ranks), edits is not None), f"_id {kind}, n_tokens bigint, n_tokens_after bigint, n_edits bigint, n_pieces bigint, n_encoded_again bigint")
    return out.withColumnRenamed("_id", id_col)
