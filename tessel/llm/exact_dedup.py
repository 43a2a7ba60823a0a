"""Exact dedup by Patricia-trie owners.

Full byte strings go into compressed radix tries; a terminal node owns all
copies of its string and keeps their smallest and largest identifiers.

1. Every input split feeds its own trie (a combiner). Copies inside a split
   meet there, so a text that holds a third of all rows leaves each split once.
   When a trie passes its byte budget, it spills its largest subtrees until half
   of the budget is free; the other subtrees go on to meet copies.
   The outcome is stored once, which fixes which terminal owns which row.
2. Terminals are dealt out by (length, content hash). Each partition inserts
   them into a trie again, in the order of their bytes, so that every subtree
   left of the path to the latest string is complete. When the trie passes its
   budget, these subtrees spill, and no text's copies are split.
3. Rows join their owner by the key of their split's terminal. A key occurs at
   most as often as one split has rows, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, stored, text_of

#: Bytes of key text a trie may hold before its subtrees are closed.
TRIE_BYTES = 48 << 20


class Terminal:
    """All copies of one string: count, smallest and largest identifier, and the rows themselves."""

    __slots__ = ("count", "held", "largest", "members", "owner", "smallest")

    def __init__(self) -> None:
        self.count, self.smallest, self.largest, self.owner = 0, None, None, None
        self.members: list = []
        self.held = 0  # bytes of the members

    def add(self, member, smallest, largest, count: int, keep_largest: bool) -> None:
        best = largest if keep_largest else smallest
        mine = self.largest if keep_largest else self.smallest
        if self.owner is None or (best is not None and (mine is None or (best > mine if keep_largest else best < mine))):
            self.owner = member
        if smallest is not None:
            self.smallest = smallest if self.smallest is None else min(self.smallest, smallest)
        if largest is not None:
            self.largest = largest if self.largest is None else max(self.largest, largest)
        self.count += count
        self.members.append(member)


#: Bytes charged for a node with its terminal, and for a member's tuple, beside the strings in them.
NODE_BYTES, MEMBER_BYTES = 400, 300


class PatriciaTrie:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def terminal(self, key: bytes) -> Terminal:
        """The terminal node of key, made if missing."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                self.bytes += end - at + NODE_BYTES
                node[1][key[at]] = leaf = [key[at:], {}, Terminal()]
                return leaf[2]
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_length(label, key, at)
            fork = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][key[at]] = fork
            self.bytes += NODE_BYTES
            node, at = fork, at + shared
        if node[2] is None:
            node[2] = Terminal()
        return node[2]

    def hold(self, terminal: Terminal, size: int) -> None:
        """Charge so many bytes of a member to its terminal and to the trie."""
        terminal.held += size
        self.bytes += size

    def taken(self, top: list) -> Iterator[Terminal]:
        """The terminals of a subtree that no longer hangs on the trie; its bytes are given back."""
        stack = [top]
        while stack:
            label, children, terminal = stack.pop()
            self.bytes -= len(label) + NODE_BYTES
            if terminal is not None:
                self.bytes -= terminal.held
                yield terminal
            stack.extend(children.values())

    def close(self) -> Iterator[Terminal]:
        """Everything."""
        top, self.root = self.root, [b"", {}, None]
        yield from self.taken(top)
        self.bytes = 0

    def spill(self, goal: int) -> Iterator[Terminal]:
        """Take out subtrees below the first fork, the largest first, until at most goal bytes are left."""
        node = self.root
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
        for byte in sorted(node[1], key=lambda b: -_size(node[1][b])):
            if self.bytes <= goal:
                return
            yield from self.taken(node[1].pop(byte))
        if self.bytes > goal:
            yield from self.close()

    def spill_before(self, key: bytes) -> Iterator[Terminal]:
        """Take out all that lies beside or above the path to key: complete, if strings come in order and key is next."""
        node, at = self.root, 0
        while True:
            if node[2] is not None and at < len(key):
                terminal, node[2] = node[2], None
                self.bytes -= terminal.held
                yield terminal
            on = node[1].pop(key[at], None) if at < len(key) else None
            if on is not None and not key.startswith(on[0], at):
                yield from self.taken(on)
                on = None
            for child in list(node[1].values()):
                yield from self.taken(child)
            node[1].clear()
            if on is None:
                return
            node[1][key[at]] = on
            node, at = on, at + len(on[0])


def _size(top: list) -> int:
    """Bytes of a subtree."""
    total, stack = 0, [top]
    while stack:
        label, children, terminal = stack.pop()
        total += len(label) + NODE_BYTES + (terminal.held if terminal is not None else 0)
        stack.extend(children.values())
    return total


def common_length(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of label and key[at:], by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _kind(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


def _combine(id_kind: str, keep_largest: bool, trie_bytes: int, rest: pa.DataType | None) -> Callable:
    """For each split: rows with the key of their terminal; the owner's row carries text, ids and count.

    With rest (the type of the other columns), only the owners' rows go on.
    """
    kind = _kind(id_kind)
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), kind, kind, pa.int64(), *([rest] if rest else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        trie, made = PatriciaTrie(), 0

        def emit(terminals: Iterator[Terminal]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            out: list = []
            size = 0
            for terminal in terminals:
                key, made = base + made, made + 1
                text = terminal.members[0][3]
                for row in terminal.members:
                    best = row is terminal.owner
                    if best:
                        out.append((*row[:3], key, True, text, terminal.smallest, terminal.largest, terminal.count, *row[4:]))
                        size += len(text)
                    elif rest is None:
                        out.append((*row[:3], key, False, None, None, None, None))
                if size > 8 << 20 or len(out) > 5000:
                    yield _batch(out, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, kinds)

        for batch in batches:
            # Values outside the text weigh what their columns do on average, fourfold as Python objects.
            beside = MEMBER_BYTES + 4 * sum(c.nbytes for i, c in enumerate(batch.columns) if i != 3) // max(1, len(batch))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found = trie.terminal(row[3])
                trie.hold(found, beside + (0 if found.count else len(row[3])))
                if found.count:
                    row = (*row[:3], b"", *row[4:])
                found.add(row, row[0], row[0], 1, keep_largest)
                if trie.bytes > trie_bytes:
                    yield from emit(trie.spill(trie_bytes // 2))
        yield from emit(trie.close())

    return run


def _batch(rows: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[str(i) for i in range(len(kinds))])


def _resolve(id_kind: str, keep_largest: bool, trie_bytes: int, rest: pa.DataType | None) -> Callable:
    """For each partition of terminals: the owner of each one's text, or with rest the owning rows alone."""
    kind = _kind(id_kind)
    kinds = [kind, pa.binary(), rest] if rest else [pa.int64(), kind, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(), None

        def emit(terminals: Iterator[Terminal]) -> Iterator[pa.RecordBatch]:
            out: list = []
            size = 0
            for t in terminals:
                if rest:
                    text = t.members[0][1]
                    out.append((t.largest if keep_largest else t.smallest, text, t.owner[2]))
                    size += len(text)
                else:
                    keep = t.largest if keep_largest else t.smallest
                    out.extend((m[0], keep, t.owner[0], t.count) for m in t.members)
                if len(out) > 20_000 or size > 8 << 20:
                    yield _batch(out, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, kinds)

        for batch in batches:
            beside = MEMBER_BYTES + 4 * sum(c.nbytes for i, c in enumerate(batch.columns) if i != 1) // max(1, len(batch))
            for key, text, smallest, largest, count, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if trie.bytes > trie_bytes and text != last:
                    yield from emit(trie.spill_before(text))
                last = text
                found = trie.terminal(text)
                trie.hold(found, beside + (0 if found.count else len(text)))
                found.add((key, b"" if found.count else text, *more), smallest, largest, count, keep_largest)
        yield from emit(trie.close())

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, normalize, kind: str, rest: Column | None = None) -> DataFrame:
    text = (normalize or (lambda c: c))(text_of(F.col(f"`{text_col}`")))
    more = [] if rest is None else [rest.alias("_rest")]
    rows = docs.select(F.col(f"`{id_col}`").cast(kind).alias("_id"), text.alias("_t"), *more)
    return rows.select("_id", F.octet_length("_t").cast("long").alias("_length"), F.sha2("_t", 256).alias("_digest"), F.col("_t").cast("binary").alias("_bytes"), *(["_rest"] if more else []))


def _combined_schema(kind: str) -> str:
    return f"_id {kind}, _length bigint, _digest string, _key bigint, _best boolean, _text binary, _smallest {kind}, _largest {kind}, _count bigint"


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalize: Callable[[Column], Column] | None = None, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    normalize maps the text column before comparing (default: no change). keep
    names which identifier of a group of equal texts owns it. Of repeated rows
    with the owner's identifier exactly one is kept.

    Defined cases: a null text counts as the empty text; rows with a null id
    form groups like others, and own one only if no row of it has an id (keep_id
    is then null); identifiers other than strings and integers raise a
    TypeError; an empty table gives an empty result; other columns of docs are
    ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    kind, largest = id_type(docs, id_col), keep == "largest"
    rows = _rows(docs, id_col, text_col, normalize, kind)
    local = stored(rows.mapInArrow(_combine(kind, largest, trie_bytes, None), _combined_schema(kind)), "exact")
    terminals = local.where("_best").select("_length", "_digest", "_key", "_text", "_smallest", "_largest", "_count")
    owners = _dealt(terminals).mapInArrow(_resolve(kind, largest, trie_bytes, None), f"_key bigint, _keep {kind}, _winner bigint, _size bigint")
    kept = F.col("_best") & (F.col("_winner") == F.col("_key"))
    return local.select("_id", "_digest", "_key", "_best").join(owners, "_key").select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), F.col("_digest").alias("text_sha256"))


def _dealt(terminals: DataFrame) -> DataFrame:
    """Terminals by (length, content hash), in the order of their bytes."""
    return terminals.repartition("_length", "_digest").sortWithinPartitions("_text", "_key").drop("_length", "_digest")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of docs that own their text, with all their columns.

    Cases as in exact_dedup; a null text comes back as the empty text. Texts
    move once: the owner's other columns travel with the terminal.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, largest = id_type(docs, id_col), keep == "largest"
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    payload = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(True).alias("held"))
    rows = _rows(docs, id_col, text_col, None, kind, payload)
    arrow = to_arrow_type(rows.schema["_rest"].dataType)
    ddl = rows.schema["_rest"].dataType.simpleString()
    local = rows.mapInArrow(_combine(kind, largest, trie_bytes, arrow), f"{_combined_schema(kind)}, _rest {ddl}")
    terminals = local.select("_length", "_digest", "_key", "_text", "_smallest", "_largest", "_count", "_rest")
    owners = _dealt(terminals).mapInArrow(_resolve(kind, largest, trie_bytes, arrow), f"_id {kind}, _text binary, _rest {ddl}")
    back = {id_col: F.col("_id").cast(docs.schema[id_col].dataType), text_col: F.col("_text").cast("string")} | {c: F.col(f"_rest.c{i}") for i, c in enumerate(others)}
    return owners.select(*[back[c].alias(c) for c in docs.columns])
