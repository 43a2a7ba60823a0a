"""Best-two-fit packing of documents into sequences of a fixed token budget.

Documents become token ids plus one end id; only longer ones are cut, so that
all pieces but the first are full. Pieces are dealt at random into groups of a
bounded number, and each group is packed on its own: a bin is filled greedily
with the longest piece that fits; if a gap is left, the bin's smallest piece is
exchanged for the two unpacked pieces that fill the widened gap most tightly.
Pieces of the emptiest bins of all groups are then dealt and packed together
again, in at most half as many groups, until there is one group.

With an order (training_order), groups are ranges of the documents' places in it
instead, neighbouring ranges meet in the later rounds, equal pieces (passes of a
document) go to different sequences, and pieces carry their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, stored, text_of
from .tokens import ids_for, vocabulary

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 16_384


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one with the remainder."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


class Unpacked:
    """Pieces by length, with the lengths that are left in order.

    owners, if given, names what each piece is a copy of; pieces of an owner in
    banned are passed over.
    """

    def __init__(self, lengths: list[int], owners: Sequence | None = None) -> None:
        self.owners, self.banned = owners, set()
        self.by_length: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            self.by_length.setdefault(n, []).append(i)
        self.lengths = sorted(self.by_length)

    def place(self, length: int, apart_from: object = None) -> int:
        """Where the last piece of that length stands that is not passed over, or -1."""
        found = self.by_length[length]
        if self.owners is None:
            return len(found) - 1
        for k in range(len(found) - 1, -1, -1):
            owner = self.owners[found[k]]
            if owner not in self.banned and (apart_from is None or owner != apart_from):
                return k
        return -1

    def largest(self, room: int) -> int:
        """The largest length left that fits, or 0."""
        k = bisect_right(self.lengths, room)
        while k and self.place(self.lengths[k - 1]) < 0:
            k -= 1
        return self.lengths[k - 1] if k else 0

    def take(self, length: int) -> int:
        found = self.by_length[length]
        item = found.pop(self.place(length))
        if self.owners is not None:
            self.banned.add(self.owners[item])
        if not found:
            del self.lengths[bisect_right(self.lengths, length) - 1]
        return item

    def give(self, length: int, item: int) -> None:
        found = self.by_length[length]
        if not found:
            self.lengths.insert(bisect_right(self.lengths, length), length)
        found.append(item)
        if self.owners is not None:
            self.banned.discard(self.owners[item])

    def both(self, a: int, b: int) -> bool:
        """Whether pieces of both lengths can be taken together."""
        if self.owners is None:
            return a != b or len(self.by_length[a]) > 1
        first = self.place(a)
        if first < 0:
            return False
        item = self.by_length[a][first]
        return self.place(b, self.owners[item]) >= 0

    def best_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Lengths of two pieces left whose sum is the largest up to room, if above more_than."""
        lengths, low, high, best, pair = self.lengths, 0, bisect_right(self.lengths, room) - 1, more_than, None
        while low <= high:
            a, b = lengths[low], lengths[high]
            if a + b > room or (low == high and not self.both(a, b)):
                high -= 1
                continue
            if a + b > best and self.both(a, b):
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return pair


def best_two_fit(lengths: list[int], capacity: int = CAPACITY, owners: Sequence | None = None) -> list[list[int]]:
    """Bins of indexes into lengths. Every length is from 1 to capacity. Pieces of one owner go to different bins."""
    left, bins = Unpacked(lengths, owners), []
    while left.lengths:
        members: list[tuple[int, int]] = []
        room = capacity
        left.banned.clear()
        while n := left.largest(room):
            members.append((n, left.take(n)))
            room -= n
        if room and len(members) > 1 and left.lengths:
            smallest, item = members[-1]
            if pair := left.best_two(room + smallest, smallest):
                members[-1:] = [(n, left.take(n)) for n in pair]
                left.give(smallest, item)
        bins.append([i for _, i in members])
    return bins


def _pieces(json_path: str, ranks_path: str | None, pattern: str | None, capacity: int, end_id: int, with_ids: bool) -> Callable:
    """(id, text, columns to carry) in; a row per piece out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(json_path, ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = batch.slice(at, 512)
                out: list[tuple] = []
                parts: list[np.ndarray] = []
                for row, text in enumerate(own.column(1)):
                    tokens = np.append(ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                    for k, (start, n) in enumerate(cut(len(tokens), capacity)):
                        part = tokens[start : start + n]
                        out.append((row, k, start, n, zlib.crc32(part)))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                row, *numbers = zip(*out)
                rows = pa.array(row)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = {"_id": own.column(0).take(rows)}
                columns |= {c: pa.array(v, k) for c, v, k in zip(("piece", "start", "length", "ids_crc32"), numbers, kinds)}
                if with_ids:
                    columns["ids"] = pa.array(parts, pa.list_(pa.int32()))
                columns |= {name: own.column(name).take(rows) for name in own.schema.names[2:]}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False, carry: Sequence[Column] = ()) -> DataFrame:
    """Pieces of all documents: _id, piece, start, length, ids_crc32, ids if asked for, and the columns to carry.

    tokenizer and ranks are paths of vocabulary files that exist on every machine.
    """
    import public_tokenizers

    if tokenizer is None:
        tokenizer, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").cast(kind).alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"), *carry)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    run = _pieces(tokenizer, ranks, public_tokenizers.PATTERN if ranks else None, capacity, end_id, with_ids)
    return rows.mapInArrow(run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "") + more)


def stored_order(docs: DataFrame) -> list[Column] | None:
    """Columns that tell where a row stands in the files that docs is read from, or None where it isn't read from such.

    A range-sorted table is written in file after file, so this gives its order back.
    """
    try:
        places = docs.metadataColumn("_metadata")
        docs.select(places["file_name"], places["row_index"]).schema  # noqa: B018 - resolves the names
    except AnalysisException:
        return None
    return [places["file_name"], places["row_index"]]


def _placed(left: DataFrame) -> DataFrame:
    """Pieces with _pos, their number in the order of (_file, _at, piece), counted from 0.

    Numbers are counts per file, of which there is a row each, and places inside a file.
    """
    counts = left.groupBy("_file").agg(F.count("*").alias("_pieces"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_pieces").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file").orderBy("_at", "piece", "_id", "ids_crc32")
    return left.withColumn("_own", F.row_number().over(inside) - 1).join(offsets, "_file").withColumn("_pos", F.col("_before") + F.col("_own"))


def _pack_group(capacity: int, first: int, again: int, ordered: bool) -> Callable:
    """Groups are numbered from first on; bins with a gap are open, emptiest first and up to so many pieces again."""

    def run(table: pa.Table) -> pa.Table:
        # Whatever order the rows arrive in, a group is packed alike.
        keys = [*(["_pos"] if ordered else []), "_id", "start", "ids_crc32", "length"]
        table = table.sort_by([(k, "ascending") for k in keys])
        lengths = table.column("length").to_pylist()
        owners = list(zip(*(table.column(c).to_pylist() for c in ("_id", "start", "ids_crc32", "length")))) if ordered else None
        sequence, offset, open_ = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        base = (first + table.column("_group")[0].as_py()) << 32
        gaps = []
        for number, members in enumerate(best_two_fit(lengths, capacity, owners)):
            at = 0
            for i in sorted(members) if ordered else members:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
            if at < capacity:
                gaps.append((at, number, members))
        left = again
        for _, _, members in sorted(gaps):
            left -= len(members)
            if left < 0:
                break
            open_[members] = True
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_open", open_)):
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, order: Sequence[Column] | None = None, **options) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset.

    order names a file (or any other range of the order, small enough for one
    task, with ranges in the order of their names) and a place inside it. Then a
    column position is the piece's number in that order, groups are ranges of
    it, a sequence holds its pieces in order, and of equal pieces each goes to a
    sequence of its own. Without it, groups are random.

    Defined cases: a null or empty text is one piece that holds only the end id;
    a null id is kept as null; identifiers other than strings and integers raise
    a TypeError; repeated rows are packed once each; an empty table gives an
    empty result; other columns are ignored.
    """
    ordered = order is not None
    carry = [order[0].cast("string").alias("_file"), order[1].cast("bigint").alias("_at")] if ordered else []
    left = stored(pieces(docs, id_col=id_col, capacity=capacity, carry=carry, **options), "pack-pieces")
    keys = ["_id", "piece", "start", "length", "ids_crc32"]
    groups, first, bins, done = max(1, -(-left.count() // group_pieces)), 0, None, []
    if ordered:
        keys.append("_pos")
        left = _placed(left).withColumn("_group", F.expr(f"_pos div {group_pieces}")).select(*keys, "_group")
    columns = ", ".join(f"{k} {dict(left.dtypes)[k]}" for k in keys) + ", _group bigint, sequence_id bigint, offset bigint"
    opened = F.when(F.col("_open"), F.col("sequence_id"))
    counts = [F.countDistinct("sequence_id").alias("bins"), F.countDistinct(opened).alias("open_bins"), F.count(opened).alias("pieces")]

    def result(found: DataFrame) -> DataFrame:
        out = found.drop("_open", "_group").withColumnRenamed("_id", id_col)
        return out.withColumnRenamed("_pos", "position") if ordered else out

    while True:
        if ordered:
            # A group opens at most half a group of pieces, so that two neighbours fit in one of the next round.
            grouped = left.select(*keys, F.expr("_group div 2").alias("_group")) if first else left
        else:
            # The crc spreads copies of one row's id; equal pieces may share a group, which only bounds its balance.
            grouped = left.select(*keys).withColumn("_group", F.pmod(F.xxhash64(*keys, *([F.lit(first)] if first else [])), F.lit(groups)))
        run = _pack_group(capacity, first, group_pieces // 2 if groups > 1 else 0, ordered)
        placed = grouped.groupBy("_group").applyInArrow(run, f"{columns}, _open boolean")
        if not first and groups == 1:
            return result(placed)
        placed = stored(placed, "pack-placed")
        found = placed.agg(*counts).first()
        if bins is not None and found["bins"] >= bins:  # nothing won: the bins of before stay
            done.append(left)
            break
        done.append(placed.where("NOT _open"))
        if not found["pieces"]:
            break
        left, bins = placed.where("_open"), found["open_bins"]
        first, groups = first + groups, -(-groups // 2) if ordered else -(-found["pieces"] // group_pieces)
    return result(reduce(DataFrame.unionByName, done))


def sequences(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the ids' documents in order.

    A sequence is bounded by the capacity, so collecting one is safe. Pieces meet
    their place by everything that identifies them; of equal ones any may stand
    in any of their places.
    """
    keys = ["_id", "piece", "start", "length", "ids_crc32"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    tokens = pieces(docs, id_col=id_col, with_ids=True, **{k: v for k, v in options.items() if k not in ("group_pieces", "order")}).withColumn("_copy", number)
    places = pack(docs, id_col=id_col, **options).withColumnRenamed(id_col, "_id").withColumn("_copy", number)
    same = [tokens[k].eqNullSafe(places[k]) for k in (*keys, "_copy")]
    joined = tokens.join(places, same).select(places["sequence_id"], places["offset"], tokens["_id"], tokens["ids"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "_id", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"), F.transform("_parts", lambda p: p["_id"]).alias("documents"))
