"""MinHash near-dedup by HyperMinHash.

Each document's set of word shingles is hashed once. The top bits of a hash name
one of 256 buckets; a bucket stores of its smallest hash the number of leading
zeros and ten mantissa bits. Four registers make a band key; empty registers
borrow from the first filled bucket of a fixed permutation.

1. Documents with the same shingle set form a class; one row stands for it.
2. Classes that share a band key are candidates. Each class proposes one link:
   to the class, among those in its band buckets, that meets most others (the
   hub of a family of copies). Proposals are verified on full sets and joined to
   components. Work so far is linear in the rows, however large a bucket is.
3. Buckets whose members are still in different components hold the only links
   that could be missing. Their members are dealt out in blocks, where members
   of different components are compared by register, with the expected number
   of chance collisions taken off. Members that may reach the threshold with
   another meet once more with their full sets.

Verification of proposals streams: the first member's set travels to the second's
key, where hubs with many partners are split over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, is_small, matched, stored, text_of
from .components import components

WORDS = 5
THRESHOLD = 75  # percent
BUCKETS, MANTISSA, REST = 256, 10, 53
BANDS, ROWS = 32, 4
#: Standard errors below the threshold down to which an estimate still leads to verification.
SLACK = 4.5
BLOCK = 512
#: Partners of one hub that a task verifies before the hub's set is sent to another task as well.
HUB_PARTNERS = 1024
_WORD_CACHE = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _finish(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: bytes, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than a shingle make one."""
    parts = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.array([known[w] for w in parts], np.uint64)
    n = len(parts)
    width = min(words, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _MIX + hashes[i : n - width + 1 + i]
        h ^= h >> np.uint64(31)
    return np.unique(_finish(h))


_EDGES = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - 8))
_ORDER = np.argsort(np.random.default_rng(20240601).random((BANDS * ROWS, BUCKETS)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """256 uint16 registers: 1 + leading zeros and mantissa of the bucket's smallest hash, 0 where empty."""
    first = np.searchsorted(hashes, _EDGES)
    ends = np.append(first[1:], len(hashes))
    filled = first < ends
    smallest = (hashes[first[filled]] >> np.uint64(64 - 8 - REST)) & np.uint64((1 << REST) - 1)
    part, bits = np.frexp(smallest.astype(np.float64))
    mantissa = np.where(part > 0, part * (2 << MANTISSA) - (1 << MANTISSA), 0).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    out[filled] = ((REST - bits.astype(np.int64)) << MANTISSA | mantissa) + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of compressed registers (int64)."""
    filled = regs != 0
    at = np.arange(BANDS * ROWS)
    empty = ~filled[: BANDS * ROWS]
    if empty.any():
        order = _ORDER[empty]
        at[empty] = order[np.arange(len(order)), filled[order].argmax(axis=1)]
    values = (regs[at].astype(np.uint64) << np.uint64(8) | at.astype(np.uint64)).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for i in range(ROWS):
        h = _finish(h * _MIX + values[:, i])
    return h.view(np.int64)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that two disjoint sets of n and m elements have in common by chance.

    With loads a, b per bucket the smallest hashes have densities a e^-ax, b e^-bx;
    a cell of leading-zero count i has width 2^-(i+1+mantissa bits).
    """
    a, b = np.asarray(n, float) / BUCKETS, np.asarray(m, float) / BUCKETS
    total = np.zeros(np.broadcast(a, b).shape)
    for i in range(REST):
        total += 2.0 ** -(i + 1 + MANTISSA) * (np.exp(-(a + b) * 2.0 ** -(i + 1)) - np.exp(-(a + b) * 2.0**-i))
    return a * b / (a + b) * total


def estimates(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of one document against many, and the registers they rest on."""
    filled = (many != 0) | (one != 0)
    based_on = filled.sum(axis=1)
    matches = ((many == one) & filled).sum(axis=1)
    chance = chance_matches(n_one, n_many)
    return np.clip((matches / based_on - chance) / (1 - chance), 0, 1), based_on


def _packed(text: bytes) -> bytes:
    """A text as it is stored beside its sketch: its length and its bytes by zstd."""
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _sketches(words: int) -> Callable:
    """Rows (_id, _text, maybe _rest) with a number of their own, their set's size and digest, registers and bands; texts are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = WordHashes(), TaskContext.get().partitionId() << 36
        names = ["_row", "_n", "_digest", "_regs", "_bands"]
        for batch in batches:
            for start in range(0, len(batch), 512):
                own = batch.slice(start, 512)
                out: list[tuple] = []
                texts = []
                for value in own.column(1):
                    text = value.as_py()
                    texts.append(_packed(text))
                    h = shingles(text, known, words)
                    regs = registers(h) if len(h) else None
                    sketch = (None, None) if regs is None else (regs.tobytes(), band_keys(regs).tolist())
                    out.append((row, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), *sketch))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                given = [pa.array(texts, pa.binary()) if i == 1 else c for i, c in enumerate(own.columns)]
                yield pa.RecordBatch.from_arrays([*given, *columns], names=[*own.schema.names, *names])

    return run


def _limited(df: DataFrame) -> DataFrame:
    """df of fixed-width columns to join with: broadcast where a count shows that it is small, else left to a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


_SETS = "_key bigint, _part bigint, _role int, _node bigint, _set binary"


def _sets(words: int) -> Callable:
    """(packed text, node, key, part, role) in; the same with the full set out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 512):
                text, node, key, part, role = batch.slice(start, 512).columns
                raw = pa.array([shingles(_unpacked(t.as_py()), known, words).tobytes() for t in text], pa.binary())
                yield pa.RecordBatch.from_arrays([key, part, role, node, raw], names=["_key", "_part", "_role", "_node", "_set"])

    return run


def _with_sets(wanted: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Full sets of the wanted rows (_row, _key, _part, _role), from the texts stored beside the sketches."""
    texts = rows.select("_row", "_text").join(_limited(wanted), "_row")
    return texts.select("_text", F.col("_row").alias("_node"), "_key", "_part", "_role").mapInArrow(_sets(words), _SETS)


def _intersect(percent: int) -> Callable:
    """Rows sorted by (key, part, role): the hub's set comes first, its partners stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            found = []
            for key, part, role, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    at, hub = (key, part), own
                elif at == (key, part):
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub) + len(own) - both):
                        found.append((node, key))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets reach the threshold."""
    parts = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(HUB_PARTNERS)).cast("long").alias("_parts")), "near-hubs")
    role = lambda n: F.lit(n).cast("int").alias("_role")
    own_part = F.pmod(F.xxhash64("a"), F.col("_parts")).alias("_part")
    members = matched(pairs, parts, "b", "a").select(F.col("a").alias("_row"), F.col("b").alias("_key"), own_part, role(1))
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part")
    hubs = parts.select(F.col("b").alias("_row"), F.col("b").alias("_key"), every_part, role(0))
    sets = _with_sets(stored(members.union(hubs), "near-wanted"), rows, words)
    together = sets.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_role", "_node")
    return stored(together.mapInArrow(_intersect(percent), "a bigint, b bigint").distinct(), "near-links")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same (bucket, key), which come first; blocks bound their length."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for bucket, key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, key) != last:
                if len(held) > 1:
                    yield last, held
                held, last = [], (bucket, key)
            held.append(tuple(row))
    if len(held) > 1:
        yield last, held


def _partners(i: int, bucket: int, side, comp, n, bands, regs, percent: int) -> np.ndarray:
    """Members that may reach the threshold with member i and are to be compared with it here.

    They are of another component, near enough in size and by estimate, and
    share no earlier band with it (there the pair is compared already).
    """
    goal = percent / 100
    others = np.flatnonzero((comp != comp[i]) & ((side == 1) | (np.arange(len(side)) > i)) & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent))
    if len(others):
        others = others[(bands[others] == bands[i]).argmax(axis=1) == np.flatnonzero(bands[i] == bucket)[0]]
    if len(others):
        guess, based_on = estimates(regs[i], regs[others], n[i], n[others])
        others = others[guess >= goal - SLACK * np.sqrt(goal * (1 - goal) / based_on)]
    return others


def _members(held: list[tuple]) -> tuple:
    side, node, comp, n, bands, regs = list(zip(*held))[:6]
    return *(np.array(c, np.int64) for c in (side, node, comp, n)), np.array(bands, np.int64), np.frombuffer(b"".join(regs), np.uint16).reshape(-1, BUCKETS)


def _promising(percent: int) -> Callable:
    """Of groups of members, those members that have a partner by estimate (at most one row for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, key), held in _groups(batches):
            side, node, comp, n, bands, regs = _members(held)
            hit = np.zeros(len(node), bool)
            for i in np.flatnonzero(side == 0):
                others = _partners(i, bucket, side, comp, n, bands, regs, percent)
                if len(others):
                    hit[i] = hit[others] = True
            if hit.any():
                rows = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int64()), pa.array([key] * len(rows)), pa.array(side[rows]), pa.array(node[rows]), pa.array(comp[rows])], names=["_bucket", "_key", "_s", "_row", "_comp"])

    return run


def _group_links(percent: int) -> Callable:
    """Of groups of members with full sets: verified links, none between what links of the group join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), held in _groups(batches):
            side, node, comp, n, bands, regs = _members(held)
            sets = [np.frombuffer(row[6], np.uint64) for row in held]
            joined = comp.copy()
            found = []
            for i in np.flatnonzero(side == 0):
                others = _partners(i, bucket, side, joined, n, bands, regs, percent)
                if not len(others):
                    continue
                own, many = sets[i], np.concatenate([sets[j] for j in others])
                at = np.minimum(np.searchsorted(own, many), len(own) - 1)
                both = np.add.reduceat((own[at] == many).astype(np.int64), np.concatenate([[0], np.cumsum(n[others])[:-1]]))
                for j in others[100 * both >= percent * (n[i] + n[others] - both)]:
                    if joined[j] != joined[i]:
                        found.append((node[i], node[j]))
                        joined[joined == joined[j]] = joined[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _late_links(multi: DataFrame, tops: DataFrame, comps: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame | None:
    """Verified links between components inside a bucket, compared in blocks of members; None if no bucket is mixed.

    Per bucket, members of the top's component (side 1) meet only the others
    (side 0), the others also each other. A member of side 1 is sent once per
    block of side 0, one of side 0 once per block of either side. Registers tell
    which members have a partner at all; only those are sent with their sets.
    Pairs never become rows: a group gives at most one link per member.
    """
    placed = multi.join(comps.withColumnRenamed("node", "_row"), "_row", "left").withColumn("_comp", F.coalesce("comp", "_row")).drop("comp")
    top = tops.select("_bucket", F.col("_top").alias("_row")).join(comps.withColumnRenamed("node", "_row"), "_row", "left").select("_bucket", F.coalesce("comp", "_row").alias("_main"))
    mixed = placed.groupBy("_bucket").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).where("_low <> _high").select("_bucket").join(top, "_bucket")
    members = placed.join(mixed, "_bucket").withColumn("_side", (F.col("_comp") == F.col("_main")).cast("long"))
    sizes = members.groupBy("_bucket").agg(*[F.greatest(F.lit(1), F.ceil(F.sum((F.col("_side") == s).cast("long")) / F.lit(BLOCK))).cast("int").alias(f"_blocks{s}") for s in (0, 1)])
    each = members.join(sizes, "_bucket").withColumn("_block", F.pmod(F.xxhash64("_row", "_bucket"), F.when(F.col("_side") == 0, F.col("_blocks0")).otherwise(F.col("_blocks1"))).cast("int"))
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.col("_block")
    groups = F.when(F.col("_side") == 1, F.transform(to("_blocks0"), lambda i: group(1, i, block))).otherwise(
        F.concat(F.transform(to("_blocks1"), lambda j: group(1, block, j)), F.transform(F.filter(to("_blocks0"), lambda i: i != block), lambda i: group(0, F.least(i, block), F.greatest(i, block))))
    )
    sent = each.select("_bucket", "_side", "_row", "_comp", F.explode(groups).alias("_group"))
    # In a group of two blocks of side 0, all members are compared with each other.
    side = F.when(F.col("_group.kind") == 1, F.col("_side")).otherwise(F.lit(0).cast("long"))
    keyed = sent.select("_bucket", F.concat_ws(":", "_group.kind", "_group.i", "_group.j").alias("_key"), side.alias("_s"), "_row", "_comp")
    keyed = stored(keyed, "near-members")
    if keyed.isEmpty():
        return None
    # Only the members' sketches move.
    sketches = rows.select("_row", "_n", "_bands", "_regs").join(_limited(stored(keyed.select("_row").distinct(), "near-rows")), "_row", "left_semi")
    order = ["_bucket", "_key", "_s", "_row", "_comp", "_n", "_bands", "_regs"]
    dealt = lambda df, *more: df.select(*order, *more).repartition("_bucket", "_key").sortWithinPartitions("_bucket", "_key", "_row")
    promising = stored(dealt(keyed.join(sketches, "_row")).mapInArrow(_promising(percent), "_bucket bigint, _key string, _s bigint, _row bigint, _comp bigint"), "near-promising")
    zero = F.lit(0).cast("long")
    wanted = promising.select("_row").distinct().select("_row", zero.alias("_key"), zero.alias("_part"), F.lit(0).alias("_role"))
    sets = _with_sets(stored(wanted, "near-wanted"), rows, words).select(F.col("_node").alias("_row"), "_set")
    return stored(dealt(promising.join(sketches, "_row").join(sets, "_row"), "_set").mapInArrow(_group_links(percent), "a bigint, b bigint").distinct(), "near-late")


def _decided(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int, rest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents as stored rows, and for each (_row, _id, _n, _component, _stays).

    _component is the smallest identifier of the row's component; _stays marks
    one row of each component (of several with that identifier, the first).
    """
    kind = id_type(docs, id_col)
    more = [] if rest is None else [rest.alias("_rest")]
    source = docs.select(F.col(f"`{id_col}`").cast(kind).alias("_id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("_text"), *more)
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    rows = stored(source.mapInArrow(_sketches(words), f"{given}, _row bigint, _n bigint, _digest binary, _regs binary, _bands array<bigint>"), "near-sketches")
    full = rows.where("_n > 0")
    first = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    classes = stored(full.groupBy("_digest").agg(F.min("_row").alias("_node"), F.min(first).alias("_first")), "near-classes")
    nodes = full.select("_row", "_bands").join(classes.select(F.col("_node").alias("_row")), "_row", "left_semi")
    bands = nodes.select("_row", F.explode("_bands").alias("_bucket"))
    shared = bands.groupBy("_bucket").agg(F.count("*").alias("_count")).where("_count > 1")
    multi = stored(bands.join(shared, "_bucket").select("_bucket", "_row", "_count"), "near-buckets")
    scores = multi.groupBy("_row").agg(F.sum("_count").alias("_score"))
    ranked = multi.join(scores, "_row").select("_bucket", "_row", F.struct("_score", (-F.col("_row")).alias("_minus")).alias("_rank"))
    tops = stored(ranked.groupBy("_bucket").agg(F.max("_rank").alias("_best")).select("_bucket", (-F.col("_best._minus")).alias("_top"), "_best"), "near-tops")
    proposals = multi.join(tops, "_bucket").groupBy("_row").agg(F.max("_best").alias("_best")).select(F.col("_row").alias("a"), (-F.col("_best._minus")).alias("b")).where("a <> b")
    early = _verified(stored(proposals, "near-proposals"), rows, percent, words)
    comps = components(early)
    late = _late_links(multi.select("_bucket", "_row"), tops, comps, rows, percent, words)
    if late is not None and not late.isEmpty():
        comps = components(early.union(late))
    narrow = None if kind == "bigint" else False  # strings have no known width
    # Of linked classes only: the others stand for themselves.
    linked = stored(classes.join(comps.withColumnRenamed("node", "_node"), "_node"), "near-linked")
    least = stored(linked.groupBy("comp").agg(F.min("_first").alias("_least")), "near-least")
    named = matched(linked, least, "comp", "_node", narrow).select("_digest", "_least")
    by_class = stored(classes.join(named, "_digest", "left").select("_digest", F.coalesce("_least", "_first").alias("_least")), "near-named")
    marked = matched(full.select("_row", "_id", "_n", "_digest"), by_class, "_digest", "_row", narrow)
    out = marked.select("_row", "_id", "_n", F.col("_least.id").alias("_component"), (F.col("_least.row") == F.col("_row")).alias("_stays"))
    alone = rows.where("_n = 0").select("_row", "_id", "_n", F.col("_id").alias("_component"), F.lit(True).alias("_stays"))
    return rows, out.union(alone)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: the id, n_shingles, component_id and kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are
    linked; component_id is the smallest id that links reach, kept tells that it
    is the document's own.

    Defined cases: a null or empty text, or one without words, has no shingles
    and is linked with nothing; a null id never names a component unless all of
    its members have none; repeated rows each give a row and share a component
    through their equal sets; identifiers other than strings and integers raise
    a TypeError; an empty table gives an empty result; other columns are ignored.
    """
    _, found = _decided(docs, id_col, text_col, percent, words)
    kept = F.col("_id").eqNullSafe(F.col("_component"))
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest id.

    Rows are told apart by themselves, not by their id: of several rows with the
    smallest id of a component one stays, of rows with a null id one if no row of
    the component has an id. Documents without words all stay. Other cases as in
    near_duplicates; a null text stays null.
    """
    others = [c for c in docs.columns if c != text_col]
    schema = docs.schema
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").isNull().alias("untold"))
    rows, found = _decided(docs, id_col, text_col, percent, words, rest)
    gone = stored(found.where("not _stays").select("_row"), "near-gone")
    stay = rows.join(_limited(gone), "_row", "left_anti").select("_text", "_rest")
    whole = stay.mapInArrow(_whole_texts, f"_text string, _rest {stay.schema['_rest'].dataType.simpleString()}")
    back = {c: F.col(f"_rest.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("_rest.untold"), F.col("_text")).cast(schema[text_col].dataType)}
    return whole.select(*[back[c].alias(c) for c in docs.columns])


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed texts as text again."""
    for batch in batches:
        for start in range(0, len(batch), 512):
            packed, rest = batch.slice(start, 512).columns
            text = pa.array([_unpacked(t.as_py()) for t in packed], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text, rest], names=["_text", "_rest"])
