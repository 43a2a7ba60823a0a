"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over training time 0..1. Its integral is the
source's weight; water filling turns weights into token targets under a cap of
so many repetitions. A source's documents lie in hash order on a line of its
words, which is walked again for each repetition. Inverting the cumulative
demand target * W(t) / W(1) at a document's place on that line gives the time at
which it is trained on, and a range sort by that time gives the training order.

Places on the line are prefix sums in two levels: sums by (source, hash bucket),
then rows inside a bucket. The number of a source's buckets follows its row
count, so that no task holds a whole source, whatever the share of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Weight over time as (time, weight) knots, joined by straight lines; their integrals are 1, 2 and 3.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 2.0), (1.0, 4.0)),
)
MAX_EPOCHS = 3
BUCKET_ROWS = 1024
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words of a text that isn't null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start of the cumulated weight, start time, weight there, slope) of each straight piece."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError("knots need growing times and weights of 0 or more")
        out.append((total, float(t0), float(w0), (w1 - w0) / (t1 - t0)))
        total += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))


def _time_at(cumulated: Column, pieces: Column) -> Column:
    """Invert the integrated schedule: the time at which the weight cumulated so far is reached."""
    piece = F.element_at(F.filter(pieces, lambda p: p["at"] <= cumulated), -1)
    over = cumulated - piece["at"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["w"] * piece["w"] + 2.0 * piece["slope"] * over))
    return piece["t"] + F.when(over <= 0, F.lit(0.0)).otherwise(2.0 * over / (piece["w"] + root))


def _sources(sized: DataFrame, schedules, max_epochs: int, bucket_rows: int) -> DataFrame:
    """One row per source: size, target, weight, pieces of its schedule, number of buckets."""
    totals = sized.groupBy("_src").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    which = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules)))
    weight, pieces = F.lit(None).cast("double"), F.lit(None)
    for i, knots in enumerate(schedules):
        weight = F.when(which == i, F.lit(integral(knots))).otherwise(weight)
        made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("at", "t", "w", "slope"), s)]) for s in segments(knots)])
        pieces = F.when(which == i, made).otherwise(pieces)
    totals = totals.withColumns({"_weight": weight, "_pieces": pieces, "_cap": (F.col("_total") * max_epochs).cast("double")})
    # Water filling: sources in order of cap / weight; those before the level are full.
    order = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_src").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("_total").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = F.col("_left") / F.col("_share")
    full = F.max(F.when(F.col("_cap") > level * F.col("_weight"), level)).over(everything)
    levels = totals.withColumns({"_left": left, "_share": share}).withColumn("_level", full)
    target = F.when(F.col("_level").isNull() | (F.col("_cap") <= F.col("_level") * F.col("_weight")), F.col("_cap")).otherwise(F.col("_level") * F.col("_weight"))
    return levels.select("_src", "_total", "_weight", "_pieces", target.alias("_target"), F.ceil(F.col("_rows") / F.lit(bucket_rows)).cast("long").alias("_buckets"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, max_epochs: int = MAX_EPOCHS, seed: int = 0, bucket_rows: int = BUCKET_ROWS, carry: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies and position.

    size is the number of words, taken how many of them the mix takes over all
    repetitions, copies in how many passes the document occurs, position the
    time (0..1) at which it first occurs; with carry a column _doc holds the
    input row. A source's passes walk its documents in hash order; the last,
    partial one ends inside a document, so that the source's taken words are its
    target rounded down.

    Defined cases: a null text has size 0; a null source is a source of its own,
    last in order; a null id hashes like the empty string; a document of size 0
    takes 0 words, has no copies and no position; an empty table gives an empty
    result; repeated rows count one by one. Other columns may have any name.
    """
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f":{seed}")))
    columns = [
        F.col(f"`{id_col}`").alias("_id"),
        F.when(F.col(f"`{source_col}`").isNull(), F.lit(None)).otherwise(F.col(f"`{source_col}`").cast("string")).alias("_src"),
        word_count(text_of(F.col(f"`{text_col}`"))).alias("_size"),
        F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("_hash"),
    ]
    sized = stored(docs.select(*columns), "mix-sizes")
    sources = stored(_sources(sized, schedules, max_epochs, bucket_rows), "mix-sources")
    rows = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")) if carry else sized
    bucket = F.floor(F.col("_hash") / F.lit(float(1 << HASH_BITS)) * F.col("_buckets")).cast("long").alias("_bucket")
    # The table of sources is read from its file, so Spark knows its size when it picks the join.
    known = sources.select(F.col("_src").alias("_s"), "_total", "_target", "_weight", "_pieces", "_buckets")
    joined = rows.join(known, F.col("_src").eqNullSafe(F.col("_s")))
    sums = sized.join(known.select("_s", "_buckets"), F.col("_src").eqNullSafe(F.col("_s"))).groupBy(F.coalesce(F.concat(F.lit("s"), "_src"), F.lit("n")).alias("_k"), bucket).agg(F.sum("_size").alias("_in_bucket"))
    running = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_k", "_bucket", F.coalesce(F.sum("_in_bucket").over(running), F.lit(0)).alias("_offset"))
    placed = joined.select("*", F.coalesce(F.concat(F.lit("s"), "_src"), F.lit("n")).alias("_k"), bucket).join(offsets, ["_k", "_bucket"])
    inside = Window.partitionBy("_k", "_bucket").orderBy("_hash", F.col("_id").cast("string"), "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    words = F.floor("_target").cast("long")
    whole = F.when(F.col("_total") > 0, F.expr("_words div _total")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_words") - F.col("_whole") * F.col("_total") - F.col("_start")))
    out = placed.withColumn("_start", start).withColumn("_words", words).withColumn("_whole", whole).withColumn("_part", part)
    taken = (F.col("_whole") * F.col("_size") + F.col("_part")).cast("long")
    copies = F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.col("_whole") + (F.col("_part") > 0).cast("long")).cast("long")
    time = F.when(copies > 0, _time_at(F.col("_start") / F.col("_target") * F.col("_weight"), F.col("_pieces")))
    kept = ["_doc", "_start", "_total", "_target", "_weight", "_pieces"] if carry else []
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), copies.alias("copies"), time.alias("position"), "_hash", *kept)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix as training rows: mix()'s columns, range-sorted by position.

    Documents that the mix leaves out come last, in hash order, so that they too
    are spread over the range partitions.
    """
    return mix(docs, **options).orderBy(F.col("position").asc_nulls_last(), "_hash").drop("_hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order with the columns of docs.

    A document occurs once for each pass that takes words of it, whole even
    where the last pass ends inside it; each copy stands at its own time.
    """
    plan = mix(docs, carry=True, **options).where("copies > 0")
    each = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_pass"))
    place = (F.col("_start") + F.col("_pass") * F.col("_total")) / F.col("_target") * F.col("_weight")
    return each.withColumn("_time", _time_at(place, F.col("_pieces"))).orderBy("_time", "_hash").select("_doc.*")
