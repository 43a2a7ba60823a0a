"""What the corpus operators share: the shared folder, stored intermediates, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_local_dirs: list[tempfile.TemporaryDirectory] = []
#: Paths that stored() has made and that aren't deleted yet, with what deletes them.
_made: dict[str, tuple] = {}
#: Paths that stored() has made inside each open released() block, the innermost last.
_open_blocks: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is missing and the session is a plain local one (as
    in tests) is a temporary folder made and set.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.TemporaryDirectory(prefix="tessel-shared-", ignore_cleanup_errors=True)
    _local_dirs.append(made)
    atexit.register(made.cleanup)
    spark.conf.set("spark.checkpoint.dir", f"file://{made.name}")
    return f"file://{made.name}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks that read the
    table, and several readers never compute df twice with different results.
    What is still there when the driver's Python ends is deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessel-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_delete_at_exit)
    _made[path] = (spark._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    for block in _open_blocks[-1:]:
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_exit() -> None:
    """Results that were still to be computed can't be any more, so their stored tables go."""
    for path, (jvm, conf) in _made.items():
        with contextlib.suppress(Exception):  # the JVM may have ended, or the folder gone
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, wherever it lies."""
    _made.pop(path, None)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what stored() makes inside: for results that are written before the block ends.

    A result that is still to be computed needs its stored tables, so plain
    queries leave them in the shared folder until the driver ends.
    """
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            delete(spark, path)


def id_type(docs: DataFrame, id_col: str) -> str:
    """string or bigint; identifiers of other types would lose their identity in a cast, so they are refused."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.IntegralType):
        return "bigint"
    raise TypeError(f"identifiers are strings or integers, not {kind.simpleString()}")


#: Rows up to which a table of a few fixed-width columns (at most 64 bytes a row, so 13 MB) is broadcast.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame) -> bool:
    """Whether a table of fixed-width columns may be broadcast, by counting it."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def matched(left: DataFrame, right: DataFrame, key: str, row: str, small: bool | None = None) -> DataFrame:
    """left joined to right, whose key is unique, where one key may hold a large share of left.

    A small right side is broadcast; small says whether it is, None to find out by
    counting (for fixed widths only). Otherwise a key's rows are dealt over as many parts as there are shuffle partitions; right's row comes
    to each part that occurs, so no task gets all rows of a key.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), key)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part_", F.pmod(F.xxhash64(row), F.lit(parts)))
    found = dealt.select(key, "_part_").distinct().join(right, key)
    return dealt.join(found, [key, "_part_"]).drop("_part_")


def text_of(column: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_list(text: Column) -> Column:
    """array<string> of the words of a text, empty where there is none (JVM side)."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
