"""What the operators of this subpackage share: words, shared storage, bounded Arrow batches.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  ``bytes.split()``
splits on exactly these six bytes, so on the Python side words are ``text.encode().split()``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Ids are looked at in ranges of this width, of which 64 bits have 256.
ID_RANGE = 1 << 56


class IdSpace:
    """doc_id as a long in which null ids have places behind all others: for operators that need one number a row.

    Ids must be whole numbers.  A null id gets a number that its text gives, so rows without id and of one
    text share it.  Without null ids a number is the id.  Else one range of ID_RANGE numbers that holds no
    id is found (the topmost; mostly the very top, and nothing moves), ids above it move down by its width,
    and null ids take the top.  A table with null ids and ids in all 256 ranges is refused.
    """

    def __init__(self, docs: DataFrame):
        ids = docs.select(F.col("doc_id").cast("long").alias("i"))
        self.gap: int | None = None
        if not ids.where("i IS NULL").isEmpty():
            used = {r[0] for r in ids.where("i IS NOT NULL").select(F.shiftright("i", 56)).distinct().collect()}  # 256 at most
            free = [r for r in range(127, -129, -1) if r not in used]
            if not free:
                raise ValueError("null doc_ids beside ids in all ranges of 64 bits")
            self.gap = free[0]

    def known(self) -> Column:
        i = F.col("doc_id").cast("long")
        if self.gap is None:
            return i
        moved = i if self.gap == 127 else F.when(i >= (self.gap + 1) * ID_RANGE, i - ID_RANGE).otherwise(i)
        return F.coalesce(moved, F.lit(127 * ID_RANGE) + F.pmod(F.xxhash64("text"), F.lit(ID_RANGE)))

    def given(self, name: str) -> Column:
        """The id that a number stands for."""
        i = F.col(name)
        if self.gap is None:
            return i
        moved = i if self.gap == 127 else F.when(i >= self.gap * ID_RANGE, i + ID_RANGE).otherwise(i)
        return F.when(i < 127 * ID_RANGE, moved)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, quoted, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_key() -> Column:
    """What tells texts of one doc_id apart; never null."""
    return F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))


_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one of this machine in local mode, in which the driver is the only executor;
    on a cluster an error, since what executors write to their own disks can't be read back.
    """
    global _OWN_DIR
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _OWN_DIR = _OWN_DIR or "file://" + tempfile.mkdtemp(prefix="lanewright-")
    return at.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by released() or when the driver ends."""
    folder = f"{shared_dir(spark)}/lanewright-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    _WRITTEN.append((spark, folder))
    return f"{folder}/{name}"


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written; the scratch tables written on the way are deleted."""
    before = len(_WRITTEN)
    out = materialize(make(), name)
    for spark, folder in _WRITTEN[before:-1]:
        at, fs = _hadoop(spark, folder)
        fs.delete(at, True)
    _WRITTEN[before:] = _WRITTEN[-1:]
    return out


def small_batches(spark: SparkSession, rows: int = 512, size: str = "32m") -> None:
    """Arrow batches of whole texts stay small, in rows and bytes, so that a run of long texts fits in a Python worker.

    Settings that are smaller already are left as they are.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= _bytes(size):
        spark.conf.set(key, size)


def _bytes(size: str) -> int:
    digits = size.lower().rstrip("bkmgt")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[size.lower()[len(digits) :].rstrip("b")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
