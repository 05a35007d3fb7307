"""What the operators of this subpackage share: reading tables, checkpoints, and size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of small tables that are broadcast; past it the join shuffles. A row here is a key and a few numbers.
BROADCAST_ROWS = 50_000
#: A key is hot if it has more than one in so many of all rows.
HOT_KEYS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none, a local one is set if all
    tasks run on this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scanweave-"))
        got = sc._jsc.sc().getCheckpointDir()
    return got.get()


def durable(df: DataFrame) -> DataFrame:
    """df checkpointed once to the shared folder, so that lost executors cost no recomputation and later readers see
    the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same by way of a Parquet table in the shared folder: compressed, and later reads take the columns they need.
    The tables go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a written() table that no later step reads; what was written from it is on its own."""
    _remove(df.sparkSession, df._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session has ended: its files go with its folder
        pass


def join_small(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """big joined with a table of so many counted rows: broadcast up to BROADCAST_ROWS, else shuffled, where adaptive
    execution splits skewed partitions of big."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def join_counted(big: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """big joined with a written table of distinct keys and `rows`, the number of big's rows of each (of `total` in all;
    the column is left out). Keys with more than one in HOT_KEYS of all rows, of which there can be no more than
    HOT_KEYS, are broadcast, so that their rows stay where they are; the rest is shuffled."""
    is_hot = F.col("rows") > total // HOT_KEYS
    hot, cold = F.broadcast(counted.filter(is_hot).drop("rows")), counted.filter(~is_hot).drop("rows")
    return big.join(hot, on).unionByName(big.join(hot.select(*on), on, "left_anti").join(cold, on))


def free_name(name: str, columns: list[str]) -> str:
    """name, with as many underscores behind it as it takes to be none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def beside_keys(rows: DataFrame, keys: list[str], run: Callable, results: str) -> DataFrame:
    """What `run`, a function over Arrow batches, makes of rows with a first column `keys`, a struct of the columns of
    that name: the keys, and behind them its results (as DDL). A result of a key's name gets an underscore behind it."""
    made = StructType.fromDDL(results).fields
    got = rows.mapInArrow(run, StructType([rows.schema["keys"], *made]))
    return got.select("keys.*", *(F.col(f.name).alias(free_name(f.name, keys)) for f in made))


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_fraction(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only: 52 bits of an MD5, which other engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
