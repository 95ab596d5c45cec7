"""What the operators share: written intermediate tables and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.sources.scratch import saved as written
from querylens.sources.scratch import shared_dir

#: A key with at least this share of all rows counts as hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Most rows that a checked side may have to be broadcast whole.
BROADCAST_ROWS = 20_000


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/querylens/".split(":", 1)[-1].lstrip("/")
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``right`` (one row a key) to ``left``, whose keys may be very uneven.

    ``weight`` is a column of ``right`` with the key's rows in ``left``, ``total`` their sum. Keys with at least
    HOT_SHARE of all rows, of which there can be no more than 1 / HOT_SHARE, are broadcast; the others, each with
    less than that share, are joined by a shuffle. ``left`` is read twice, so it should be a written table.
    """
    least = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(weight) >= least))
    cold = right.filter(F.col(weight) < least)
    mine = left.join(hot, keys, "inner")
    rest = left.join(F.broadcast(right.filter(F.col(weight) >= least).select(*keys)), keys, "left_anti")
    return mine.unionByName(rest.join(cold, keys, how))
