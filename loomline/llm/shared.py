"""Helpers that the text operators share: word patterns, shared storage, ranks over sorted keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a folder of this machine serves a session that
    runs in this one process, as in tests; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Written tables that cut lineage: plain Parquet in the shared folder, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads; without names all of them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(conf).delete(path, True)


    def drop_but(self, *names: str) -> None:
        """Removes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        gone = [n for n in (f.getPath().getName() for f in found) if n not in names]
        if gone:
            self.drop(*gone)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() would also fold letters outside ASCII."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def tables(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def ranked(df: DataFrame, key: str, out: str, scratch: Scratch) -> DataFrame:
    """Adds the 0-based rank of each row by a unique key, without bringing all rows to one task.

    The driver sees one count for each range partition, never a key.
    """
    dealt = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, f"ranked-{out}")
    before, start = 0, {}
    for row in sorted(dealt.groupBy("_part").count().collect()):
        start[row[0]] = before
        before += row[1]
    if not start:
        return dealt.drop("_part").withColumn(out, F.lit(0).cast("long"))
    offsets = F.create_map(*(F.lit(x).cast("long") for pair in start.items() for x in pair))
    window = Window.partitionBy("_part").orderBy(key)
    rank = offsets[F.col("_part").cast("long")] + F.row_number().over(window) - 1
    return dealt.withColumn(out, rank.cast("long")).drop("_part")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
