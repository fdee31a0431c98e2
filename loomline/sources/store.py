"""Tables that are written between the stages of a chain, which cuts the lineage of what is built on them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a folder of this machine serves a session that
    runs in this one process; a cluster must name one."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: a lost executor costs no recomputation, and a plan over it starts here."""
    path = f"{folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
