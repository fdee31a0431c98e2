"""Token counts with a digest cache: only texts that the cache lacks are encoded, each once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.exchange import small_batches
from loomline.llm.shared import Scratch, shared_dir, tables

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"
#: Bytes of a digest by which a split knows what to leave out.
KEY = 16


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version_of(path: str) -> str:
    """The tokenizer's version: its kind and the digest of its file."""
    with open(path, "rb") as file:
        return f"{path.rpartition('.')[2]}-{hashlib.sha256(file.read()).hexdigest()[:16]}"


@lru_cache(maxsize=2)
def counter(path: str):
    """texts -> counts, by the library that the file's ending names; loaded once in each worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def encoder(path: str, version: str, skip: str):
    """Encodes a split's texts in place, each distinct one once; skip: the folder of the digests that a split leaves out,
    one folder part=N for each split that leaves any out."""

    def left_out() -> set[bytes]:
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(skip)
        folder = f"{root}/part={TaskContext.get().partitionId()}"
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return set()
        return set(dataset.dataset(folder, filesystem=store, format="parquet").to_table(columns=["key"]).column("key").to_pylist())

    def encode(batches):
        count, done = counter(path), None
        for batch in batches:
            if done is None:
                done = left_out()
            digests, texts = [], []
            for text in batch.column("text").to_pylist():
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                if digest[:KEY] not in done:
                    done.add(digest[:KEY])
                    digests.append(digest)
                    texts.append(text)
            n: list[int] = []
            for i in range(0, len(texts), 64):
                n += count(texts[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    return encode


def cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens of the stored counts of that version; none where there is no cache yet. A broken cache raises."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    known = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, digest, n_bytes, n_tokens, over_limit.

    cache is the folder of stored counts (shared by all executors), tokenizer a .model or .json file on every machine.
    Stored counts are found by SHA-256 of the text, null as empty, and by tokenizer version; what is missing is encoded
    once for each distinct text and appended. Two runs at a time may append a count twice, which does no harm.

    Texts never move. Of each missing digest one split of docs is told to encode it, the first that has it; the other
    splits get the digests to leave out as files in the shared folder. Should docs not come in the same splits twice (rows
    dealt anew at random), a text may be encoded twice, and one that was left out by all is encoded at the end.

    A null or empty text has 0 bytes and what the tokenizer gives for "". Texts of any length are encoded whole.
    Repeated rows and null ids are rows of the result like any other. An empty table encodes nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{shared_dir(spark)}/token-counts"
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    version = version_of(tokenizer)
    base = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    slim = base.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"))
    slim = scratch.keep(slim, "slim")
    # A digest comes once from each split, so that one that a third of all rows have is no hot key.
    held = slim.select("digest", "part").distinct()
    known = cached(spark, cache, version)
    home = held.groupBy("digest").agg(F.min("part").alias("home")).join(known.select("digest", F.lit(True).alias("known")), "digest", "left")
    away = held.join(home, "digest").where("known OR home <> part").select("part", F.substring("digest", 1, KEY).alias("key"))
    away.repartition("part").write.partitionBy("part").parquet(scratch.path("away"))
    base.select("text").mapInArrow(encoder(tokenizer, version, scratch.path("away")), CACHE).write.mode("append").parquet(cache)
    lost = scratch.keep(held.select("digest").distinct().join(cached(spark, cache, version), "digest", "left_anti"), "lost")
    if lost.limit(1).count():
        again = base.select("text", digest).join(lost, "digest", "left_semi").dropDuplicates(["digest"]).select("text")
        again.mapInArrow(encoder(tokenizer, version, scratch.path("none")), CACHE).write.mode("append").parquet(cache)
    counts = held.join(cached(spark, cache, version), "digest")
    found = scratch.keep(slim.join(counts, ["part", "digest"]).select("doc_id", "digest", "n_bytes", "n_tokens"), "found")
    scratch.drop("slim", "away", "lost")
    return found.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Unless told of one it starts with an empty cache of its own, so that a run's figures include all encoding."""
    docs = spark.read.parquet(tables(sf_dir, "documents"))
    return count_tokens(docs, cache or Scratch(spark, "token-counts").path("cache")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
