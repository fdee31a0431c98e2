"""Blocks of texts, and an exchange of sorted keys between them.

A block is a few megabytes of texts in one row, so that numpy works on many texts at once. Blocks send their distinct
keys to parts, each a range of the key space; a part, one to a task, sorts what it got and answers every block key by key.
Nothing but one row a block and part is shuffled (at most one a key, where there are more parts than a block has keys), and
a key that a third of all texts have comes to its part once from each block only. Answers are posted to the blocks as files
in the shared folder, so that the texts stay where they were written.
"""

from __future__ import annotations

import ctypes
import time
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch

BLOCKS = "block long, ids array<bigint>, lens array<int>, data binary"
#: What a part sorts at once, at most, in bytes of keys.
PART_BYTES = 16 << 20
LEAST_PART_BYTES = 1 << 20


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 64, size: int = 24 << 20):
    """Few, large rows go to Python in small batches meanwhile."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    were = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets at most so many rows of whole texts go to Python at once. Plans run later than they are made, so the setting
    stays; a lower one is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def _pack(size: int):
    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                                               pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "lens", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (text or "").encode("utf-8", "surrogatepass")
                if held and held + len(text) > size:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield block()

    return run


def blocks(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """docs' ids and texts in written blocks of about that size; a longer text has a block of its own."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return scratch.keep(base.mapInArrow(lean(_pack(size)), BLOCKS), "blocks")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of the key space (parts under 2 ** 31), so that sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_parts(keys: np.ndarray, parts: int):
    """(part, first, last) for each part that sorted keys fall into: as many rows as there are such parts, however many
    parts there are."""
    of = part_of(keys, parts)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)])


def parts_for(spark: SparkSession, size: int) -> int:
    """Enough parts for so many bytes of keys that none sorts more than PART_BYTES; as many as the session has shuffle
    partitions if each gets LEAST_PART_BYTES then, so that messages between parts and blocks don't outnumber their keys."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(wanted, -(-size // LEAST_PART_BYTES)), -(-size // PART_BYTES))


PACKER, UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte by byte of all elements, so that equal high bytes compress."""
    out = []
    for a in arrays:
        raw = PACKER.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out.append(len(raw).to_bytes(4, "little") + bytes([a.itemsize]) + len(a).to_bytes(4, "little") + raw)
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        size, item, n = int.from_bytes(body[at : at + 4], "little"), body[at + 4], int.from_bytes(body[at + 5 : at + 9], "little")
        raw = UNPACKER.decompress(body[at + 9 : at + 9 + size], max_output_size=max(1, n * item))
        out.append(np.frombuffer(raw, np.uint8).reshape(item, n).T.copy().view(f"<u{item}").reshape(n) if n else np.zeros(0, f"<u{item}"))
        at += 9 + size
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned numbers; np.cumsum gives them back."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def lean(f):
    """f for mapInArrow, giving freed memory back to the system now and then: two workers share an executor with its JVM."""

    def run(batches):
        try:
            trim = ctypes.CDLL(None).malloc_trim
        except (AttributeError, OSError):  # another C library
            trim = None
        last = 0.0
        for out in f(batches):
            yield out
            del out
            if trim and time.monotonic() - last > 0.5:
                pa.default_memory_pool().release_unused()
                trim(0)
                last = time.monotonic()
        if trim:
            pa.default_memory_pool().release_unused()
            trim(0)

    return run


def answered(sent: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """Rows of sent (part, ...) go to their part, one part to a task; answer turns a task's rows into rows of the schema."""
    return sent.repartitionById(parts, F.col("part").cast("int")).mapInArrow(lean(answer), schema)


def posted(answers: DataFrame, scratch: Scratch, name: str) -> str:
    """Writes rows for blocks (block, ..) where the tasks that hold the blocks find them: one folder for each split that the
    blocks were made from. Blocks don't move, whatever they are sent."""
    crated = answers.withColumn("crate", F.shiftright("block", 32)).repartition("crate")
    crated.write.option("compression", "zstd").partitionBy("crate").parquet(scratch.path(name))
    return scratch.path(name)


class Mail:
    """What was posted to blocks, read by the task that holds them, a split's blocks at a time."""

    def __init__(self, path: str):
        self.path, self.crate, self.rows = path, None, {}

    def of(self, block: int) -> list[dict]:
        if block >> 32 != self.crate:
            from pyarrow import dataset, fs

            self.crate, self.rows = block >> 32, {}
            store, root = fs.FileSystem.from_uri(self.path)
            folder = f"{root}/crate={self.crate}"
            if store.get_file_info(folder).type == fs.FileType.Directory:
                for row in dataset.dataset(folder, filesystem=store, format="parquet").to_table().to_pylist():
                    self.rows.setdefault(row["block"], []).append(row)
        return self.rows.get(block, [])


def all_rows(batches) -> dict[str, list]:
    """The columns of all of a task's batches as lists."""
    out: dict[str, list] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns):
            out.setdefault(name, []).extend(column.to_pylist())
    return out
