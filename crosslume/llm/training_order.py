"""Training-order materialisation: binary shards whose records lie in a keyed random order.

Documents are cut into sequences of ``length`` token ids. All N sequences are numbered; a Feistel network on
the least even number of bits that holds N, walked until it returns below N, maps numbers one to one to
slots 0..N-1. Slot ranges are the partitions: each task sorts its slots and joins the records into
shards of a fixed number of records and bytes. The place of a slot is thus arithmetic, a reader can go on
anywhere, and another key gives another order of the same records.

A record is a little-endian uint16 count and ``length`` ids (uint16 if the vocabulary allows, else uint32),
the rest zeros. ``write_shards`` writes one file for each shard and skips those that are complete.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.packing import cut, tokenizer_path
from crosslume.llm.words import mix, slices
from crosslume.sources.staging import stage

LENGTH = 512
RECORDS = 4096  # of a shard
ROUNDS = 6
SMALL = 100_000  # tasks whose counts may be broadcast, 16 bytes each


def feistel(numbers: np.ndarray, total: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..total-1 chosen by ``key``, applied to ``numbers``."""
    half = max(1, -(-int(max(total - 1, 1)).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [mix(np.array([key * 2 * ROUNDS + i], np.int64).view(np.uint64))[0] for i in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def _numbered(path: str, length: int):
    """Sequences of the texts, compressed, with the task's number and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            found = cut(path, batch.column("text"), length, 0)
            wide = bool(len(found.ids)) and int(found.ids.max()) >= 1 << 16
            raw = [np.frombuffer(x, "<u4") for x in found.raw()]
            rows = len(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * rows, pa.int32()),
                    pa.array(np.arange(n, n + rows)),
                    pa.array([wide] * rows),
                    pa.array([press.compress((x if wide else x.astype("<u2")).tobytes()) for x in raw], pa.binary()),
                    pa.array(found.length.astype(np.int32)),
                ],
                ["part", "row", "wide", "record", "length"],
            )
            n += rows

    return run


def _slots(total: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(np.asarray(batch.column("number")), total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), batch.column("length"), batch.column("record")], ["slot", "length", "record"]
            )

    return run


def _shards(length: int, dtype: str, records: int):
    import zstandard

    stride = 2 + length * np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def row(first: int, parts: list[bytes]) -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([first // records], pa.int64()),
                    "first_slot": pa.array([first], pa.int64()),
                    "records": pa.array([len(parts)], pa.int64()),
                    "stride": pa.array([stride], pa.int32()),
                    "crc32": pa.array([zlib.crc32(data)], pa.int64()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        first, parts = 0, []
        for batch in batches:
            for slot, size, record in zip(*(batch.column(c).to_pylist() for c in ("slot", "length", "record"))):
                if slot % records == 0 and parts:
                    yield row(first, parts)
                    parts = []
                if not parts:
                    first = slot
                data = expand.decompress(record)
                ids = np.frombuffer(data, f"<u{len(data) // size}").astype(dtype)
                parts.append((np.array([size], "<u2").tobytes() + ids.tobytes()).ljust(stride, b"\0"))
        if parts:
            yield row(first, parts)

    return run


def training_order(
    docs: DataFrame, key: int = 20, length: int = LENGTH, records: int = RECORDS, path: str | None = None
) -> DataFrame:
    """One row for each shard: ``shard``, ``first_slot``, ``records``, ``stride``, ``crc32`` and its bytes ``data``.

    Every document gives its ids and an end id 0, in sequences of ``length``, the first of which may be shorter
    (an empty or null text gives the end id alone); every row counts. A table without rows gives no shard.
    """
    if not 0 < length < 1 << 16:
        raise ValueError("length must fit 16 bits")
    texts = docs.select("text")
    schema = "part int, row long, wide boolean, record binary, length int"
    rows = stage(texts.mapInArrow(_numbered(path or tokenizer_path(), length), schema), "order-records")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.max("wide").alias("wide"))
    parts = parts.orderBy("part").collect()  # a row for each task that cut documents
    total = sum(p["n"] for p in parts)
    dtype = "<u4" if any(p["wide"] for p in parts) else "<u2"
    before = np.cumsum([0] + [p["n"] for p in parts]).tolist()
    spark = docs.sparkSession
    starts = spark.createDataFrame(
        [(p["part"], b) for p, b in zip(parts, before)], "part int, before long"
    )
    if len(parts) <= SMALL:
        starts = F.broadcast(starts)
    rows = rows.join(starts, "part").select((F.col("before") + F.col("row")).alias("number"), "length", "record")
    rows = rows.mapInArrow(_slots(total, key), "slot long, length int, record binary")
    shards = -(-total // records) or 1
    # Range bounds are known: equally many shards for each partition.
    n = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16)))
    per = -(-shards // n) * records
    rows = rows.repartitionById(n, (F.col("slot") / per).cast("int")).sortWithinPartitions("slot")
    schema = "shard long, first_slot long, records long, stride int, crc32 long, data binary"
    return rows.mapInArrow(_shards(length, dtype, records), schema)


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard to a file of ``folder`` (a URI or path all executors reach); returns shard, file, bytes, written.

    Files are written under another name and moved, so a file that is there is complete; it is kept if
    its size and crc32 are those of the shard. A lost task or a second call thus only writes what is missing, and
    files of another order (another key, or documents that were split over tasks in another way) are
    replaced, never mixed with new ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)

        def same(name: str, size: int, crc: int) -> bool:
            if system.get_file_info(name).size != size:
                return False
            found = 0
            with system.open_input_stream(name) as held:
                while part := held.read(1 << 22):
                    found = zlib.crc32(part, found)
            return found == crc

        for batch in batches:
            for shard, crc, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "crc32", "data"))):
                name = f"{root}/shard-{shard:010d}.bin"
                done = same(name, len(data), crc)
                if not done:
                    part = f"{name}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(data)
                    system.move(part, name)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int64()),
                        "file": pa.array([name]),
                        "bytes": pa.array([len(data)], pa.int64()),
                        "written": pa.array([not done]),
                    }
                )

    return shards.select("shard", "crc32", "data").mapInArrow(run, "shard long, file string, bytes long, written boolean")


def read_slot(shard: bytes, slot: int, first_slot: int, stride: int, length: int) -> np.ndarray:
    """The ids of a slot from the bytes of its shard."""
    record = shard[(slot - first_slot) * stride :][:stride]
    width = (stride - 2) // length
    return np.frombuffer(record[2:], f"<u{width}")[: int.from_bytes(record[:2], "little")]
