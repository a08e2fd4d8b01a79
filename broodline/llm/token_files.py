"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the documents of one range of ids, in ascending order:

    magic, then blocks, then the start of every block, then the documents
    (id, a NULL mark, first token), then a footer with the counts.

A block has up to ``BLOCK_IDS`` ids: the block minimum, a bit width, the number
of exceptions; the differences to the minimum packed at that width; then the
exceptions, as positions and the bits beyond the width. The width is the one with
the fewest bytes among those that hold the ``PERCENTILES`` of the differences.

Files are written under another name and moved when complete, so a repeated task
leaves one whole file with the same content. Defined results: a NULL or empty
text consists of the closing id; NULL ids come first; rows with equal ids stay
next to each other; no rows give no files and an empty result.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.llm.arrays import slices
from broodline.llm.graph import settled
from broodline.llm.tokenizing import encoder
from broodline.sources.scratch import scratch_path

MAGIC = b"PFORIDS1"
BLOCK_IDS = 16384
PERCENTILES = (0.9, 0.95, 0.99, 1.0)
#: minimum, width, ids, exceptions
HEAD = "<IBII"
#: start of the block starts, blocks, documents, ids
FOOT = "<QQQQ"
#: Rows of documents that one file takes, roughly.
ROWS_PER_FILE = 20_000
#: Ids after which a file is closed and the next begun; only a single longer document makes a longer file.
IDS_PER_FILE = 32 << 20


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width as a stream of ``width`` bits each, 64 values to a group."""
    if not width:
        return b""
    groups = -(-len(values) // 64)
    grid = np.zeros((groups * 64,), np.uint64)
    grid[: len(values)] = values
    lanes = np.ascontiguousarray(grid.reshape(groups, 64).T)
    out = np.zeros((width, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        out[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint64)
    groups = -(-count // 64)
    words = np.ascontiguousarray(np.frombuffer(data, "<u8", groups * width).reshape(groups, width).T)
    lanes = np.empty((64, groups), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)[:count]


def packed_size(count: int, width: int) -> int:
    return -(-count // 64) * 8 * width


def encode_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    over = (ids - np.uint32(least)).astype(np.uint64)
    ranks = np.sort(over)
    best = None
    for share in PERCENTILES:
        width = int(ranks[min(len(ranks) - 1, int(share * len(ranks)))]).bit_length()
        beyond = len(ranks) - int(np.searchsorted(ranks, np.uint64(1) << np.uint64(width)))
        cost = packed_size(len(ids), width) + 8 * beyond
        if best is None or cost < best[0]:
            best = (cost, width)
    width = best[1]
    high = over >> np.uint64(width)
    spots = np.flatnonzero(high)
    low = over & np.uint64((1 << width) - 1)
    return b"".join(
        (
            struct.pack(HEAD, least, width, len(ids), len(spots)),
            pack_bits(low, width),
            spots.astype("<u4").tobytes(),
            high[spots].astype("<u4").tobytes(),
        )
    )


def decode_block(data: memoryview, start: int) -> np.ndarray:
    least, width, count, beyond = struct.unpack_from(HEAD, data, start)
    at = start + struct.calcsize(HEAD)
    size = packed_size(count, width)
    values = unpack_bits(data[at : at + size], width, count)
    at += size
    if beyond:
        spots = np.frombuffer(data, "<u4", beyond, at)
        high = np.frombuffer(data, "<u4", beyond, at + 4 * beyond)
        values[spots] |= high.astype(np.uint64) << np.uint64(width)
    return (values + np.uint64(least)).astype("<u4")


class FileWriter:
    """Writes one file block by block; holds one block of ids and the small tables."""

    def __init__(self, sink: io.RawIOBase):
        self.sink, self.at = sink, 0
        self.held: list[np.ndarray] = []
        self.held_ids = self.ids = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, self.ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= 8 * BLOCK_IDS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        joined = np.concatenate([np.zeros(0, "<u4"), *self.held])
        stop = len(joined) if last else len(joined) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, stop, BLOCK_IDS):
            self.starts.append(self.at)
            self.put(encode_block(joined[at : min(at + BLOCK_IDS, stop)]))
        self.held = [joined[stop:]]
        self.held_ids = len(joined) - stop

    def close(self) -> None:
        self.flush(True)
        index = self.at
        self.put(np.array(self.starts, "<u8").tobytes())
        table = np.array(self.docs, [("id", "<i8"), ("null", "u1"), ("start", "<u8")])
        self.put(table.tobytes())
        self.put(struct.pack(FOOT, index, len(self.starts), len(self.docs), self.ids))


def read_documents(data: bytes) -> Iterator[tuple[int | None, int, int, int]]:
    """id, first token, number of ids and crc32 of the ids of each document of a file."""
    view = memoryview(data)
    if bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token file")
    index, blocks, docs, total = struct.unpack_from(FOOT, view, len(data) - struct.calcsize(FOOT))
    starts = np.frombuffer(view, "<u8", blocks, index).tolist()
    table = np.frombuffer(
        view, [("id", "<i8"), ("null", "u1"), ("start", "<u8")], docs, index + 8 * blocks
    )
    firsts = [*table["start"].tolist(), total]
    number, ids = -1, b""
    for row in range(docs):
        crc, at = 0, firsts[row]
        while at < firsts[row + 1]:
            block, inside = divmod(at, BLOCK_IDS)
            if block != number:
                number, ids = block, decode_block(view, starts[block]).tobytes()
            stop = min(firsts[row + 1], (block + 1) * BLOCK_IDS)
            crc = zlib.crc32(ids[4 * inside : 4 * (inside + stop - at)], crc)
            at = stop
        doc = None if table["null"][row] else int(table["id"][row])
        yield doc, firsts[row], firsts[row + 1] - firsts[row], crc


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, closing: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files below ``folder``; returns ``path, first_id, order, n_docs, n_tokens`` of each.

    Documents are dealt by ranges of ids, and of text hashes where very many have one id
    or none, and sorted; a range is cut into files of ``IDS_PER_FILE`` ids. ``order``
    puts the files in the order of their documents.
    """
    chosen = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = chosen.select("doc").count()
    files = max(1, -(-rows // ROWS_PER_FILE), min(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    chosen = chosen.withColumn("tie", F.xxhash64("text"))
    ordered = chosen.repartitionByRange(files, "doc", "tie").sortWithinPartitions("doc", "tie")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        writer, rolled = None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            store.move(aside, name)
            return pa.RecordBatch.from_pylist(
                [{"path": name.rsplit("/", 1)[1], "first_id": first, "order": number * 1_000_000 + rolled,
                  "n_docs": len(writer.docs), "n_tokens": writer.ids}],
                schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("order", pa.int64()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

        for batch in batches:
            for part in slices(batch):
                ids, begins = encoder(tokenizer).encode(part.column("text"))
                for row, doc in enumerate(part.column("doc").to_pylist()):
                    if writer is not None and writer.ids >= IDS_PER_FILE:
                        yield closed()
                        writer, rolled = None, rolled + 1
                    if writer is None:
                        number, first = part.column("part")[0].as_py(), doc
                        name = f"{base}/ids-{number:07d}-{rolled:06d}.pfor"
                        store.create_dir(base, recursive=True)
                        aside = f"{base}/_{uuid.uuid4().hex}"
                        sink = store.open_output_stream(aside)
                        writer = FileWriter(sink)
                    writer.add(doc, np.append(ids[begins[row] : begins[row + 1]], np.uint32(closing)).astype("<u4"))
        if writer is not None:
            yield closed()

    manifest = ordered.select("doc", "text", "part").mapInArrow(
        write, "path string, first_id long, order long, n_docs long, n_tokens long"
    )
    return settled(manifest, "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document in the files, decoded.

    Only the manifest, a row for each file, passes through the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: r["order"])
    before, base = 0, {}
    for r in files:
        base[r["path"]] = before
        before += r["n_tokens"]
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lifted = base[path.rsplit("/", 1)[1]]
                docs = list(read_documents(data.as_buffer().to_pybytes()))
                doc, start, count, crc = zip(*docs, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64()),
                        pa.array(np.array(start, np.int64) + lifted),
                        pa.array(count, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    return content.select("path", "content").mapInArrow(read, schema)


def round_trip(
    docs: DataFrame, tokenizer: str, closing: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, closing, key, text)
    return read_token_files(docs.sparkSession, folder, manifest, key)
