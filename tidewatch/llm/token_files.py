"""Token-id files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A shard is one file. Every document is one zstandard frame of its ids (little-endian, 2 or 4 bytes each), in ascending
order of doc_id. Two skippable frames follow: the index (width of an id, doc_ids and which are null, compressed) and the
seek table in the public "zstandard seekable" layout, last in the file: for each frame its compressed size, its size and
the low 32 bits of the XXH64 of its content. A reader takes the end of the file, finds a document's frame by adding up
sizes, fetches that range alone and checks it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, shared_dir, slices, written
from tidewatch.llm.tokens import STEP, encoder, largest_id

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_FRAME = 0x184D2A5D
HAS_CHECKSUMS = 0x80

MANIFEST = "path string, shard int, documents long, n_tokens long, bytes long"
DOCUMENT = "doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Appends documents to a file that is open for writing."""

    def __init__(self, sink, width: int, level: int = 3):
        import zstandard

        self.sink, self.width, self.frames, self.ids, self.nulls = sink, width, [], [], []
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.n_tokens = self.written = 0

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        if len(raw) >= 1 << 32:
            raise ValueError("a document's ids must take less than 4 GiB")
        frame = self.compress(raw)
        self.sink.write(frame)
        self.frames.append((len(frame), len(raw), _xxh(raw)))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n_tokens += len(ids)
        self.written += len(frame)

    def close(self) -> None:
        index = self.compress(np.array(self.ids, dtype="<i8").tobytes() + np.packbits(np.array(self.nulls, dtype=bool)).tobytes())
        table = np.array(self.frames, dtype="<u4").tobytes()
        tail = struct.pack("<IIBI", INDEX_FRAME, len(index) + 1, self.width, 0)[:9] + index
        tail += struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE)
        self.sink.write(tail)
        self.written += len(tail)


class ShardReader:
    """Random access to a shard by document number; only the requested frames are fetched and decompressed."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.expand = source, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable token file")
        table_at = size - 17 - 12 * n
        head = struct.unpack("<II", self._range(table_at, 8))
        if head != (SKIPPABLE, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(self._range(table_at + 8, 12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        kind, length, self.width = struct.unpack("<IIB", self._range(at, 9))
        if kind != INDEX_FRAME or at + 8 + length != table_at:
            raise ValueError("damaged index")
        raw = self.expand(self._range(at + 9, length - 1), max_output_size=9 * n + 8)
        self.doc_ids = np.frombuffer(raw, dtype="<i8", count=n)
        self.nulls = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=8 * n))[:n].astype(bool)
        self.lengths = self.table[:, 1].astype(np.int64) // self.width

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def read(self, first: int, stop: int | None = None) -> Iterator[np.ndarray]:
        """Ids of documents first .. stop - 1 (one if no stop), fetched as one range."""
        stop = first + 1 if stop is None else stop
        base = int(self.starts[first])
        got = self._range(base, int(self.starts[stop]) - base)
        for k in range(first, stop):
            raw = self.expand(got[self.starts[k] - base : self.starts[k + 1] - base], max_output_size=int(self.table[k, 1]) or 1)
            if len(raw) != self.table[k, 1] or _xxh(raw) != self.table[k, 2]:
                raise ValueError(f"document {k}: its frame does not match its checksum")
            yield np.frombuffer(raw, dtype=f"<u{self.width}")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", width: int = 2) -> DataFrame:
    """Encode whole texts (null: empty), append end_id, write shards in ascending doc_id order; the manifest of shards.

    Documents are dealt by ranges of doc_id and sorted within (nulls first, equal ids by a hash of their text). A task
    that runs twice writes two files; only those that the written manifest names count. width: bytes of an id, 2 or 4;
    ids that don't fit are refused.
    """
    if width not in (2, 4) or max(largest_id(tokenizer), end_id) >= 1 << 8 * width:
        raise ValueError(f"ids of {tokenizer} do not fit {width} bytes")
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        writer = sink = path = None
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                if writer is None and batch.num_rows:
                    path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId():08d}.tok"
                    fs, inner = _filesystem(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(inner)
                    writer = ShardWriter(sink, width)
                ids, at = enc.encode(batch.column("text"), end_id)
                ids, cuts = ids.astype(f"<u{width}"), at.tolist()
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                    writer.append(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            sink.close()
            row = [path, task.partitionId(), len(writer.frames), writer.n_tokens, writer.written]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "shard", "documents", "n_tokens", "bytes"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files themselves: doc_id, start (ids before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    shards = manifest.select("path", "bytes", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, base in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "base")), strict=True):
                fs, inner = _filesystem(path)
                with fs.open_input_file(inner) as source:
                    shard = ShardReader(source, size)
                    starts = base + np.concatenate([[0], np.cumsum(shard.lengths)])
                    first = 0
                    while first < len(shard):
                        stop = max(first + 1, int(np.searchsorted(shard.starts, shard.starts[first] + (1 << 20), side="right")) - 1)
                        crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.read(first, stop)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[first:stop], mask=shard.nulls[first:stop]), pa.array(starts[first:stop]), pa.array(shard.lengths[first:stop]), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first = stop

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """Write documents as token files in the shared folder and return what the files say of each document.

    Null texts count as empty (the end id alone); null doc_ids come first; repeated rows are documents of their own; an
    empty table writes no file and gives no row; extra columns are ignored.
    """
    return read_token_files(write_token_files(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer, end_id, text))
