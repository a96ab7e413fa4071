"""Media columns: payloads as images in archives, read by a Spark data source.

The writer stores each payload as an 8-bit greyscale PNG image, 192 samples a row, in ZIP archives of bounded size,
members uncompressed beside the image's own compression. The reader plans byte ranges over the archives of a
folder from their sizes alone; a task reads its archive's directory, takes the members that start in its range, and
streams them in Arrow batches. A member that fails, or whose checksum is wrong, is read again by its
offset, alone, some times; then the task fails, or, if permissive, the row carries the error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from firmlake.llm.common import shared_dir, written

SAMPLES = 192  # in a row of an image; payloads are padded to a multiple
ARCHIVE = 32 << 20  # bytes after which the writer begins another archive
RANGE = 8 << 20  # bytes of an archive that a reading task takes
BATCH = 4 << 20  # payload bytes of an Arrow batch
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def filesystem(path: str):
    """(file system, path in it): local, or any that Arrow knows by its scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def padded(text: str | None) -> tuple[bytes, int]:
    """(payload, bytes of the text): spaces fill up to a positive multiple of SAMPLES."""
    data = (text or "").encode(errors="replace")
    n = max(SAMPLES, -(-len(data) // SAMPLES) * SAMPLES)
    return data + b" " * (n - len(data)), len(data)


def encoded(payload: bytes) -> bytes:
    """A greyscale PNG image, eight bits a sample, without row filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    raw = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # each row begins with its filter, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decoded(image: bytes) -> bytes:
    """The samples of such an image; raises ValueError if it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, width, height = 8, [], 0, 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        part = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise ValueError("wrong chunk checksum")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            if rest[:2] != [8, 0]:
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and their entropy in bits, to three digits."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    return f"rows={len(x) // SAMPLES};mean={x.mean():.3f};std={x.std():.3f};entropy={-(some * np.log2(some)).sum():.3f}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", limit: int = ARCHIVE) -> DataFrame:
    """Store every payload; returns (archive, members), one row an archive, of what the tasks have written. Runs when acted on.

    A member's name holds its number in the archive, the text's size and the id (none for null). An archive's name
    holds the partition, the attempt and a counter, and it appears under that name only when whole. An attempt that was lost
    may leave archives behind; the rows returned name those that count, so write them, and read these alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = filesystem(folder)
        made, buffer, archive, members = [], None, None, 0

        def close():
            archive.close()
            name = f"{base}/part-{part:06d}-{attempt}-{len(made):05d}.zip"
            with fs.open_output_stream(f"{name}.tmp") as out:
                out.write(buffer.getvalue())
            fs.move(f"{name}.tmp", name)
            made.append((name, members))

        fs.create_dir(base, recursive=True)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    buffer, members = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                payload, size = padded(text.as_py())
                key = key.as_py()
                info = zipfile.ZipInfo(f"{members}_{size}_{'' if key is None else key}.png")
                archive.writestr(info, encoded(payload))
                members += 1
                if buffer.tell() >= limit:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "members"])

    return docs.select(id_col, text_col).mapInArrow(run, "archive string, members long")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


SCHEMA = "archive string, member string, offset long, media binary, payload binary, error string"


class ArchiveSource(DataSource):
    """Format ``media_archive``. Options: path; manifest (a Parquet folder with a column archive: the ones to read, by default all of the path);
    range (bytes a task); tries; mode, strict or permissive."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range, self.manifest = options["path"], int(options.get("range", RANGE)), options.get("manifest")
        self.tries, self.strict = int(options.get("tries", TRIES)), options.get("mode", "strict") == "strict"

    def partitions(self) -> list[Range]:
        """Byte ranges from the folder's listing, and the manifest if there is one; no archive is opened."""
        from pyarrow import dataset, fs

        system, base = filesystem(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.path.endswith(".zip")]
        if self.manifest:
            place, table = filesystem(self.manifest)
            names = {a.rsplit("/", 1)[-1] for a in dataset.dataset(table, filesystem=place, format="parquet").to_table(columns=["archive"])["archive"].to_pylist()}
            files = [f for f in files if f.path.rsplit("/", 1)[-1] in names]
            if len(files) < len(names):
                raise OSError(f"{len(names) - len(files)} archives of the manifest are missing from {self.path}")
        return [Range(f.path, at, at + self.range) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.range)] or [Range("", 0, 0)]

    def read_member(self, open_file, info, first: bytes | None) -> tuple[bytes | None, bytes | None, str | None]:
        """(media, payload, error): checked against the directory's checksum; after a failure from the member's offset again."""
        error = None
        for attempt in range(self.tries):
            try:
                media = first if attempt == 0 and first is not None else fetch(open_file, info)
                if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
                    raise ValueError("wrong member checksum")
                return media, decoded(media), None
            except (OSError, ValueError, struct.error, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
        if self.strict:
            raise OSError(f"member {info.filename} at {info.header_offset}: {error}")
        return None, None, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import zipfile

        if not partition.path:
            return
        system, _ = filesystem(self.path)

        def open_file():
            return system.open_input_file(partition.path)

        with open_file() as f, zipfile.ZipFile(f) as archive:
            members = sorted((i for i in archive.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
        columns: list[list] = [[] for _ in range(6)]
        size = 0

        def batch():
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "member", "offset", "media", "payload", "error"])

        with open_file() as f:
            for info in members:
                try:
                    first = fetch(lambda: f, info, keep=True)
                except (OSError, ValueError, struct.error):
                    first = None
                media, payload, error = self.read_member(open_file, info, first)
                for c, v in zip(columns, (partition.path, info.filename, info.header_offset, media, payload, error), strict=True):
                    c.append(v)
                size += len(media or b"") + len(payload or b"")
                if size >= BATCH:
                    yield batch()
                    columns, size = [[] for _ in range(6)], 0
        if columns[0]:
            yield batch()


def fetch(open_file, info, keep: bool = False) -> bytes:
    """A stored member's bytes, by its offset."""
    f = open_file()
    try:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":  # fixed value of the format
            raise ValueError("no member at this offset")
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(info.header_offset + 30 + name + extra)
        return f.read(info.compress_size)
    finally:
        if not keep:
            f.close()


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's payload to archives in the shared folder and read them: the source's columns.

    Null and empty texts give one row of spaces. Repeated rows and ids are members of their own. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "media")
    manifest = written(write_archives(docs, folder, id_col, text_col), "manifest")
    members, rows = manifest.agg(F.sum("members")).first()[0] or 0, docs.count()
    if members != rows:
        raise RuntimeError(f"{members} members were written of {rows} rows; the input changes from read to read")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("manifest", manifest._written_to).load(folder)


def features(media: DataFrame) -> DataFrame:
    """(member, n_bytes, payload_bytes, ...) computed from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for member, image, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, size, key = member.removesuffix(".png").split("_", 2)
                digest = [hashlib.sha256(x).hexdigest() for x in (payload, image)]
                out.append((key or None, int(size), len(payload), digest[0], zlib.crc32(payload[-16:]), len(image), digest[1], feature(payload)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("member", "media", "payload").mapInArrow(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back, and measured; nulls, repeated rows and an empty table as in ``stored``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(stored(docs)).withColumn("doc_id", F.col("doc_id").cast("long"))
