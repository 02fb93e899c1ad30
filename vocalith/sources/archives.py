"""Zip archives as a data source and a sink of Spark's Python data source interface.

Reading: the driver reads the central directory alone, and each entry of a wanted kind is one partition, which seeks to its
entry and inflates it as a stream.  So an archive of n files is n tasks, and no task holds an archive or an entry.  An archive that
was written here names the places in an entry where a stream can start (in a field of the directory that others skip); there
each piece is a partition.

Writing: rows come sorted by entry and place, and each task writes what it has of an entry as a segment of its own beside the
target: deflated, and ended such that the next one's can follow.  The commit puts the segments behind each other, an entry
after the other, and combines their checksums; no row passes the driver.  A task that fails or is run twice leaves at most a segment that
no message names, and the folder of segments goes with the commit or the abort.

Files are opened by Arrow's file systems (local, hdfs, s3, gcs), which are seekable, on the driver and on executors.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of a batch that is read, and bytes that are written or copied at a time.
LINES, CHUNK = 50_000, 4 << 20
#: Packed bytes that are inflated at a time; bytes of lines from which a piece ends; the field that names pieces, and how many it holds.
INFLATED, PIECE = 1 << 18, 32 << 20
FIELD, MOST = 0x4B56, 5000
FORMAT = "release_archive"


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Entry(InputPartition):
    path: str
    name: str
    kind: str
    start: int = 0  # of a piece in the archive; its packed bytes, if it isn't a whole entry, and its checksum
    packed: int = 0
    crc: int = 0


class ArchiveReader(DataSourceReader):
    """kind, line of the entries whose file names match a kind's pattern; the ends of lines go, \\n or \\r\\n."""

    def __init__(self, path: str, patterns: dict[str, str]):
        self.path, self.patterns = path, patterns

    def partitions(self) -> Sequence[InputPartition]:
        files, path = opened(self.path)
        kind = lambda name: next((k for k, p in self.patterns.items() if re.match(p, posixpath.basename(name))), None)
        out = []
        with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist():
                if not (k := kind(info.filename)):
                    continue
                if not (found := pieces_of(info.extra)):
                    out.append(Entry(self.path, info.filename, k))
                    continue
                f.seek(info.header_offset + 26)
                at = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                for packed, crc in found:
                    out.append(Entry(self.path, info.filename, k, at, packed, crc))
                    at += packed
        return out

    def read(self, partition: Entry | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # an archive without such entries
            return
        files, path = opened(partition.path)
        with files.open_input_file(path) as f:
            if partition.packed:
                f.seek(partition.start)
                yield from _batches(pa, partition.kind, _inflated(f, partition))
            else:
                with zipfile.ZipFile(f) as z, z.open(partition.name) as entry:
                    yield from _batches(pa, partition.kind, (line.rstrip(b"\n") for line in entry))


def pieces_of(extra: bytes) -> list[tuple[int, int]]:
    """(packed bytes, checksum) of the pieces that an entry's extra fields name."""
    at = 0
    while at + 4 <= len(extra):
        field, size = struct.unpack_from("<HH", extra, at)
        if field == FIELD and at + 4 + size <= len(extra):
            return list(struct.iter_unpack("<II", extra[at + 4 : at + 4 + size]))
        at += 4 + size
    return []


def _inflated(f, piece: Entry) -> Iterator[bytes]:
    """Lines of a piece, which ends with one."""
    inflate, left, rest, crc = zlib.decompressobj(-15), piece.packed, b"", 0
    while left:
        data = f.read(min(left, INFLATED))
        if not data:
            raise zipfile.BadZipFile(f"{piece.name} is cut off")
        left -= len(data)
        raw = inflate.decompress(data)
        crc = zlib.crc32(raw, crc)
        *lines, rest = (rest + raw).split(b"\n")
        yield from lines
    if crc != piece.crc:
        raise zipfile.BadZipFile(f"bad checksum of a piece of {piece.name}")
    if rest:
        yield rest


def _batches(pa, kind: str, every: Iterator[bytes]) -> Iterator:
    lines: list[str] = []
    for line in every:
        lines.append(line.removesuffix(b"\r").decode())
        if len(lines) == LINES:
            yield _batch(pa, kind, lines)
            lines = []
    yield _batch(pa, kind, lines)


def _batch(pa, kind: str, lines: list[str]):
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(lines), pa.string()), pa.array(lines, pa.string())], ["kind", "line"])


@dataclass
class Segment:
    """What one task has of an entry: a stretch of its file of segments."""

    entry: str
    file: str
    offset: int
    packed: int
    raw: int
    crc: int
    pieces: list[list[int]]  # packed, raw, checksum of what can be inflated by itself


@dataclass
class Segments(WriterCommitMessage):
    task: int
    segments: list[Segment]


def combined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two strings behind each other, from those of both: the first's, moved on by the second's length, times x^8 a byte.

    Polynomials over two elements modulo the checksum's, bits reversed as the checksum has them.
    """

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, factor = 1 << 31, 1 << 23  # 1, and x^8
    while length:
        if length & 1:
            power = times(power, factor)
        factor = times(factor, factor)
        length >>= 1
    return times(power, first) ^ second


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (entry, line), sorted over all partitions, as one archive; or, not packed, as one plain file."""

    def __init__(self, path: str, packed: bool):
        self.path, self.packed, self.parts = path, packed, f"{path}.segments-{uuid.uuid4().hex}"

    def write(self, iterator) -> Segments:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        files, parts = opened(self.parts)
        name = f"{parts}/{task}-{uuid.uuid4().hex}"
        segments: list[Segment] = []
        out, deflate = None, None

        def close() -> None:
            """The end of a piece, from which another stream can follow."""
            if segments and segments[-1].pieces:
                last = deflate.flush(zlib.Z_FULL_FLUSH) if self.packed else b""
                out.write(last)
                segments[-1].packed += len(last)
                segments[-1].pieces[-1][0] += len(last)

        for batch in iterator:
            if out is None:
                files.create_dir(parts)
                out = files.open_output_stream(name)
            entries, lines = batch.column(0), batch.column(1)
            for at in range(0, len(batch), LINES):
                names, some = entries.slice(at, LINES).to_pylist(), lines.slice(at, LINES).to_pylist()
                edges = [i for i, e in enumerate(names) if i == 0 or e != names[i - 1]]
                for a, b in zip(edges, [*edges[1:], len(names)], strict=True):
                    if not segments or segments[-1].entry != names[a]:
                        close()
                        segments.append(Segment(names[a], name, sum(s.packed for s in segments), 0, 0, 0, []))
                    elif segments[-1].pieces[-1][1] >= PIECE:
                        close()
                    if not segments[-1].pieces or segments[-1].pieces[-1][1] >= PIECE:
                        segments[-1].pieces.append([0, 0, 0])
                        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
                    raw = "".join(f"{x}\n" for x in some[a:b]).encode()
                    data = deflate.compress(raw) if self.packed else raw
                    out.write(data)
                    s = segments[-1]
                    s.packed, s.raw, s.crc = s.packed + len(data), s.raw + len(raw), zlib.crc32(raw, s.crc)
                    p = s.pieces[-1]
                    p[0], p[1], p[2] = p[0] + len(data), p[1] + len(raw), zlib.crc32(raw, p[2])
        close()
        if out is not None:
            out.close()
        return Segments(task, segments)

    def commit(self, messages) -> None:
        files, path = opened(self.path)
        each = [s for m in sorted((m for m in messages if m), key=lambda m: m.task) for s in m.segments]
        made = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(made) as out:
            if self.packed:
                _write_archive(out, each, files)
            else:
                for s in each:
                    _copy(s, files, out)
        files.move(made, path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, parts = opened(self.parts)
        if files.get_file_info(parts).type == fs.FileType.Directory:
            files.delete_dir(parts)


def _copy(s: Segment, files, out) -> None:
    with files.open_input_file(s.file) as f:
        f.seek(s.offset)
        left = s.packed
        while left:
            data = f.read(min(left, CHUNK))
            out.write(data)
            left -= len(data)


def _named(segments: list[Segment]) -> bytes:
    """The field of an entry's pieces; none if one of them is too large for it."""
    pieces = [tuple(p) for s in segments for p in s.pieces]
    while len(pieces) > MOST:
        pairs = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
        pieces = [(a[0] + b[0][0], a[1] + b[0][1], combined_crc(a[2], b[0][2], b[0][1])) if b else a for a, *b in pairs]
    if any(p[0] >> 32 for p in pieces):
        return b""
    data = b"".join(struct.pack("<II", packed, crc) for packed, _, crc in pieces)
    return struct.pack("<HH", FIELD, len(data)) + data


def _write_archive(out, segments: list[Segment], files) -> None:
    """Local headers, joined segments and the central directory of a zip file, in its 64-bit form throughout; times are the format's first."""
    entries: dict[str, list[Segment]] = {}
    for s in segments:
        entries.setdefault(s.entry, []).append(s)
    end = b"\x03\x00"  # an empty last block
    directory, at = [], 0
    for entry, own in entries.items():
        crc, raw, packed = 0, sum(s.raw for s in own), sum(s.packed for s in own) + len(end)
        for s in own:
            crc = combined_crc(crc, s.crc, s.raw)
        name = entry.encode()
        common = struct.pack("<HHHHHIIIH", 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name))
        sizes = struct.pack("<QQ", raw, packed)
        head = b"PK\x03\x04" + common + struct.pack("<H", 4 + len(sizes)) + name + struct.pack("<HH", 1, len(sizes)) + sizes
        out.write(head)
        for s in own:
            _copy(s, files, out)
        out.write(end)
        extra = struct.pack("<HHQQQ", 1, 24, raw, packed, at) + _named(own)
        directory.append(b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHHII", len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        at += len(head) + packed
    size = sum(map(len, directory))
    for d in directory:
        out.write(d)
    out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(directory), len(directory), size, at))
    out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, at + size, 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ArchiveSource(DataSource):
    """Options: path; kinds, a JSON object of kind to pattern of file names (reading); packed, true or false (writing)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "kind string, line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], json.loads(self.options["kinds"]))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options.get("packed", "true") == "true")


def archive_lines(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(kind, line) of a zip file's entries of these kinds, one partition for each entry, or piece if these are known."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).option("kinds", json.dumps(patterns)).load(path)


def write_entries(rows: DataFrame, path: str, order: Sequence, packed: bool = True) -> None:
    """rows (entry, line and the columns of order) as one zip file, entries by name and lines by order; or as one plain file.

    Sorted by ranges, so that a task has a stretch of the file. A file that is there is replaced when the new one is whole.
    """
    rows.sparkSession.dataSource.register(ArchiveSource)
    ordered = rows.orderBy("entry", *order).select(F.col("entry"), F.col("line"))
    ordered.write.format(FORMAT).option("packed", str(packed).lower()).mode("append").save(str(path))
