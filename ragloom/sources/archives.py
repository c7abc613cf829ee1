"""Members of tar and zip archives as lines, from any path that Spark's own readers open.

Spark's text reader delivers a file's bytes as the pieces between line feeds; sorted by their place they
are dealt to one task an archive, which reads them as a stream in bounded pieces: decompressed, cut into
members and then into lines, without a copy of the archive or of a member anywhere.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a stream reads at once, and of the lines of a batch.
CHUNK, BATCH = 1 << 16, 1 << 20


class Stream:
    """A file-like reader, forward only, of an iterator of bytes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def peek(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n and (more := next(self.chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        self.held = b"".join(parts)
        return self.held[:n]

    def read(self, n: int = -1) -> bytes:
        if n < 0:
            out, self.held = self.held + b"".join(self.chunks), b""
            return out
        out = self.peek(n)
        self.held = self.held[len(out) :]
        return out

    def put_back(self, data: bytes) -> None:
        self.held = data + self.held

    def some(self) -> Iterator[bytes]:
        while data := self.read(CHUNK):
            yield data


def _inflated(source: Stream, make: Callable) -> Iterator[bytes]:
    """The members of a compressed stream one after the other; what follows the last is left."""
    while source.peek(1):
        d = make()
        while not d.eof and (data := source.read(CHUNK)):
            yield d.decompress(data)
        source.put_back(d.unused_data)
        if not d.eof:
            raise EOFError("a compressed stream is cut off")
        if source.peek(1) == b"\0":  # padding
            return


def opened(source: Stream) -> Stream:
    """The stream itself, or what it is compressed from: gzip, bzip2 or xz, by its first bytes."""
    head = source.peek(6)
    for magic, make in ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\0", lzma.LZMADecompressor)):
        if head.startswith(magic):
            return Stream(_inflated(source, make))
    return source


def _zip_members(source: Stream) -> Iterator[tuple[str, Stream]]:
    """Members of a zip archive in the order of their local headers."""
    while source.peek(4) == b"PK\x03\x04":
        _, _, flags, method, _, _, _, packed, size, n_name, n_extra = struct.unpack("<IHHHHHIIIHH", source.read(30))
        name, extra = source.read(n_name).decode("utf-8" if flags & 0x800 else "cp437"), source.read(n_extra)
        at = 0
        while at + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, at)
            if kind == 1 and 0xFFFFFFFF in (packed, size):
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, at + 4))
                size = wide.pop(0) if size == 0xFFFFFFFF else size
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
            at += 4 + width
        if flags & 1 or method not in (0, 8) or (method == 0 and flags & 8):
            raise ValueError(f"{name}: encrypted, of method {method} or of unknown size")
        body = Stream(_stored(source, packed) if method == 0 else _deflated(source))
        yield name, body
        for _ in body.some():  # what the caller left
            pass
        if flags & 8:
            _skip_descriptor(source)


def _stored(source: Stream, n: int) -> Iterator[bytes]:
    while n > 0 and (data := source.read(min(n, CHUNK))):
        n -= len(data)
        yield data


def _deflated(source: Stream) -> Iterator[bytes]:
    d = zlib.decompressobj(-15)
    while not d.eof and (data := source.read(CHUNK)):
        yield d.decompress(data)
    source.put_back(d.unused_data)
    if not d.eof:
        raise EOFError("a member is cut off")


def _skip_descriptor(source: Stream) -> None:
    """Checksum and sizes after a member, of 4 or 8 bytes each and with a signature or not: what comes after them tells."""
    seen = source.peek(28)
    for n in (16, 24) if seen.startswith(b"PK\x07\x08") else (12, 20):
        if seen[n : n + 2] == b"PK":
            source.read(n)
            return
    raise ValueError("no header after a member")


def members_of(source: Stream) -> Iterator[tuple[str, Stream]]:
    """(name, content) of each file of a tar or zip archive; contents are to be read in turn, and are decompressed if the file is itself gzip, bzip2 or xz."""
    source = opened(source)
    if source.peek(4) in (b"PK\x03\x04", b"PK\x05\x06"):
        yield from ((n, opened(body)) for n, body in _zip_members(source) if not n.endswith("/"))
        return
    with tarfile.open(fileobj=source, mode="r|") as tar:
        for info in tar:
            if info.isfile():
                content = tar.extractfile(info)
                yield info.name, opened(Stream(iter(lambda content=content: content.read(CHUNK), b"")))


def _lines(body: Stream) -> Iterator[bytes]:
    rest: list[bytes] = []
    for data in body.some():
        first, *others = data.split(b"\n")
        rest.append(first)
        for nxt in others:
            yield b"".join(rest)
            rest = [nxt]
    if last := b"".join(rest):
        yield last


def _pieces(spark: SparkSession, archives: str | list[str]) -> DataFrame:
    """(archive, piece): the bytes of each archive between line feeds, in order, an archive in one partition."""
    paths = [archives] if isinstance(archives, str) else list(archives)
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("piece"))
    return raw.repartition(max(1, len(paths)), "archive").sortWithinPartitions("archive", "start", "nth").select("archive", "piece")


def _of_archives(pieces: DataFrame, read: Callable[[str, str, Stream], Iterator[tuple]], names: Iterable[str] | None, schema: str) -> DataFrame:
    """What ``read`` gives of each wanted member of each archive."""
    wanted = None if names is None else frozenset(names)
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        rows = ((a, p) for b in batches for a, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        held, size = [], 0
        row = next(rows, None)
        while row is not None:
            archive, first = row
            row = None

            def chunks():
                nonlocal row
                yield first
                for a, p in rows:
                    if a != archive:
                        row = (a, p)
                        return
                    yield b"\n" + p

            source = Stream(chunks())
            for name, body in members_of(source):
                if wanted is not None and name not in wanted:
                    continue
                for out in read(archive, name, body):
                    held.append(out)
                    size += len(out[-1])
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], fields)
                        held, size = [], 0
            for _ in source.some():  # to the next archive
                pass
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], fields)

    return pieces.mapInArrow(run, schema)


def archive_lines(spark: SparkSession, archives: str | list[str], names: Iterable[str] | None = None) -> DataFrame:
    """(archive, member, no, value): the lines of the members of these names, or of all; no counts from 0. Bytes that are no UTF-8 are replaced.

    Archives are tar or zip, also compressed by gzip, bzip2 or xz; members may be compressed so as well. Each is read once, as a stream in one task.
    """

    def read(archive, name, body):
        for no, line in enumerate(_lines(body)):
            yield archive, name, no, line.removesuffix(b"\r").decode("utf-8", "replace")

    return _of_archives(_pieces(spark, archives), read, names, "archive string, member string, no bigint, value string")


def archive_texts(spark: SparkSession, archives: str | list[str], names: Iterable[str] | None = None) -> DataFrame:
    """(archive, member, value): each member whole, for files that are one JSON value."""
    return _of_archives(_pieces(spark, archives), lambda a, n, body: iter([(a, n, body.read().decode("utf-8", "replace"))]), names, "archive string, member string, value string")
