"""A Spark data source of length-framed binary records, streamed from local or remote files.

Options:
  path    a file, a folder, or a folder and a name pattern (`/blocks/blk*.dat`); any URI that pyarrow knows (file, hdfs, s3)
  magic   hex of the bytes before each length (empty: none)
  key     hex of an XOR pad that repeats by file offset (empty: none); used for files that start with the magic under the pad
  zstd    true: each file is one zstd stream
  counted true: a 64-bit count comes first, and a file with another number of records is an error
  resync  true: a record whose length is out of range ends at the next magic; false: it ends the file
  least, most   bytes of a record
  missing warn (or nothing): a number of a file between two others that is not there gives a row that says so (`corrupt`)
  per_file, start, limit   records of each numbered file (`..._7...`), first height and number of heights: other files are not opened
A record is magic, its length (32 bits, little-endian), its bytes. A wrong magic or a cut record ends the file; what was read before stands, and a last row
without payload says what was wrong (`corrupt`). A file is held as one record and a read buffer, never whole.
"""

from __future__ import annotations

import fnmatch
import io
import re
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUFFER = 1 << 20
#: Bytes of a file that can hold a record: shorter ones in a folder are left out, before any is opened.
LEAST_FILE = 8


def xor(data: bytes, key: bytes, offset: int = 0) -> bytes:
    """data under the pad, whose first byte belongs to file offset 0."""
    import numpy as np

    at = offset % len(key)
    pad = np.frombuffer((key * (len(data) // len(key) + 2))[at : at + len(data)], np.uint8)
    return (np.frombuffer(data, np.uint8) ^ pad).tobytes()


def encode_frames(records, magic: bytes = b"", key: bytes = b"", counted: bool = False) -> bytes:
    records = list(records)
    out = (struct.pack("<Q", len(records)) if counted else b"") + b"".join(magic + struct.pack("<I", len(r)) + r for r in records)
    return xor(out, key) if key else out


class _Bytes:
    """Reads ahead of a stream, under a pad where there is one."""

    def __init__(self, stream, key: bytes):
        self.stream, self.key, self.have, self.at, self.read = stream, key, b"", 0, 0

    def peek(self, n: int) -> bytes:
        while len(self.have) - self.at < n:
            more = self.stream.read(max(BUFFER, n - len(self.have) + self.at))
            if not more:
                break
            if self.key:
                more, self.read = xor(more, self.key, self.read), self.read + len(more)
            self.have, self.at = self.have[self.at :] + more, 0
        return self.have[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def until(self, magic: bytes) -> bytes:
        """All before the next magic, or to the end."""
        out = bytearray()
        while True:
            block = self.peek(BUFFER)
            hit = block.find(magic)
            if hit >= 0:
                out += self.take(hit)
                return bytes(out)
            last = len(block) < BUFFER
            out += self.take(len(block) if last else len(block) - len(magic) + 1)
            if last:
                return bytes(out)


def decode_stream(stream, magic: bytes = b"", key: bytes = b"", least: int = 0, most: int = 32 << 20, counted: bool = False, resync: bool = False):
    """(number, payload, None) for each record; at the end of a damaged stream (number, None, what was wrong)."""
    if key and magic:
        head = stream.read(len(magic))
        stream = _Chain(head, stream)
        if head == magic:
            key = b""
    src, n, want = _Bytes(stream, key), 0, None
    if counted:
        head = src.take(8)
        if len(head) < 8:
            raise ValueError("no record count")
        want = struct.unpack("<Q", head)[0]
    wrong = None
    while src.peek(1):
        if src.take(len(magic)) != magic:
            wrong = "magic"
            break
        head = src.take(4)
        if len(head) < 4:
            wrong = "cut"
            break
        size = struct.unpack("<I", head)[0]
        if not least <= size <= most:
            if not (resync and magic):
                wrong = "length"
                break
            payload = src.until(magic)
        else:
            payload = src.take(size)
            if len(payload) < size:
                wrong = "cut"
                break
        yield n, payload, None
        n += 1
    if want is not None and want != n:
        raise ValueError(f"{want} records announced, {n} found")
    if wrong:
        yield n, None, wrong


class _Chain:
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n)


def decode_frames(data: bytes, magic: bytes = b"", key: bytes = b"", least: int = 0, most: int = 32 << 20, **more):
    for n, payload, wrong in decode_stream(io.BytesIO(data), magic, key, least, most, **more):
        if not wrong:
            yield n, payload


def filesystem(path: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Files of a path in order of name; hidden ones are left out."""
    from pyarrow import fs

    where, at = filesystem(path)
    prefix = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
    folder, _, name = at.rstrip("/").rpartition("/")
    if not re.search(r"[*?\[]", name):
        info = where.get_file_info(at)
        if info.type == fs.FileType.File:
            return [prefix + at]
        folder, name = at.rstrip("/"), "*"
    found = where.get_file_info(fs.FileSelector(folder or "/"))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.size >= LEAST_FILE and fnmatch.fnmatch(f.base_name, name) and f.base_name[0] not in "._")


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return "file string, record long, height long, payload binary, corrupt string"

    def reader(self, schema):
        return FrameReader(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def _range(self):
        o = self.options
        per_file, start = int(o.get("per_file", 0)), int(o.get("start", 0))
        return per_file, start, start + int(o["limit"]) if "limit" in o else None

    def partitions(self):
        per_file, start, stop = self._range()
        out = []
        for f in listed(self.options["path"]):
            number = re.search(r"_(\d+)\D*$", f.rsplit("/", 1)[-1])
            first = int(number[1]) * per_file if per_file and number else None
            if per_file and (first is None or first + per_file <= start or (stop is not None and first >= stop)):
                continue
            out.append(InputPartition((f, first)))
        if per_file and self.options.get("missing") == "warn":
            have = {p.value[1] // per_file for p in out}
            out += [InputPartition((None, n * per_file)) for n in range(min(have, default=0), max(have, default=-1)) if n not in have]
        return out

    def read(self, partition):
        o, (path, first) = self.options, partition.value
        per_file, start, stop = self._range()
        if path is None:
            yield None, None, first, None, "missing"
            return
        where, at = filesystem(path)
        with where.open_input_stream(at, compression=None) as stream:
            if o.get("zstd", "false") == "true":
                import zstandard

                stream = zstandard.ZstdDecompressor().stream_reader(stream)
            more = {k: o.get(k, "false") == "true" for k in ("counted", "resync")}
            for n, payload, wrong in decode_stream(stream, bytes.fromhex(o.get("magic", "")), bytes.fromhex(o.get("key", "")), int(o.get("least", 0)), int(o.get("most", 32 << 20)), **more):
                height = None if first is None else first + n
                if height is not None and stop is not None and height >= stop:
                    return
                if height is None or height >= start:
                    yield path.rsplit("/", 1)[-1], n, height, payload, wrong
