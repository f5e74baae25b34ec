"""Media columns: content-addressed payloads in tar shards.

Each task appends its payloads, stored losslessly as grey 8-bit PNG pictures that are 64 samples
wide, to tar shards of its own in the shared folder. A row keeps the payload's SHA-256 (its address
and its name in the shard), the shard, and the offset and length of the stored bytes. Metadata
columns come from range reads of the header's 33 bytes; features read the stored bytes back.

A shard's name is unique to the attempt that wrote it, so a repeated attempt never touches another's
shard, and rows only ever name shards of attempts that ended well; ``vacuum`` deletes the others.
Equal payloads of a task are stored once.

Defined cases: a null text counts as empty, whose payload is 64 zero bytes; repeated rows share one
stored payload; null ids stay; an empty table makes no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import importable, map_slices, shared_dir, stored

#: Samples in a picture's row; payloads are padded to a multiple of it.
WIDTH = 64
#: A shard is closed when it holds so many bytes; a worker remembers so many addresses at most.
SHARD_BYTES, REMEMBERED = 64 << 20, 100_000
#: The bytes that a header-only read takes: signature and IHDR chunk.
HEADER_BYTES = 33
LEVEL = 1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded UTF-8 bytes of a text, and their number before padding."""
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """``data`` (a positive multiple of WIDTH bytes) as a grey 8-bit picture."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> dict[str, int]:
    """Metadata from a picture's first HEADER_BYTES bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a stored picture")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def from_png(data: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made."""
    width = header(data)["width"]
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


class Shards:
    """Tar shards below ``uri`` that one task attempt writes."""

    def __init__(self, uri: str) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(uri)
        self.out, self.name, self.at = None, "", 0
        self.places: dict[str, tuple[str, int, int]] = {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """(shard, offset, length) of the stored form of ``data``."""
        if digest in self.places:
            return self.places[digest]
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        picture = to_png(data)
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(picture)
        self.out.write(member.tobuf(tarfile.USTAR_FORMAT) + picture + bytes(-len(picture) % 512))
        if len(self.places) >= REMEMBERED:
            self.places.clear()
        place = self.places[digest] = (self.name, self.at + 512, len(picture))
        self.at += 512 + len(picture) + -len(picture) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


class Reader:
    """Range reads from shards; a few stay open."""

    def __init__(self, uri: str) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(uri)
        self.open: OrderedDict[str, pyarrow.NativeFile] = OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= 8:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = self.fs.open_input_file(f"{self.folder}/{shard}")
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Stores the payload of every row. Returns (id_col, digest, n_bytes, shard, offset, length), a
    table in the shared folder, and the shards' folder."""
    importable(spark)
    uri = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shards = Shards(uri)
        try:
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    rows = []
                    for text in batch.column(1).to_pylist():
                        data, n = payload(text)
                        digest = hashlib.sha256(data).hexdigest()
                        rows.append((digest, n, *shards.add(digest, data)))
                    columns = zip(*rows, strict=True)
                    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "digest", "n_bytes", "shard", "offset", "length"])
        finally:
            shards.close()

    rows = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, digest string, n_bytes long, shard string, offset long, length long")
    return stored(spark, rows, "catalogue"), uri


def places(catalogue: DataFrame) -> DataFrame:
    """One place for each digest, the first by shard and offset."""
    return catalogue.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def metadata(catalogue: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, digest, width, height, bit_depth, colour_type), from header-only range reads."""
    id_type = catalogue.schema[id_col].dataType.simpleString()

    def make():
        reader = Reader(folder)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            names = ["width", "height", "bit_depth", "colour_type"]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[n] for f in found], pa.int64()) for n in names)], names=[id_col, "digest", *names])

        return work

    return map_slices(catalogue.select(id_col, "digest", "shard", "offset"), make, f"`{id_col}` {id_type}, digest string, width long, height long, bit_depth long, colour_type long")


def _feature(data: bytes) -> str:
    """Length, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, values = len(data), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ values**2) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"{WIDTH}x{n // WIDTH} mean={mean:.6f} deviation={deviation:.6f} entropy={float(-(p * np.log2(p)).sum()):.6f}"


def read_back(catalogue: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Sizes, digests and features of every row's stored bytes. A payload that has just been read
    isn't read again for the next rows that share it."""
    id_type = catalogue.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def make():
        reader = Reader(folder)
        recent: OrderedDict[tuple[str, int], tuple] = OrderedDict()

        def measure(shard: str, offset: int, length: int) -> tuple:
            if (shard, offset) not in recent:
                head = header(reader.read(shard, offset, HEADER_BYTES))
                media = reader.read(shard, offset, length)
                data = from_png(media)
                if len(recent) >= 4096:
                    recent.popitem(last=False)
                recent[shard, offset] = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), _feature(data), head["width"], head["height"])
            return recent[shard, offset]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(*place) for place in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "n_bytes", *names])

        return work

    schema = f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
    return map_slices(catalogue.select(id_col, "n_bytes", "shard", "offset", "length"), make, schema)


def vacuum(catalogue: DataFrame, folder: str) -> int:
    """Deletes shards that no row of the catalogue names; returns their number. The driver reads the
    names of shards, one for each SHARD_BYTES of stored payloads."""
    used = {r[0] for r in catalogue.select("shard").distinct().collect()}
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    stray = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if f.base_name not in used]
    for p in stray:
        fs.delete_file(p)
    return len(stray)
