"""Binary spectral libraries: little-endian sections, read from their bytes in one pass per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ion series by code; c-terminal ones count from the other end.
SERIES = {1: "b", 2: "y", 3: "a", 4: "x", 5: "c", 6: "z"}
C_TERMINAL = {"x", "y", "z"}
OLDEST, FRAGMENT = -3, struct.Struct("<ffBBBB")


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        s = struct.Struct("<" + fmt)
        if self.at + s.size > len(self.data):
            raise ValueError("the library ends within a record")
        got = s.unpack_from(self.data, self.at)
        self.at += s.size
        return got[0] if len(got) == 1 else got

    def skip(self, n: int) -> None:
        self.at += n
        if n < 0 or self.at > len(self.data):
            raise ValueError("the library ends within a record")

    def text(self) -> str:
        n = self.take("i")
        a = self.at
        self.skip(n)
        return self.data[a : self.at].decode("latin-1")

    def texts(self) -> list[str]:
        return [self.text() for _ in range(self.take("i"))]


def _peptide(c: Cursor, version: int) -> tuple:
    size = 36 if version <= -2 else 24
    head = c.data[c.at : c.at + size]
    c.skip(size)
    charge, length = struct.unpack_from("<ii", head, 4)
    mz, irt = struct.unpack_from("<ff", head, 12)
    mobility = struct.unpack_from("<f", head, 28)[0] if version <= -2 else 0.0
    n = c.take("i")
    a = c.at
    c.skip(12 * n)
    return charge, length, mz, irt, mobility, c.data[a : c.at]


def _fragments(raw: bytes, length: int) -> list[tuple[str, float, float]]:
    """(label, mz, height); losses go, of one ion the highest stays."""
    best: dict[str, tuple[float, float]] = {}
    for mz, height, charge, kind, index, loss in FRAGMENT.iter_unpack(raw):
        series = SERIES.get(kind & 0x7F)
        if loss or series is None:
            continue
        ordinal = length - index if series in C_TERMINAL else index
        label = f"{series}{ordinal}" + (f"^{charge}" if charge > 1 else "")
        if label not in best or height > best[label][1]:
            best[label] = (mz, height)
    return [(k, *v) for k, v in best.items()]


def decode(data: bytes) -> Iterator[tuple]:
    """(name, protein, charge, precursor_mz, irt, mobility, fragments) of the targets."""
    c = Cursor(data)
    first = c.take("i")
    version = min(first, 0)
    if version < OLDEST:
        raise ValueError(f"library version {version} is not known")
    if version < 0:
        c.take("i")
    c.take("ii")
    c.text(), c.text()
    for _ in range(c.take("i")):
        c.take("i")
        size = c.take("i")
        c.text(), c.text(), c.text()
        c.take("ii")
        c.skip(4 * size)
    groups = []
    for _ in range(c.take("i")):
        size = c.take("i")
        ids = c.text()
        c.text(), c.text()
        for _ in range(3):
            c.skip(4 * c.take("i"))
        c.skip(4 * size)
        groups.append(ids)
    for _ in range(3):
        c.texts()
    c.take("dd")
    for _ in range(c.take("i")):
        charge, length, mz, irt, mobility, raw = _peptide(c, version)
        if c.take("i"):
            _peptide(c, version)
        _, _, pid = c.take("iii")
        name = c.text()
        if version <= -3:
            c.skip(12)
        yield name, groups[pid] if 0 <= pid < len(groups) else None, charge, mz, irt, mobility, _fragments(raw, length)
    if version <= -1:
        c.skip(4 * c.take("i"))
    if c.at != len(data):
        raise ValueError("bytes are left over after the library's last section")


SCHEMA = "file string, group_id long, modified string, protein string, charge int, precursor_mz double, rt_seconds double, mobility double, fragments array<struct<label:string,mz:double,intensity:float>>"


def read_speclib(spark: SparkSession, path: str) -> DataFrame:
    """One task per file: records have no index and are found one after the other. The indexed retention
    time stays as it is; embedded decoys go."""
    return read_packed(spark.read.format("binaryFile").load(path).select("path", "content"))


def read_packed(files: DataFrame) -> DataFrame:
    """The same from a table of (name, content)."""
    frag = pa.list_(pa.struct([("label", pa.string()), ("mz", pa.float64()), ("intensity", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block: list[tuple] = []
                for i, r in enumerate(decode(data)):
                    block.append((name, i, r[0], r[1], r[2], r[3], r[4], r[5], [{"label": x, "mz": y, "intensity": z} for x, y, z in r[6]]))
                    if len(block) == 10_000:
                        yield _batch(block, frag)
                        block = []
                if block:
                    yield _batch(block, frag)

    return files.mapInArrow(run, SCHEMA)


def _batch(block: list[tuple], frag: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), frag]
    names = [f.split(" ")[0] for f in ("file string", "group_id", "modified", "protein", "charge", "precursor_mz", "rt_seconds", "mobility", "fragments")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*block), types)], names=names)


def encode(entries: list[tuple], groups: list[str], version: int = -3) -> bytes:
    """A library of (name, group index, charge, length, mz, irt, mobility, [(mz, height, charge, kind, index,
    loss)], decoy or None): what ``decode`` reads, for round trips."""
    out = bytearray()
    i32 = lambda *v: out.extend(struct.pack(f"<{len(v)}i", *v))

    def text(s: str) -> None:
        b = s.encode("latin-1")
        i32(len(b))
        out.extend(b)

    def peptide(charge, length, mz, irt, mobility, frags) -> None:
        head = bytearray(36 if version <= -2 else 24)
        struct.pack_into("<ii", head, 4, charge, length)
        struct.pack_into("<ff", head, 12, mz, irt)
        if version <= -2:
            struct.pack_into("<f", head, 28, mobility)
        out.extend(head)
        i32(len(frags))
        for f in frags:
            out.extend(FRAGMENT.pack(*f))

    if version < 0:
        i32(version)
    i32(0, 1, 0)
    text("lib"), text("fasta")
    i32(0, len(groups))
    for g in groups:
        i32(0)
        text(g), text(""), text("")
        i32(0, 0, 0)
    i32(0, 0, 0)
    out.extend(struct.pack("<dd", 0.0, 100.0))
    i32(len(entries))
    for name, pid, charge, length, mz, irt, mobility, frags, decoy in entries:
        peptide(charge, length, mz, irt, mobility, frags)
        i32(1 if decoy else 0)
        if decoy:
            peptide(charge, length, mz, irt, mobility, frags)
        i32(0, 1, pid)
        text(name)
        if version <= -3:
            out.extend(bytes(12))
    if version <= -1:
        i32(0)
    return bytes(out)


def file_count(df: DataFrame) -> DataFrame:
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("n_groups"))
