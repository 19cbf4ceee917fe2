"""Native libraries (lines of JSON or packed records, plain or compressed), sequences and peptide lists."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import shred


class Packed:
    """A reader and writer of the packed object format's types that libraries use."""

    FIXED = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    SIZED = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "arr"), 0xDD: (">I", "arr"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}

    @classmethod
    def read(cls, f: io.BufferedIOBase):
        tag = f.read(1)
        if not tag:
            raise EOFError
        t = tag[0]
        if t < 0x80:
            return t
        if t >= 0xE0:
            return t - 256
        if t in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[t]
        if t in cls.FIXED:
            s = struct.Struct(cls.FIXED[t])
            return s.unpack(f.read(s.size))[0]
        if t < 0x90:
            n, kind = t & 15, "map"
        elif t < 0xA0:
            n, kind = t & 15, "arr"
        elif t < 0xC0:
            n, kind = t & 31, "str"
        elif t in cls.SIZED:
            fmt, kind = cls.SIZED[t]
            n = struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]
        else:
            raise ValueError(f"tag {t:#x} is not used in libraries")
        if kind == "str":
            return f.read(n).decode()
        if kind == "bin":
            return f.read(n)
        if kind == "arr":
            return [cls.read(f) for _ in range(n)]
        return {cls.read(f): cls.read(f) for _ in range(n)}

    @classmethod
    def write(cls, o) -> bytes:
        if o is None or isinstance(o, bool):
            return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[o]
        if isinstance(o, int):
            return bytes([o]) if 0 <= o < 128 else b"\xd3" + struct.pack(">q", o)
        if isinstance(o, float):
            return b"\xcb" + struct.pack(">d", o)
        if isinstance(o, str):
            b = o.encode()
            return b"\xdb" + struct.pack(">I", len(b)) + b
        if isinstance(o, (list, tuple)):
            return b"\xdd" + struct.pack(">I", len(o)) + b"".join(map(cls.write, o))
        return b"\xdf" + struct.pack(">I", len(o)) + b"".join(cls.write(k) + cls.write(v) for k, v in o.items())


def _open(path: str, data: bytes) -> io.BufferedIOBase:
    if path.endswith((".zst", ".zstd")):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)))
    return io.BytesIO(data)


def elements(path: str, data: bytes) -> Iterator[str]:
    """The library elements of a file as JSON texts; the kind is told by the name."""
    f = _open(path, data)
    if "msgpack" in path.rsplit("/", 1)[-1]:
        while True:
            try:
                o = Packed.read(f)
            except EOFError:
                return
            yield from map(json.dumps, o if isinstance(o, list) else [o])
    for line in io.TextIOWrapper(f, "utf-8"):
        if line.strip():
            yield line.strip()


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables (see the shredding operator). Plain lines are read by Spark and split at will;
    packed or compressed files take a task each. A group whose arrays differ in length has a null
    n_fragments; ``check_native`` fails on it."""
    if path.endswith((".ndjson", ".jsonl")):
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("record_id"), F.col("value").alias("payload"))
        return shred.shred(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block: list[str] = []
                for x in elements(p, data):
                    block.append(x)
                    if len(block) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(block)], names=["payload"])
                        block = []
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], names=["payload"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "payload string").withColumn("record_id", F.monotonically_increasing_id())
    return shred.shred(rows)


def check_native(rows: DataFrame) -> DataFrame:
    """Fails when a group's arrays differ in length or a record could not be read."""
    bad = (F.col("kind") == "reject") | ((F.col("kind") == "group") & F.col("n_fragments").isNull())
    return rows.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("record "), F.col("record_id").cast("string")))).otherwise(F.col("kind")))


def pack_elements(objects: list[dict], compress: bool = True) -> bytes:
    """A packed library file of a bounded list of elements."""
    raw = b"".join(map(Packed.write, objects))
    if not compress:
        return raw
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, description, sequence): records are split at ``>``, so a file is read by many tasks;
    lines of a sequence are joined, blank ones skipped."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>", "").alias("value")).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("protein_id"), head.alias("description"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))


def read_peptide_list(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line, trimmed; blank lines and those that start with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("peptide")).filter((F.col("peptide") != "") & ~F.col("peptide").startswith("#"))
