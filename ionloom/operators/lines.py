"""Text lines to loadable transitions and rejected lines with reasons.

For every header one anchored pattern for a whole row is generated; a row it matches is loadable. Every
other row goes through the prefix patterns of the same schema, each of which extends the one before by
one field, up to the first field that breaks; from there on the fields are tried one by one for the
reasons that apply.

Defined results: null lines and lines of only blanks are no data; a file whose line 1 is missing or null
has a header of no fields, so each of its lines breaks ``column_count``; a quoted value counts without
its enclosing quotes and with doubled quotes halved; if a header names a checked column twice, each is
checked and a reason is given once; a header without a checked column has no such check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import sized_join

# The columns that are checked, in the order of their reasons, and what they may hold.
CHECKS = {
    "FragmentType": ("fragment_type", r"[abcxyz]"),
    "FragmentCharge": ("fragment_charge", r"0*(?:[1-9]|[1-9][0-9]|1[01][0-9]|12[0-7])"),
    "FragmentLossType": ("fragment_loss_type", r"noloss|H2O|NH3|CO|H3PO4|CH4OS"),
}
# Names of the same column in the two dialects.
ALIASES = {
    "modified": ("ModifiedPeptide",),
    "stripped": ("StrippedPeptide", "PeptideSequence"),
    "precursor_mz": ("PrecursorMz",),
    "charge": ("PrecursorCharge",),
    "rt_min": ("Tr_recalibrated",),
    "mobility": ("IonMobility",),
    "protein": ("ProteinID", "ProteinGroup"),
    "decoy": ("Decoy", "decoy"),
    "frag_mz": ("FragmentMz", "ProductMz"),
    "frag_type": ("FragmentType",),
    "frag_num": ("FragmentNumber", "FragmentSeriesNumber"),
    "frag_charge": ("FragmentCharge",),
    "loss": ("FragmentLossType",),
    "rel_int": ("RelativeIntensity", "LibraryIntensity"),
}
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'(?!")[^\t]*+'
FIELD = re.compile(rf"(?:{QUOTED}|{PLAIN})(?=\t|\Z)")
BOM = chr(0xFEFF)
OUT = "line_id long, status string, first_broken int, reasons array<string>, values array<string>"
OUT_ARROW = pa.schema([("line_id", pa.int64()), ("status", pa.string()), ("first_broken", pa.int32()), ("reasons", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])


def _value(raw: str) -> str:
    return raw[1:-1].replace('""', '"') if raw[:1] == '"' else raw


class Schema:
    """The patterns generated from one header."""

    def __init__(self, header: str | None):
        self.text = header
        self.names = [] if header is None else [_value(x) for x in header.split("\t")]
        self.column = {canon: next((i for i, n in enumerate(self.names) if n in alias), None) for canon, alias in ALIASES.items()}
        fields = []
        for name in self.names:
            if name in CHECKS:
                fields.append(rf'(?:"(?:{CHECKS[name][1]})"|(?:{CHECKS[name][1]}))(?=\t|\Z)')
            else:
                fields.append(FIELD.pattern)
        self.row = re.compile(r"\t".join(fields) + r"\Z") if fields else None
        # The i-th prefix pattern is the i-th field's, tried where the prefix before it ended.
        self.strict = [re.compile(f) for f in fields]

    def broken(self, line: str) -> tuple[int, list[str]]:
        """The first field that breaks and every reason that applies."""
        at, i, first, reasons = 0, 0, None, []
        while True:
            strict = self.strict[i].match(line, at) if i < len(self.strict) else None
            m = strict or FIELD.match(line, at)
            if not strict and first is None:
                first = i
            if m is None:
                return first, ["quoting"]
            if not strict and i < len(self.strict):
                reasons.append(CHECKS[self.names[i]][0])
            at, i = m.end(), i + 1
            if at == len(line):
                break
            at += 1
        if i != len(self.names):
            return (min(i, len(self.names)) if first is None else first), ["column_count"]
        return first, [r for r, _ in CHECKS.values() if r in reasons]


@lru_cache(maxsize=4096)
def schema_of(header: str | None) -> Schema:
    return Schema(header)


def _line(raw: str) -> str:
    """Without the line end's carriage return."""
    return raw[:-1] if raw.endswith("\r") else raw


def _judge(line_id, line_no, raw, header, with_values: bool):
    if raw is None or line_no == 1:
        return None
    line = _line(raw)
    if not line or line.isspace() and "\t" not in line:
        return None
    schema = schema_of(None if header is None else _line(header).removeprefix(BOM))
    if schema.text is not None and line.removeprefix(BOM) == schema.text:
        return None
    if schema.row is not None and schema.row.match(line):
        values = None
        if with_values:
            found = [_value(m.group()) for m in FIELD.finditer(line)] if '"' in line else line.split("\t")
            if len(found) != len(schema.names):
                found, at = [], 0
                for _ in schema.names:
                    m = FIELD.match(line, at)
                    found.append(_value(m.group()))
                    at = m.end() + 1
            values = [None if i is None else found[i] for i in schema.column.values()]
        return line_id, "loaded", None, None, values
    first, reasons = schema.broken(line)
    return line_id, "rejected", first, reasons, None


def parse_lines(lines: DataFrame, keep: tuple[str, ...] = ("loaded", "rejected")) -> DataFrame:
    """One row per data line: status, the first broken field's place, the reasons, and the canonical values.

    Lines meet their file's header in a join whose header side is broadcast if its measured size allows,
    else copied under salts; a file that holds a third of all lines is never read by one task."""
    lines = lines.select(F.col("line_id").cast("long"), "file_name", F.col("line_no").cast("int"), F.col("raw_line").cast("string"))
    headers = lines.filter("line_no = 1 and file_name is not null").groupBy("file_name").agg(F.max("raw_line").alias("header"))
    joined = sized_join(lines.filter("line_no is null or line_no <> 1"), headers, ["file_name"]).select("line_id", "line_no", "raw_line", "header")
    wanted = frozenset(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for x in zip(*(c.to_pylist() for c in b.columns)) if (r := _judge(*x, "loaded" in wanted)) and r[1] in wanted]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), OUT_ARROW)], schema=OUT_ARROW)

    return joined.mapInArrow(run, OUT)


def rejected(lines: DataFrame) -> DataFrame:
    """One row per reason of a rejected line."""
    return parse_lines(lines, ("rejected",)).select("line_id", F.explode("reasons").alias("reason"))


def transitions(lines: DataFrame) -> DataFrame:
    """The loadable lines as typed transitions; text that is no number in a numeric column is null."""
    types = {"precursor_mz": "double", "charge": "int", "rt_min": "double", "mobility": "double", "decoy": "int", "frag_mz": "double", "frag_num": "int", "frag_charge": "int", "rel_int": "float"}
    cols = [(f"try_cast(values[{i}] as {types[c]})" if c in types else f"values[{i}]") + f" as {c}" for i, c in enumerate(ALIASES)]
    return parse_lines(lines, ("loaded",)).selectExpr("line_id", *cols)
