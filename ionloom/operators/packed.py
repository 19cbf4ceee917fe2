"""Several values packed in one field: each field is parsed by its cheapest dialect.

A dialect says which characters separate values and how quotes are escaped; the candidates of a field are
the subsets of the punctuation it holds, with each way of quoting. The description length of a field under
a dialect is that of its separators plus that of its values. A value costs the cheaper of two codes: by its
number in the counts of values, with its own characters paid once for all its uses, or spelled out.

Counts are taken over the distinct fields, so redelivered and repeated fields say nothing twice. Two rounds:
first every candidate of a field counts alike, then only its cheapest one does; from the second round's
counts come the code lengths of the values and what each punctuation mark costs as a separator and inside a
value. Everything is counted and joined in parallel; to the driver come two numbers per punctuation mark.

Defined results: null fields and fields without any value give no rows; a quote that never closes takes
the rest of the field as its value; empty values are not counted; equal values of a field stay separate
rows, as do redelivered rows under their own id; position counts from 0; of dialects that cost the same the
one with more separators counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import release, sized_join, stored

#: Bits of an ordinary character (letters, digits, hyphen, dot, underscore: 64 symbols), of a value's end and of
#: a value that isn't by its number.
CHARACTER, END, SPELLED = 6.0, 3.0, 2.0
#: Bits of a punctuation mark as a separator and inside a value before anything was counted.
SEPARATOR, INSIDE = 2.0, 12.0
#: Marks up to which the candidates of a field, up to two to their power, are held at once; of fields with more they are made
#: twice, to be numbered and to be handed on, so that memory stays bounded.
HELD = 8
#: Candidates of a batch.
ROWS = 2_000
#: Characters that may separate values; blanks always do, as they never belong to an unquoted value.
SEPARATOR_CHARS = re.compile(r'[^\w.\-\s\[\]"]')
QUOTED_TEXT = re.compile(r'"[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"', re.S)
# Fixed value: a long accession is one value.
ACCESSION = r"(?:sp|tr)\|[^\W_][\w.\-]*\|[^\W_][\w.\-]*"
LONG = re.compile(rf"(?<!\w){ACCESSION}(?!\w)")
QUOTES = {
    "doubled": (r'"[^"]*+(?:""[^"]*+)*+"(?!\w)', lambda s: s.replace('""', '"')),
    "backslash": (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?!\w)', lambda s: re.sub(r"\\(.)", r"\1", s, flags=re.S)),
    "none": (None, None),  # of fields without a quote
}
ORDINARY = re.compile(r"[\w.\-]+")
#: Fields that are one plain value under any dialect.
PLAIN = r"^[A-Za-z0-9_.\-]+$"


class Dialect:
    def __init__(self, separators: str, quotes: str):
        quoted, self.unescape = QUOTES[quotes]
        stop = re.escape(separators) + r"\s\[\]"
        plain = rf"[^{stop}]+"
        self.token = re.compile("|".join([*([f"(?P<q>{quoted})"] if quoted else []), *([r'(?P<open>"[^"]*\Z)'] if quoted else []), rf"(?P<a>{ACCESSION})(?!\w)", f"(?P<p>{plain})"]), re.S)

    def parse(self, text: str) -> tuple[list[str], list[str], str]:
        """Values, the punctuation inside each unquoted one, and the separators in their order."""
        values, inside, gaps, at = [], [], [], 0
        for m in self.token.finditer(text):
            kind = m.lastgroup
            v = m.group()
            gaps.append(text[at : m.start()])
            at = m.end()
            if kind == "q":
                v = self.unescape(v[1:-1]).strip()
            elif kind == "open":
                v = v[1:].strip()
            if v:
                values.append(v)
                inside.append(ORDINARY.sub("", v) if kind == "p" else "")
        gaps.append(text[at:])
        return values, inside, "".join(SEPARATOR_CHARS.findall("".join(gaps)))


@lru_cache(maxsize=4096)
def dialect(separators: str, quotes: str) -> Dialect:
    return Dialect(separators, quotes)


def subsets(marks: str) -> Iterator[str]:
    """Candidate sets of separators, all there are, larger ones first."""
    return ("".join(c) for k in range(len(marks), -1, -1) for c in combinations(marks, k))


Parse = tuple[list[str], list[str], str]


def _marks(text: str) -> str:
    """The punctuation of ``text`` that may separate, outside quotes and accessions."""
    quoted = '"' in text
    loose = LONG.sub("", QUOTED_TEXT.sub("", text) if quoted else text)
    marks = "".join(sorted(set(SEPARATOR_CHARS.findall(loose))))
    return marks.replace("\\", "") if quoted else marks


def _differing(text: str, marks: str) -> Iterator[tuple[Parse, bool]]:
    """The parses of ``text`` that differ, more separators first, and whether none of their values has an enclosing quote."""
    quoted = '"' in text
    # A value in quotes is one value, so the ways differ in what a quote inside one looks like.
    quotes = (("doubled", "backslash") if "\\" in text else ("doubled",)) if quoted else ("none",)
    seen = set()
    for s in subsets(marks):
        for q in quotes:
            got = dialect(s, q).parse(text)
            key = blake2b("\0".join(f"{len(v)} {v}" for v in got[0]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                yield got, not (quoted and any(o and ('"' in (v[0], v[-1])) for v, o in zip(got[0], got[1])))


def candidates(text: str) -> tuple[int, Iterator[Parse]]:
    """The number of parses of ``text`` that differ, and these. Enclosing quotes are no part of a value: parses that
    leave some go if others don't."""
    marks = _marks(text)
    if len(marks) <= HELD:
        out = list(_differing(text, marks))
        clean = [p for p, c in out if c] or [p for p, _ in out]
        return len(clean), iter(clean)
    total = clean = 0
    for _, c in _differing(text, marks):
        total, clean = total + 1, clean + c
    return clean or total, (p for p, c in _differing(text, marks) if c or not clean)


def fields_of(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(row id, field name, text), one row per non-null field."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns])
    return rows.select(F.col(id_col).cast("long").alias("row_id"), F.explode(pairs).alias("f")).select("row_id", "f.field_name", "f.text").filter("text is not null")


#: 128 bits that stand for a text.
KEY = ("h1", "h2")


def _keyed(fields: DataFrame) -> DataFrame:
    return fields.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


def parses(texts: DataFrame) -> DataFrame:
    """(h1, h2, n, cand, values, inside, seps): every candidate parse of each text; n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_list = pa.list_(pa.string())
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("cand", pa.int32()), ("values", text_list), ("inside", text_list), ("seps", pa.string())])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return got

        for b in batches:
            for a, c, text in zip(*(x.to_pylist() for x in b.columns)):
                n, got = candidates(text)
                for i, (v, o, s) in enumerate(got):
                    rows.append((a, c, n, i, v, o, s))
                    if len(rows) >= ROWS:
                        yield batch()
        if rows:
            yield batch()

    return texts.select(*KEY, "text").mapInArrow(run, "h1 long, h2 long, n int, cand int, values array<string>, inside array<string>, seps string")


def _marks_cost(text: Column, costs: dict[str, float], unknown: float) -> Column:
    if not costs:
        return F.length(text) * unknown
    known = F.create_map(*[x for c, v in costs.items() for x in (F.lit(c), F.lit(v))])
    return F.when(text == "", 0.0).otherwise(F.aggregate(F.split(text, ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(known, c), F.lit(unknown))))


def cheapest(several: DataFrame, counted: DataFrame, as_separator: dict[str, float], inside: dict[str, float], value_codes: bool = True) -> DataFrame:
    """(h1, h2, _best): the candidate of least description length of every text.

    ``several`` has one row per value of a candidate; ``counted`` (value, w) is what code lengths come from."""
    marks = F.when(F.col("pos") == 0, _marks_cost(F.col("seps"), as_separator, SEPARATOR)).otherwise(0.0)
    lit = F.length("value") * CHARACTER + _marks_cost(F.col("odd"), {c: v - CHARACTER for c, v in inside.items()}, INSIDE - CHARACTER) + END
    several = several.select(*KEY, "cand", "value", F.coalesce(lit, F.lit(0.0)).alias("_lit"), marks.alias("_s"))
    cost = F.col("_lit") + SPELLED
    if value_codes:
        counts = stored(counted.groupBy("value").agg(F.sum("w").alias("uses")), total=F.sum("uses"))
        total = float(counts._il_seen["total"] or 1.0)
        several = sized_join(several, counts, ["value"])
        cost = F.least(cost, F.log2(F.greatest(F.lit(total) / F.col("uses"), F.lit(1.0))) + F.col("_lit") / F.col("uses"))
    cost = F.when(F.col("value").isNull(), 0.0).otherwise(cost) + F.col("_s")
    of_parse = several.groupBy(*KEY, "cand").agg(F.round(F.sum(cost), 6).alias("bits"))
    return of_parse.groupBy(*KEY).agg(F.min(F.struct("bits", "cand")).alias("b")).select(*KEY, F.col("b.cand").alias("_best"))


def mark_costs(chosen: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Bits of each punctuation mark as a separator and inside an unquoted value, from the chosen parses."""
    marks = lambda c, inside: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(x.alias("c"), F.lit(inside).alias("inside")))
    got = chosen.select(F.explode(F.concat(marks(F.col("seps"), 0), marks(F.array_join("inside", ""), 1))).alias("m")).groupBy("m.c").agg(F.count(F.lit(1)).alias("n"), F.sum("m.inside").alias("i")).collect()
    return {r.c: 1 - log2((r.n - r.i + 0.5) / (r.n + 1)) for r in got}, {r.c: CHARACTER - log2((r.i + 1 / 64) / (r.n + 1)) for r in got}


def _exploded(cands: DataFrame) -> DataFrame:
    """A row per value of a parse; parses without any have one row with a null value."""
    return cands.select(*KEY, "n", "cand", "seps", F.posexplode_outer(F.arrays_zip("values", "inside")).alias("pos", "x")).select(*KEY, "n", "cand", "seps", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("x.values").alias("value"), F.col("x.inside").alias("odd"))


def dialects(fields: DataFrame, value_codes: bool = True) -> DataFrame:
    """(h1, h2, values): the distinct fields that aren't plain, each parsed by its cheapest dialect."""
    texts = stored(fields.select("text").distinct())
    cands = stored(parses(_keyed(texts.filter(~F.col("text").rlike(PLAIN)))))
    several = cands.filter("n > 1")
    # Values that no choice changes are counted once.
    sure = texts.filter(F.col("text").rlike(PLAIN)).select(F.col("text").alias("value")).unionByName(cands.filter("n = 1").select(F.explode("values").alias("value")))
    sure = stored(sure.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("w")))
    values = _exploded(several)
    first = stored(cheapest(values, values.filter("value is not null").select("value", (1.0 / F.col("n")).alias("w")).unionByName(sure), {}, {}, value_codes))
    chosen = sized_join(several, first, [*KEY], "inner").filter("cand = _best")
    best = stored(cheapest(values, chosen.select(F.explode("values").alias("value"), F.lit(1.0).alias("w")).unionByName(sure), *mark_costs(chosen.drop("_best").unionByName(cands.filter("n = 1"))), value_codes))
    out = stored(sized_join(cands, best, [*KEY]).filter("n = 1 or cand = _best").select(*KEY, "values"))
    release(fields.sparkSession, texts, cands, sure, first, best)
    return out


def unpack(rows: DataFrame, id_col: str, columns: list[str], value_codes: bool = True) -> DataFrame:
    """(row_id, field_name, item_pos, item_value): every field parsed by its cheapest dialect.

    ``value_codes`` False leaves only the spelled-out code, for comparison."""
    fields = fields_of(rows, id_col, columns)
    parsed = dialects(fields, value_codes)
    single = fields.filter(F.col("text").rlike(PLAIN)).select("row_id", "field_name", F.lit(0).alias("item_pos"), F.col("text").alias("item_value"))
    packed = _keyed(fields.filter(~F.col("text").rlike(PLAIN))).drop("text")
    several = sized_join(packed, parsed, [*KEY], "inner").select("row_id", "field_name", F.posexplode("values").alias("item_pos", "item_value"))
    return single.unionByName(several)
