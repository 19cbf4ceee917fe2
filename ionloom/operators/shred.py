"""Nested records to flat tables, routed by structural variant.

A bottom-up tree automaton gives every JSON node a state from the states of its children. The state of
a group names its variant (parallel arrays or fragment objects, labels as text, as objects, mixed or
absent); each variant is read by its own routine into a typed subtype table, and all variants share the
keys record_id, element_pos, group_pos, fragment_pos.

Defined results: a null, empty, cut or otherwise unreadable payload gives one ``reject`` row and nothing
else; NaN and Infinity are no JSON; a repeated key counts once, with its last value; JSON inside a JSON
string is read as if it stood there; members that are no element or group keep their position but give
no rows; a null label in an otherwise labelled group is its position; redelivered payloads are separate
records. Only ``record_id`` and ``payload`` are read, so other columns may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import stored

# Field names the formats use for the same thing.
MZ_NAMES = ("fragment_mzs", "fragment_mz", "fragment_mono_mzs")
INTENSITY_NAMES = ("fragment_intensities", "fragment_intensity")
LABEL_NAMES = ("fragment_labels", "fragment_label")
MOBILITY_NAMES = ("mobility_ook0", "mobility")
PRECURSOR_MZ_NAMES = ("precursor_mz", "precursor_mono_mz")

ROW_SCHEMA = (
    "kind string, shape string, record_id long, element_pos int, group_pos int, fragment_pos int, "
    "sequence string, charge int, decoy boolean, decoy_group long, "
    "eg_id long, precursor_mz double, mobility_ook0 double, rt_seconds double, n_fragments int, "
    "fragment_label string, fragment_mz double, fragment_intensity double"
)
ARROW_SCHEMA = pa.schema(
    [("kind", pa.string()), ("shape", pa.string()), ("record_id", pa.int64()), ("element_pos", pa.int32()), ("group_pos", pa.int32()), ("fragment_pos", pa.int32())]
    + [("sequence", pa.string()), ("charge", pa.int32()), ("decoy", pa.bool_()), ("decoy_group", pa.int64())]
    + [("eg_id", pa.int64()), ("precursor_mz", pa.float64()), ("mobility_ook0", pa.float64()), ("rt_seconds", pa.float64()), ("n_fragments", pa.int32())]
    + [("fragment_label", pa.string()), ("fragment_mz", pa.float64()), ("fragment_intensity", pa.float64())]
)

GROUP_STATES = frozenset({"group_parallel_text", "group_parallel_object", "group_parallel_mixed", "group_parallel_bare", "group_fragments", "group_empty"})
#: Transitions of arrays: the first entry whose set covers the children's states.
ARRAY_RULES = (
    (frozenset(), "empty"),
    (frozenset({"num", "null"}), "nums"),
    (frozenset({"text", "null"}), "texts"),
    (frozenset({"label", "null"}), "labels"),
    (frozenset({"text", "label", "null"}), "mixed_labels"),
    (frozenset({"fragment"}), "fragments"),
    (GROUP_STATES | {"null"}, "groups"),
    (frozenset({"element", "null"}), "elements"),
)
LABEL_STATE = {"texts": "text", "labels": "object", "mixed_labels": "mixed", "empty": "text"}
#: Under this key an object keeps its state, so that it is classified once; no JSON key is an object.
STATE = object()
LEAF = {type(None): "null", bool: "bool", int: "num", float: "num"}


def _no_constant(name: str):
    raise ValueError(name)


def _named(o: dict, names: tuple[str, ...]):
    """The first of ``names`` whose value isn't null."""
    for n in names:
        if o.get(n) is not None:
            return n
    return None


def classify(value):
    """(state, value), with embedded JSON strings replaced by what they hold."""
    kind = LEAF.get(type(value))
    if kind:
        return kind, value
    if isinstance(value, str):
        if value[:1] in "{[" and value:
            try:
                return classify(json.loads(value, parse_constant=_no_constant))
            except ValueError:
                pass
        return "text", value
    if isinstance(value, list):
        if set(map(type, value)) <= {int, float}:
            return ("nums" if value else "empty"), value
        pairs = [classify(x) for x in value]
        states = {s for s, _ in pairs}
        for allowed, state in ARRAY_RULES:
            if states <= allowed:
                return state, [v for _, v in pairs]
        if "element" in states:
            return "elements", [v for _, v in pairs]
        if states & GROUP_STATES:
            return "groups", [v for _, v in pairs]
        return "array", [v for _, v in pairs]
    pairs = {k: classify(v) for k, v in value.items()}
    o = {k: v for k, (_, v) in pairs.items()}
    o[STATE] = object_state({k: s for k, (s, _) in pairs.items()}, o)
    return o[STATE], o


def object_state(state: dict[str, str], o: dict) -> str:
    """The transition of an object: its state from its members'."""
    if "series" in o and "ordinal" in o:
        return "label"
    if "elements" in o and state["elements"] in ("elements", "empty"):
        return "batch"
    if "elution_group" in o and (state["elution_group"] == "groups" or state["elution_group"] in GROUP_STATES or "precursor" in o):
        return "element"
    if state.get("fragments") == "fragments":
        return "group_fragments"
    mz = _named(o, MZ_NAMES) or ("fragments" if state.get("fragments") == "nums" else None)
    if mz and state[mz] in ("nums", "empty"):
        label = _named(o, LABEL_NAMES)
        return "group_parallel_" + (LABEL_STATE.get(state[label], "mixed") if label else "bare")
    if "mz" in o:
        return "fragment"
    return "group_empty" if "id" in o else "object"


def label_text(label, position: int) -> str:
    """Text labels as they are; objects as series, ordinal, isotope, charge; none as the position."""
    if isinstance(label, dict):
        isotope, charge = _number(label.get("isotope"), int) or 0, _number(label.get("charge"), int) or 1
        name = "".join(str(label[k]) for k in ("series", "ordinal") if label.get(k) is not None)
        return _text(name) + ("" if isotope == 0 else "+i" if isotope == 1 else f"+{isotope}i") + (f"^{charge}" if charge > 1 else "")
    return str(position) if label is None else _text(str(label))


def _text(s: str) -> str:
    """Half surrogate pairs, which JSON may name but no text may hold, as the replacement character."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(v, kind=float, bits: int = 64):
    """A number of that kind; null for what is none or doesn't fit."""
    try:
        n = None if v is None or isinstance(v, bool) else kind(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return None if kind is int and n is not None and not -(1 << bits - 1) <= n < 1 << bits - 1 else n


def _parallel(group: dict):
    """Rows of a group of parallel arrays; None if the arrays differ in length."""
    mz = group[_named(group, MZ_NAMES) or "fragments"]
    intensity = group.get(_named(group, INTENSITY_NAMES)) or []
    name = _named(group, LABEL_NAMES)
    labels = group[name] if name else [None] * len(mz)
    if not isinstance(labels, list) or not isinstance(intensity, list) or not len(mz) == len(intensity) == len(labels):
        return None
    return zip(labels, mz, intensity)


def _objects(group: dict):
    """Rows of a group whose fragments are objects."""
    return ((f.get("label"), f.get("mz"), f.get("intensity")) for f in group["fragments"])


ROUTES = {"group_fragments": _objects, "group_empty": lambda group: (), **{s: _parallel for s in GROUP_STATES if s.startswith("group_parallel")}}


def shred_payload(record_id, payload, emit: frozenset[str]) -> Iterator[tuple]:
    """Rows of one record, in the order of ROW_SCHEMA."""
    try:
        state, root = classify(json.loads(payload, parse_constant=_no_constant)) if payload else ("null", None)
    except (ValueError, RecursionError):
        state, root = "unreadable", None
    elements = [root] if state == "element" else root if state in ("elements", "empty") else root["elements"] if state == "batch" else None
    if elements is None:
        if "reject" in emit:
            yield ("reject", state, record_id) + (None,) * 15
        return
    for e, element in enumerate(elements):
        if not isinstance(element, dict) or "elution_group" not in element:
            continue
        groups = element["elution_group"]
        alone = not isinstance(groups, list)
        if "element" in emit:
            p = element.get("precursor") if isinstance(element.get("precursor"), dict) else {}
            seq, decoy = p.get("sequence"), p.get("decoy")
            yield ("element", state, record_id, e, None, None, _text(seq) if isinstance(seq, str) else None, _number(p.get("charge"), int, 32), decoy if isinstance(decoy, bool) else None, _number(p.get("decoy_group"), int)) + (None,) * 8
        for g, group in enumerate([groups] if alone else groups):
            if not isinstance(group, dict):
                continue
            shape = group[STATE]
            if shape not in ROUTES:
                continue
            rows = ROUTES[shape](group)
            rows = None if rows is None else list(rows)
            if "group" in emit:
                yield (
                    "group", shape, record_id, e, g, None, None, _number(group.get("precursor_charge"), int, 32), None, None, _number(group.get("id"), int),
                    _number(group.get(_named(group, PRECURSOR_MZ_NAMES))), _number(group.get(_named(group, MOBILITY_NAMES))), _number(group.get("rt_seconds")), None if rows is None else len(rows), None, None, None,
                )
            if "fragment" in emit and rows:
                for f, (label, mz, intensity) in enumerate(rows):
                    yield ("fragment", shape, record_id, e, g, f) + (None,) * 9 + (label_text(label, f), _number(mz), _number(intensity))


def shred(records: DataFrame, emit: tuple[str, ...] = ("element", "group", "fragment", "reject")) -> DataFrame:
    """All tables at once, told apart by ``kind`` (element, group, fragment, reject) and ``shape`` (the variant).

    One pass without a shuffle: a record of any size is read by the task that holds it. Rows leave in
    blocks, so that a batch of large records isn't held as rows all at once."""
    wanted = frozenset(emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block: list[tuple] = []
            for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.extend(shred_payload(rid, payload, wanted))
                if len(block) >= 50_000:
                    yield _batch(block)
                    block = []
            if block:
                yield _batch(block)

    return records.select(F.col("record_id").cast("long"), F.col("payload").cast("string")).mapInArrow(run, ROW_SCHEMA)


def _batch(block: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*block), ARROW_SCHEMA)], schema=ARROW_SCHEMA)


KEYS = ["record_id", "element_pos", "group_pos", "fragment_pos"]
SUBTYPES = {
    "elements": ("element", ["record_id", "element_pos", "shape", "sequence", "charge", "decoy", "decoy_group"]),
    "groups": ("group", ["record_id", "element_pos", "group_pos", "shape", "eg_id", "precursor_mz", "charge", "mobility_ook0", "rt_seconds", "n_fragments"]),
    "rejects": ("reject", ["record_id", "shape"]),
}


VARIANTS = tuple(sorted(GROUP_STATES - {"group_empty"}))


def subtype_tables(records: DataFrame, emit: tuple[str, ...] = ("element", "group", "fragment", "reject")) -> dict[str, DataFrame]:
    """The typed tables of all records: ``elements``, ``groups``, ``rejects`` and for each variant of group its
    fragment table ``fragments_<variant>``, which has the columns of that variant and the common keys.

    Payloads are parsed once; rows are stored by kind and variant, so each table reads only its own files."""
    rows = stored(shred(records, emit), ("kind", "shape"))
    out = {name: rows.filter(F.col("kind") == kind).select(*cols) for name, (kind, cols) in SUBTYPES.items() if kind in emit and kind != "fragment"}
    if "fragment" in emit:
        for shape in VARIANTS:
            cols = [*KEYS, "fragment_mz", "fragment_intensity"] + ([] if shape == "group_parallel_bare" else ["fragment_label"])
            out["fragments_" + shape.removeprefix("group_")] = rows.filter((F.col("kind") == "fragment") & (F.col("shape") == shape)).select(*cols)
    return out


def all_fragments(tables: dict[str, DataFrame]) -> DataFrame:
    """The supertype of the fragment tables: their common keys, values and labels; without labels the position."""
    out = None
    for name, t in sorted(tables.items()):
        if name.startswith("fragments_"):
            t = t if "fragment_label" in t.columns else t.withColumn("fragment_label", F.col("fragment_pos").cast("string"))
            out = t if out is None else out.unionByName(t)
    return out
