"""One consistent table from files whose fields drift, and a report of each change.

A column lifespan catalogue is kept per stream (the producer), field and type: which files hold the field with
that type. Numbering cuts it into islands of successive files, whose starts and ends are the changes;
values of shared ids decide which end and start are one renamed field. An alias table (given, plus the
renames found) generates the casts that land every record in one table.

Defined results: payloads that are no JSON object give no fields; an array's type is that of its non-null
elements, an empty array counts as ``array<null>`` only where a field holds nothing else; of equally
common types the alphabetically first counts; files without any non-null field are files all the same;
rows with a null stream or file are landed, but no file of a stream, so they are left out of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.sequence import neighbours, numbered
from ionloom.runtime import release, sized_join, stored

# Names under which the formats carry each quantity, and its type in the landed table.
CANONICAL = {
    "precursor_mono_mz": ("double", ("precursor_mono_mz", "precursor_mz", "precursor", "mz_mono", "q1", "precMz", "Precursor_Mono_Mz")),
    "precursor_charge": ("int", ("precursor_charge", "charge", "z")),
    "precursor_isotopes": ("array<int>", ("precursor_isotopes", "precursor_labels")),
    "fragment_mzs": ("array<double>", ("fragment_mzs", "fragment_mono_mzs", "fragments", "FragmentMzs", "productMzs", "q3_list", "fragment_mz")),
    "fragment_labels": ("array<string>", ("fragment_labels", "annotations", "ion_labels")),
    "mobility_ook0": ("float", ("mobility_ook0", "ook0", "mobility", "inv_k0", "im", "ionMobility")),
    "rt_seconds": ("double", ("rt_seconds", "rt", "retention_s", "RtSeconds")),
    "collision_energy": ("double", ("collision_energy",)),
    "scan_group": ("long", ("scan_group",)),
    "qc_flag": ("boolean", ("qc_flag",)),
    "remark": ("string", ("remark",)),
}
#: Share of the ids with a value on both sides that must agree before two names are one field.
AGREEMENT = 0.5


def json_type(value: Column) -> Column:
    """The JSON type of a variant: number, string, boolean, object or array<element>; null for null."""
    text = F.schema_of_variant(value)

    def plain(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)|INT|SMALLINT|TINYINT)$"), "number")
            .when(t == "STRING", "string")
            .when(t == "BOOLEAN", "boolean")
            .when(t.startswith("OBJECT"), "object")
            .when(t.startswith("ARRAY"), "array")
            .when(t == "VOID", "null")
            .otherwise("mixed")
        )

    return F.when(text == "VOID", F.lit(None)).when(text.startswith("ARRAY<"), F.concat(F.lit("array<"), plain(F.regexp_replace(text, r"^ARRAY<(.*)>$", "$1")), F.lit(">"))).otherwise(plain(text))


def fields_of(exports: DataFrame) -> DataFrame:
    """(stream, file_id, id, field, value as text, type), one row per non-null field of a record."""
    spark = exports.sparkSession
    payload = F.col("payload").cast("string")
    # What parses and begins with a brace is an object.
    parsed = exports.filter(F.col("file_id").isNotNull() & payload.rlike(r"^\s*\{")).select("export_stream", "file_id", F.try_parse_json(payload).alias("_il_v")).filter("_il_v is not null")
    out = parsed.withColumn("_il_id", F.try_variant_get("_il_v", "$.id", "string")).lateralJoin(spark.tvf.variant_explode(F.col("_il_v").outer()))
    out = out.select("export_stream", "file_id", F.col("_il_id").alias("id"), F.col("key").alias("field"), json_type(F.col("value")).alias("jtype"), F.col("value").cast("string").alias("text"))
    return out.filter("jtype is not null and field <> 'id'")


def files_of(exports: DataFrame) -> DataFrame:
    """(stream, file_id, file_no, prev_file_id, next_file_id): files of each stream numbered by their time."""
    files = exports.filter("file_id is not null and export_stream is not null").groupBy("export_stream", "file_id").agg(F.min("exported_at").alias("exported_at"))
    seq = numbered(files, ["export_stream"], ["exported_at", "file_id"], "file_no")
    return neighbours(seq, ["export_stream"], "file_no", ["file_id"])


def catalogue(fields: DataFrame, files: DataFrame) -> DataFrame:
    """(stream, field, jtype, file_no, file_id, prev_file_id, next_file_id): which file holds which field.

    The footers: counts per file, field and type are pre-aggregated where the records lie."""
    counts = fields.groupBy("export_stream", "file_id", "field", "jtype").agg(F.count(F.lit(1)).alias("n"))
    # The commonest type, then the alphabetically first; array<null> yields to any other.
    best = counts.groupBy("export_stream", "file_id", "field").agg(F.min(F.struct(F.when(F.col("jtype") == "array<null>", F.lit(1)).otherwise(F.lit(0)), -F.col("n"), "jtype")).alias("b"))
    best = best.select("export_stream", "file_id", "field", F.col("b.jtype").alias("jtype"))
    return best.join(files.select("export_stream", "file_id", "file_no", "prev_file_id", "next_file_id"), ["export_stream", "file_id"])


def lifespans(catalogue_: DataFrame) -> DataFrame:
    """Islands: (stream, field, jtype, first_file_no, last_file_no, n_files, the ids of the first and the last file
    and of those before and after) of unbroken presence with one type. The stream is the producer."""
    isl = numbered(catalogue_, ["export_stream", "field", "jtype"], ["file_no"], "k")
    ends = [F.min_by(c, "file_no").alias(n) for c, n in (("file_id", "first_file_id"), ("prev_file_id", "before_id"))] + [F.max_by(c, "file_no").alias(n) for c, n in (("file_id", "last_file_id"), ("next_file_id", "after_id"))]
    return isl.groupBy("export_stream", "field", "jtype", (F.col("file_no") - F.col("k")).alias("island")).agg(F.min("file_no").alias("first_file_no"), F.max("file_no").alias("last_file_no"), F.count(F.lit(1)).alias("n_files"), *ends).drop("island")


def quantity(text: Column) -> Column:
    """What a value says, whatever its type: its leaves as numbers where they are numbers."""
    text = F.regexp_replace(text, r',?"unit":"[^"]*"', "")
    text = F.regexp_replace(text, r'"\w+":', " ")
    tokens = F.filter(F.split(text, r'[\s\[\]{}",;|]+'), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.coalesce(t.try_cast("double").cast("string"), F.when(t == "true", "1.0").when(t == "false", "0.0"), t))
    return F.xxhash64(F.array_join(tokens, " "))


def changes(exports: DataFrame, agreement: float = AGREEMENT) -> DataFrame:
    """(file_id, change_kind, old_name, new_name): each file against the one before it in its stream."""
    # Payloads are parsed once; everything below reads their fields.
    values = stored(fields_of(exports))
    spans = stored(lifespans(catalogue(values, files_of(exports))))
    starts = spans.filter("first_file_no > 0").select(F.col("first_file_id").alias("file_id"), F.col("before_id").alias("before"), F.col("field").alias("new_name"), F.col("jtype").alias("new_type"))
    ends = spans.filter("after_id is not null").select(F.col("after_id").alias("file_id"), F.col("field").alias("old_name"), F.col("jtype").alias("old_type"))
    # An island that ends where another of the same field starts is a new type; the rest are gone or new names.
    same = stored(starts.join(ends, (starts.file_id == ends.file_id) & (F.col("new_name") == F.col("old_name")), "full").select(F.coalesce(starts.file_id, ends.file_id).alias("file_id"), "before", "old_name", "old_type", "new_name", "new_type"))
    retyped = same.filter("old_name is not null and new_name is not null").select("file_id", F.lit("retyped").alias("change_kind"), "old_name", "new_name")
    started = same.filter("old_name is null").select("file_id", "before", "new_name", "new_type")
    ended = same.filter("new_name is null").select("file_id", "old_name", "old_type")
    pairs = stored(started.join(ended, "file_id"))

    def side(names: DataFrame, file_col: str, name: str) -> DataFrame:
        """Quantities of the fields that ended or started in files where both happen."""
        wanted = names.select(F.col(file_col).alias("file_id"), F.col("file_id").alias("_il_at"), F.col(name).alias("field")).distinct() if file_col != "file_id" else names.select("file_id", F.col("file_id").alias("_il_at"), F.col(name).alias("field")).distinct()
        return sized_join(values.filter("id is not null").select("file_id", "id", "field", "text"), wanted, ["file_id", "field"], "inner").groupBy("_il_at", "id", "field").agg(F.max(quantity(F.col("text"))).alias("q")).select(F.col("_il_at").alias("file_id"), "id", F.col("field").alias(name), F.col("q").alias(f"q_{name}"))

    old = side(pairs, "before", "old_name")
    new = side(pairs, "file_id", "new_name")
    score = old.join(new, ["file_id", "id"]).groupBy("file_id", "old_name", "new_name").agg(F.avg((F.col("q_old_name") == F.col("q_new_name")).cast("int")).alias("share"), F.sum((F.col("q_old_name") == F.col("q_new_name")).cast("int")).alias("same"))
    score = score.filter((F.col("share") >= agreement) & (F.col("same") > 0))
    rank = [F.desc("share"), F.desc("same"), F.asc(F.levenshtein("old_name", "new_name")), F.asc("old_name"), F.asc("new_name")]
    # Fields of one file: few rows in each window.
    for col in ("old_name", "new_name"):
        score = score.withColumn(f"r_{col}", F.row_number().over(Window.partitionBy("file_id", col).orderBy(*rank)))
    renamed = stored(score.filter("r_old_name = 1 and r_new_name = 1").select("file_id", "old_name", "new_name"))
    typed = renamed.join(pairs, ["file_id", "old_name", "new_name"]).filter("old_type <> new_type")
    gone = ended.join(renamed, ["file_id", "old_name"], "left_anti")
    came = started.join(renamed, ["file_id", "new_name"], "left_anti")
    parts = [
        renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_name", "new_name"),
        retyped,
        typed.select("file_id", F.lit("retyped").alias("change_kind"), "old_name", "new_name"),
        gone.select("file_id", F.lit("removed").alias("change_kind"), "old_name", F.lit("").alias("new_name")),
        came.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_name"), "new_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out)
    release(exports.sparkSession, values, spans, same, pairs, renamed)
    return out


def alias_table(renames: DataFrame | None = None) -> dict[str, tuple[str, tuple[str, ...]]]:
    """CANONICAL with the names that renames link to a known one. All distinct links are read (the names of
    fields are few); where links disagree, the one found in more files counts, then the first by name."""
    table = {k: (t, list(names)) for k, (t, names) in CANONICAL.items()}
    if renames is not None:
        found = renames.filter("change_kind = 'renamed'").groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n")).collect()
        links = [(r.old_name, r.new_name) for r in sorted(found, key=lambda r: (-r.n, r.old_name, r.new_name))]
        home = {n: k for k, (_, names) in table.items() for n in names}
        again = True
        while again:
            again = False
            for a, b in links:
                for x, y in ((a, b), (b, a)):
                    if x in home and y not in home:
                        home[y] = home[x]
                        table[home[x]][1].append(y)
                        again = True
    return {k: (t, tuple(names)) for k, (t, names) in table.items()}


def _cast_to(kind: str):
    return lambda token: token.try_cast("double").cast(kind)


def landed(exports: DataFrame, aliases: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Every record in one table: per quantity the first non-null of its names, cast to its type; whatever
    else the payload holds is kept in the map ``other`` as JSON: names that belong to no quantity, further
    values of one, and values its type can't hold. One pass, no shuffle."""
    aliases = aliases or CANONICAL
    v = exports.select("export_row_id", "export_stream", "file_id", "exported_at", "record_no", F.try_parse_json(F.col("payload").cast("string")).alias("_il_v"))
    fields = F.try_variant_get("_il_v", "$", "map<string,variant>")
    # A path can't quote every name.
    part = lambda n, path, kind: F.try_variant_get("_il_v", f"$['{n}']{path}", kind) if "'" not in n and "\\" not in n else F.try_variant_get(F.try_element_at(fields, F.lit(n)), f"${path}", kind)
    base = ["export_row_id", "export_stream", "file_id", "exported_at", "record_no"]
    firsts, tokens, got, whole = {}, {}, {}, [F.when(F.col("id").isNotNull(), F.lit("id"))]
    for name, (kind, names) in aliases.items():
        texts = [(n, F.coalesce(part(n, ".value", "string"), part(n, "", "string"))) for n in names]
        firsts[f"_il_t_{name}"] = F.coalesce(*[F.when(t.isNotNull(), F.struct(F.lit(n).alias("name"), t.alias("text"))) for n, t in texts])
        text, cut, x = F.col(f"_il_t_{name}.text"), F.col(f"_il_k_{name}"), F.col(name)
        tokens[f"_il_k_{name}"] = F.filter(F.split(F.regexp_replace(text, r'"\w+":', " "), r'[\s\[\]{}",;|]+'), lambda t: t != "")
        inner = kind[6:-1] if kind.startswith("array<") else None
        if kind == "string":
            got[name], ok = text, F.lit(True)
        elif inner:
            got[name] = cut if inner == "string" else F.transform(cut, _cast_to(inner))
            ok = F.lit(True) if inner == "string" else ~F.exists(x, lambda t: t.isNull())
        else:
            got[name] = F.get(cut, 0).try_cast("boolean") if kind == "boolean" else F.get(cut, 0).try_cast("double").cast(kind)
            ok = x.isNotNull() & (F.size(cut) == 1)
        whole.append(F.when(ok, F.col(f"_il_t_{name}.name")))
    # In steps, so that nothing is worked out twice.
    rows = v.select(*base, F.try_variant_get("_il_v", "$.id", "long").alias("id"), fields.alias("_il_f"), *[c.alias(k) for k, c in firsts.items()]).withColumns(tokens).withColumns(got)
    rows = rows.withColumn("_il_w", F.array_compact(F.array(*whole)))
    known = F.array(*[F.lit(n) for n in ["id", *(n for _, names in aliases.values() for n in names)]])
    rest = F.map_filter("_il_f", lambda k, x: ~(F.array_contains("_il_w", k) | (F.is_variant_null(x) & F.array_contains(known, k))))
    return rows.select(*base, "id", *aliases, F.transform_values(rest, lambda k, x: F.to_json(x)).alias("other"))
