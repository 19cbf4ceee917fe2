"""Queries over the library tables: shredding, rejected lines, drift, packed fields, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import drift, lines, packed, shred, units
from ionloom.runtime import table

PACKED = ["protein_group", "protein_name", "genes"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of all variants, from their typed tables."""
    tables = shred.subtype_tables(table(spark, sf, "speclib_elements"), ("fragment",))
    return shred.all_fragments(tables).select("record_id", "element_pos", "group_pos", "fragment_pos", "fragment_label")


def _typed(kind: str, name: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return shred.subtype_tables(table(spark, sf, "speclib_elements"), (kind,))[name]

    f.__name__ = f"p1_{name}"
    return f


TYPED = [_typed("element", "elements"), _typed("group", "groups"), _typed("reject", "rejects"), *[_typed("fragment", "fragments_" + v.removeprefix("group_")) for v in shred.VARIANTS]]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lines.rejected(table(spark, sf, "sample_lib_raw"))


def p3_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return lines.transitions(table(spark, sf, "sample_lib_raw"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "eg_exports"))


def p4_landed(spark: SparkSession, sf: str) -> DataFrame:
    exports = table(spark, sf, "eg_exports")
    return drift.landed(exports, drift.alias_table(drift.changes(exports)))


def p4_landed_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The landed table told by plain columns: arrays by length and sum (labels as text), what is left over by its names."""
    t = p4_landed(spark, sf)
    out = ["export_row_id", "id"]
    for name, (kind, _) in drift.CANONICAL.items():
        if kind == "array<string>":
            out.append(F.array_join(name, ",").alias(name))
        elif kind.startswith("array"):
            out += [F.when(F.col(name).isNotNull(), F.size(name)).cast("long").alias(f"{name}_n"), F.round(F.aggregate(name, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), 6).alias(f"{name}_sum")]
        else:
            out.append(F.round(F.col(name).cast("double"), 5).alias(name) if kind in ("double", "float") else F.col(name).cast("long").alias(name) if kind == "int" else F.col(name))
    return t.select(*out, F.array_join(F.array_sort(F.map_keys("other")), ",").alias("other"))


def p4_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    exports = table(spark, sf, "eg_exports")
    spans = drift.lifespans(drift.catalogue(drift.fields_of(exports), drift.files_of(exports)))
    return spans.select("export_stream", "field", "jtype", "first_file_no", "last_file_no", "n_files")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack(table(spark, sf, "sample_lib"), "lib_row_id", PACKED).withColumnRenamed("row_id", "lib_row_id")


def _times(spark: SparkSession, sf: str) -> DataFrame:
    values = units.retention_values(table(spark, sf, "sample_lib"), table(spark, sf, "elution_groups"))
    return units.to_milliseconds(values, table(spark, sf, "library_sources"), units.DEFAULTS)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).select("rec_table", "rec_id", "field_name", "rt_ms")


def p6_units(spark: SparkSession, sf: str) -> DataFrame:
    """What unit each source's values had and how it was found."""
    return _times(spark, sf).groupBy("source_id", "field_name", "unit", "unit_origin").agg(F.count(F.lit(1)).alias("n"))


def p6_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """How sure the mixture is of each source's unit where none was given, and how many values it flags."""
    missing = _times(spark, sf).filter("unit_origin in ('default', 'mixture')")
    return missing.groupBy("source_id", "field_name", "unit", "mix_unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("mix_posterior"), 4).alias("posterior"), F.sum(F.col("uncertain").cast("long")).alias("n_uncertain"))


QUERIES = {f.__name__: f for f in (p1_found, *TYPED, p3_found, p3_transitions, p4_found, p4_landed, p4_landed_flat, p4_lifespans, p5_found, p6_found, p6_units, p6_mixture)}

ORACLE = {
    "p5_found": r"""
WITH f AS (
  SELECT lib_row_id, unnest(['protein_group','protein_name','genes']) AS field_name,
         unnest([protein_group, protein_name, genes]) AS v FROM sample_lib),
t AS (
  SELECT lib_row_id, field_name, list_transform(
      regexp_extract_all(v, '"(?:[^"\\]|\\.|"")*"|(?:sp|tr)\|[\w.\-]+\|[\w.\-]+|[\w.\-]+'),
      lambda x: CASE WHEN x LIKE '"%' THEN trim(replace(replace(x[2:-2], '\"', '"'), '""', '"')) ELSE x END) AS raw
  FROM f WHERE v IS NOT NULL),
k AS (SELECT lib_row_id, field_name, list_filter(raw, lambda x: x <> '') AS vals FROM t)
SELECT lib_row_id, field_name, CAST(unnest(range(len(vals))) AS INTEGER) AS item_pos, unnest(vals) AS item_value FROM k
""",
    "p1_found": r"""
WITH ok AS (SELECT record_id, CAST(payload AS JSON) AS j FROM speclib_elements WHERE json_valid(payload)),
root AS (SELECT record_id, CASE json_type(j) WHEN 'ARRAY' THEN CAST(j AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.elements') = 'ARRAY' THEN CAST(j->'$.elements' AS JSON[]) ELSE [j] END END AS els FROM ok),
el AS (SELECT record_id, unnest(els) AS e, unnest(range(len(els))) AS element_pos FROM root),
eg AS (SELECT record_id, element_pos, CASE json_type(e, '$.elution_group') WHEN 'VARCHAR' THEN CASE WHEN json_valid(e->>'$.elution_group') THEN CAST(e->>'$.elution_group' AS JSON) END ELSE e->'$.elution_group' END AS g FROM el),
gr AS (SELECT record_id, element_pos, CASE json_type(g) WHEN 'ARRAY' THEN CAST(g AS JSON[]) WHEN 'OBJECT' THEN [g] END AS gs FROM eg),
g1 AS (SELECT record_id, element_pos, unnest(gs) AS g, unnest(range(len(gs))) AS group_pos FROM gr),
arr AS (SELECT record_id, element_pos, group_pos,
    CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].mz' AS JSON[]) ELSE CAST(coalesce(nullif(g->'$.fragment_mzs', 'null'), g->'$.fragment_mz') AS JSON[]) END AS mz,
    CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].intensity' AS JSON[]) ELSE CAST(g->'$.fragment_intensities' AS JSON[]) END AS it,
    CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].label' AS JSON[]) WHEN json_type(g, '$.fragment_labels') = 'ARRAY' THEN CAST(g->'$.fragment_labels' AS JSON[]) END AS lab FROM g1),
fr AS (SELECT record_id, element_pos, group_pos, unnest(range(len(mz))) AS fragment_pos, unnest(coalesce(lab, list_transform(mz, lambda x: NULL))) AS l FROM arr WHERE len(mz) = len(it) AND (lab IS NULL OR len(lab) = len(mz)))
SELECT record_id, CAST(element_pos AS INTEGER) AS element_pos, CAST(group_pos AS INTEGER) AS group_pos, CAST(fragment_pos AS INTEGER) AS fragment_pos,
  CASE WHEN l IS NULL OR json_type(l) = 'NULL' THEN CAST(fragment_pos AS VARCHAR) WHEN json_type(l) = 'OBJECT' THEN (l->>'$.series') || (l->>'$.ordinal')
    || CASE coalesce(CAST(l->>'$.isotope' AS INTEGER), 0) WHEN 0 THEN '' WHEN 1 THEN '+i' ELSE '+' || (l->>'$.isotope') || 'i' END || CASE WHEN coalesce(CAST(l->>'$.charge' AS INTEGER), 1) > 1 THEN '^' || (l->>'$.charge') ELSE '' END
  ELSE l->>'$' END AS fragment_label FROM fr
""",
    "p3_found": r"""
WITH h AS (SELECT file_name, regexp_replace(ltrim(raw_line, chr(65279)), chr(13) || '$', '') AS header FROM sample_lib_raw WHERE line_no = 1),
l AS (SELECT line_id, regexp_replace(raw_line, chr(13) || '$', '') AS s, header FROM sample_lib_raw r JOIN h ON r.file_name = h.file_name WHERE line_no <> 1),
d AS (SELECT line_id, s, string_split(header, chr(9)) AS names FROM l WHERE trim(s) <> '' AND ltrim(s, chr(65279)) <> header),
t AS (SELECT line_id, s, names, regexp_extract_all(s || chr(9), '("(?:[^"]|"")*"|[^"\t][^\t]*|)\t', 1) AS tok FROM d),
v AS (SELECT line_id, names, list_sum(list_transform(tok, lambda x: length(x) + 1)) = length(s) + 1 AS whole, list_transform(tok, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS vals FROM t),
r AS (SELECT line_id, CASE WHEN NOT whole THEN ['quoting'] WHEN len(vals) <> len(names) THEN ['column_count'] ELSE list_filter([
    CASE WHEN NOT regexp_full_match(vals[list_position(names, 'FragmentType')], '[abcxyz]') THEN 'fragment_type' END,
    CASE WHEN NOT regexp_full_match(vals[list_position(names, 'FragmentCharge')], '0*([1-9]|[1-9][0-9]|1[01][0-9]|12[0-7])') THEN 'fragment_charge' END,
    CASE WHEN NOT regexp_full_match(vals[list_position(names, 'FragmentLossType')], 'noloss|H2O|NH3|CO|H3PO4|CH4OS') THEN 'fragment_loss_type' END], lambda x: x IS NOT NULL) END AS reasons FROM v)
SELECT line_id, unnest(reasons) AS reason FROM r
""",
    "p4_found": r"""
WITH rec AS (SELECT export_stream AS s, file_id AS f, exported_at AS t, CAST(payload AS JSON) AS j FROM eg_exports),
prev AS (SELECT s, f, lag(f) OVER (PARTITION BY s ORDER BY t, f) AS p FROM (SELECT s, f, min(t) AS t FROM rec GROUP BY 1, 2)),
kv AS (SELECT f, j->>'$.id' AS id, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT f, j, unnest(json_keys(j)) AS k FROM rec) WHERE k <> 'id'),
ty AS (SELECT f, id, k, v, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
    WHEN 'ARRAY' THEN 'array<' || CASE json_type(v, '$[0]') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' ELSE 'number' END || '>' ELSE 'number' END AS jt FROM kv),
best AS (SELECT f, k, jt FROM (SELECT f, k, jt, row_number() OVER (PARTITION BY f, k ORDER BY count(*) DESC, jt) AS r FROM ty WHERE jt IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1),
cur AS (SELECT prev.f, prev.p, k, jt FROM prev JOIN best ON best.f = prev.f WHERE p IS NOT NULL), old AS (SELECT prev.f, prev.p, k, jt FROM prev JOIN best ON best.f = prev.p),
came AS (SELECT cur.* FROM cur ANTI JOIN old ON cur.f = old.f AND cur.k = old.k), gone AS (SELECT old.* FROM old ANTI JOIN cur ON cur.f = old.f AND cur.k = old.k),
q AS (SELECT f, id, k, any_value(array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(CAST(v AS VARCHAR), ',\s*"unit":\s*"[^"]*"', '', 'g'), '"\w+":', ' ', 'g'), '[\s\[\]{}",;|]+'), lambda x: x <> ''),
    lambda x: coalesce(CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR), CASE x WHEN 'true' THEN '1.0' WHEN 'false' THEN '0.0' END, x)), ' ')) AS c FROM ty WHERE jt IS NOT NULL GROUP BY 1, 2, 3),
sc AS (SELECT g.f, g.k AS old_name, n.k AS new_name, avg(CAST(a.c = b.c AS INTEGER)) AS share, sum(CAST(a.c = b.c AS INTEGER)) AS same FROM gone g JOIN came n ON g.f = n.f JOIN q a ON a.f = g.p AND a.k = g.k JOIN q b ON b.f = n.f AND b.k = n.k AND a.id = b.id GROUP BY 1, 2, 3 HAVING avg(CAST(a.c = b.c AS INTEGER)) >= 0.5),
ren AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, old_name ORDER BY share DESC, same DESC) AS r1, row_number() OVER (PARTITION BY f, new_name ORDER BY share DESC, same DESC) AS r2 FROM sc) WHERE r1 = 1 AND r2 = 1)
SELECT f AS file_id, 'renamed' AS change_kind, old_name, new_name FROM ren
UNION ALL SELECT r.f, 'retyped', old_name, new_name FROM ren r JOIN gone g ON r.f = g.f AND r.old_name = g.k JOIN came n ON r.f = n.f AND r.new_name = n.k WHERE g.jt <> n.jt
UNION ALL SELECT cur.f, 'retyped', cur.k, cur.k FROM cur JOIN old ON cur.f = old.f AND cur.k = old.k WHERE cur.jt <> old.jt
UNION ALL SELECT g.f, 'removed', g.k, '' FROM gone g ANTI JOIN ren ON g.f = ren.f AND g.k = ren.old_name
UNION ALL SELECT n.f, 'added', '', n.k FROM came n ANTI JOIN ren ON n.f = ren.f AND n.k = ren.new_name
""",
    "p6_found": r"""
WITH v AS (
  SELECT 'sample_lib' AS rec_table, lib_row_id AS rec_id, source_id, unnest(['irt', 'tr_recalibrated']) AS field_name, unnest([irt, tr_recalibrated]) AS value FROM sample_lib
  UNION ALL SELECT 'elution_groups', eg_id, source_id, 'rt_seconds', CAST(rt_seconds AS VARCHAR) FROM elution_groups WHERE NOT isnan(rt_seconds)),
t AS (SELECT *, regexp_replace(regexp_replace(trim(replace(replace(replace(lower(value), chr(160), ' '), chr(8722), '-'), ',', '.')), '^rt ', ''), '\s+', ' ', 'g') AS x FROM v WHERE value IS NOT NULL),
s AS (SELECT source_id, CASE
    WHEN regexp_full_match(lower(trim(rt_unit)), 'ms|msec|milliseconds?') THEN 1
    WHEN regexp_full_match(lower(trim(rt_unit)), 's|secs?\.?|seconds?') THEN 1000
    WHEN regexp_full_match(lower(trim(rt_unit)), 'm|mins?\.?|minutes?') THEN 60000
    WHEN regexp_full_match(lower(trim(rt_unit)), 'h|hrs?|hours?') THEN 3600000
    WHEN regexp_matches(lower(note), 'hundredths of a minute|0\.01 min') THEN 600
    WHEN regexp_matches(n, '\b(ms|milliseconds?)\b') THEN 1
    WHEN regexp_matches(n, '\b(seconds?|sekunden)\b') THEN 1000
    WHEN regexp_matches(n, '\b(hours?|h-based)\b') THEN 3600000
    WHEN regexp_matches(n, '\b(minutes?)\b') THEN 60000 END AS factor
  FROM (SELECT *, regexp_replace(lower(note), '[0-9]+ ?(ms|s|min|h)\b', '', 'g') AS n FROM library_sources)),
p AS (SELECT rec_table, rec_id, field_name, source_id, x, TRY_CAST(x AS DOUBLE) AS num,
  regexp_extract(x, '^(-?[0-9.]+(?:e[+-]?[0-9]+)?) ?\[?([a-z]+)\.?\]?$', 1) AS a, regexp_extract(x, '^(-?[0-9.]+(?:e[+-]?[0-9]+)?) ?\[?([a-z]+)\.?\]?$', 2) AS u FROM t),
c AS (SELECT p.*, s.factor, CASE
    WHEN num IS NOT NULL AND NOT isnan(num) AND NOT isinf(num) THEN num * coalesce(factor, CASE field_name WHEN 'rt_seconds' THEN 1000 ELSE 60000 END)
    WHEN u IN ('ms', 'msec', 'milliseconds') THEN CAST(a AS DOUBLE)
    WHEN u IN ('s', 'sec', 'seconds') THEN CAST(a AS DOUBLE) * 1000
    WHEN u IN ('m', 'min', 'minutes') THEN CAST(a AS DOUBLE) * 60000
    WHEN u IN ('h', 'hr', 'hours') THEN CAST(a AS DOUBLE) * 3600000
    WHEN regexp_full_match(x, '-?[0-9]+:[0-9]+:[0-9.]+') THEN (CASE WHEN x[1] = '-' THEN -1 ELSE 1 END) * (CAST(ltrim(split_part(x, ':', 1), '-') AS DOUBLE) * 3600 + CAST(split_part(x, ':', 2) AS DOUBLE) * 60 + CAST(split_part(x, ':', 3) AS DOUBLE)) * 1000
    WHEN regexp_full_match(x, '-?[0-9]+:[0-9.]+') THEN (CASE WHEN x[1] = '-' THEN -1 ELSE 1 END) * (CAST(ltrim(split_part(x, ':', 1), '-') AS DOUBLE) * 60 + CAST(split_part(x, ':', 2) AS DOUBLE)) * 1000
    WHEN regexp_full_match(x, '-?pt([0-9.]+h)?([0-9.]+m)?([0-9.]+s)?') OR regexp_full_match(x, '-?[0-9]+ min [0-9.]+ s') THEN (CASE WHEN x[1] = '-' THEN -1 ELSE 1 END) * (
      coalesce(TRY_CAST(regexp_extract(x, '([0-9.]+)h', 1) AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(x, '([0-9.]+) ?m', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(x, '([0-9.]+) ?s', 1) AS DOUBLE), 0)) * 1000 END AS ms
  FROM p LEFT JOIN s ON p.source_id = s.source_id)
SELECT rec_table, rec_id, field_name, CAST(round(round(ms, 4)) AS BIGINT) AS rt_ms FROM c WHERE ms IS NOT NULL
""",
}

SHREDDED = r"""
WITH ok AS (SELECT record_id, CAST(payload AS JSON) AS j FROM speclib_elements WHERE json_valid(payload)),
root AS (SELECT record_id, CASE json_type(j) WHEN 'ARRAY' THEN 'elements' ELSE CASE WHEN json_type(j, '$.elements') = 'ARRAY' THEN 'batch' ELSE 'element' END END AS shape,
  CASE json_type(j) WHEN 'ARRAY' THEN CAST(j AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.elements') = 'ARRAY' THEN CAST(j->'$.elements' AS JSON[]) ELSE [j] END END AS els FROM ok),
el AS (SELECT record_id, shape, unnest(els) AS e, unnest(range(len(els))) AS element_pos FROM root),
elem AS (SELECT record_id, shape, element_pos, CASE json_type(e, '$.precursor') WHEN 'VARCHAR' THEN CASE WHEN json_valid(e->>'$.precursor') THEN CAST(e->>'$.precursor' AS JSON) END ELSE e->'$.precursor' END AS p,
  CASE json_type(e, '$.elution_group') WHEN 'VARCHAR' THEN CASE WHEN json_valid(e->>'$.elution_group') THEN CAST(e->>'$.elution_group' AS JSON) END ELSE e->'$.elution_group' END AS g FROM el WHERE json_exists(e, '$.elution_group')),
gr AS (SELECT record_id, element_pos, CASE json_type(g) WHEN 'ARRAY' THEN CAST(g AS JSON[]) WHEN 'OBJECT' THEN [g] END AS gs FROM elem),
g0 AS (SELECT record_id, element_pos, unnest(gs) AS g, unnest(range(len(gs))) AS group_pos FROM gr),
g1 AS (SELECT *, CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].mz' AS JSON[]) ELSE CAST(coalesce(nullif(g->'$.fragment_mzs', 'null'), nullif(g->'$.fragment_mz', 'null')) AS JSON[]) END AS mz,
  CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].intensity' AS JSON[]) ELSE coalesce(CAST(nullif(g->'$.fragment_intensities', 'null') AS JSON[]), []) END AS it,
  CASE WHEN json_type(g, '$.fragments') = 'ARRAY' THEN CAST(g->'$.fragments[*].label' AS JSON[]) WHEN json_type(g, '$.fragment_labels') = 'ARRAY' THEN CAST(g->'$.fragment_labels' AS JSON[]) END AS lab FROM g0 WHERE json_type(g) = 'OBJECT'),
g2 AS (SELECT *, list_distinct(list_filter(list_transform(lab, lambda x: json_type(x)), lambda x: x <> 'NULL')) AS kinds FROM g1),
g3 AS (SELECT *, CASE WHEN json_type(g, '$.fragments') = 'ARRAY' AND len(mz) > 0 THEN 'group_fragments' WHEN mz IS NULL THEN 'group_empty' WHEN lab IS NULL THEN 'group_parallel_bare'
    WHEN len(kinds) = 0 OR kinds = ['VARCHAR'] THEN 'group_parallel_text' WHEN kinds = ['OBJECT'] THEN 'group_parallel_object' ELSE 'group_parallel_mixed' END AS shape FROM g2),
fr AS (SELECT record_id, element_pos, group_pos, shape, unnest(range(len(mz))) AS fragment_pos, unnest(mz) AS m, unnest(it) AS i, unnest(coalesce(lab, list_transform(mz, lambda x: NULL))) AS l FROM g3 WHERE len(mz) = len(it) AND (lab IS NULL OR len(lab) = len(mz)))
"""
FRAGMENT = """SELECT record_id, CAST(element_pos AS INTEGER) AS element_pos, CAST(group_pos AS INTEGER) AS group_pos, CAST(fragment_pos AS INTEGER) AS fragment_pos, CAST(m AS DOUBLE) AS fragment_mz, CAST(i AS DOUBLE) AS fragment_intensity"""
LABEL_SQL = r""", CASE WHEN l IS NULL OR json_type(l) = 'NULL' THEN CAST(fragment_pos AS VARCHAR) WHEN json_type(l) = 'OBJECT' THEN (l->>'$.series') || (l->>'$.ordinal')
    || CASE coalesce(CAST(l->>'$.isotope' AS INTEGER), 0) WHEN 0 THEN '' WHEN 1 THEN '+i' ELSE '+' || (l->>'$.isotope') || 'i' END || CASE WHEN coalesce(CAST(l->>'$.charge' AS INTEGER), 1) > 1 THEN '^' || (l->>'$.charge') ELSE '' END
  ELSE l->>'$' END AS fragment_label"""
ORACLE |= {
    "p1_elements": SHREDDED + "SELECT record_id, CAST(element_pos AS INTEGER) AS element_pos, shape, p->>'$.sequence' AS sequence, TRY_CAST(p->>'$.charge' AS INTEGER) AS charge, TRY_CAST(p->>'$.decoy' AS BOOLEAN) AS decoy, TRY_CAST(p->>'$.decoy_group' AS BIGINT) AS decoy_group FROM elem",
    "p1_groups": SHREDDED + """SELECT record_id, CAST(element_pos AS INTEGER) AS element_pos, CAST(group_pos AS INTEGER) AS group_pos, shape, TRY_CAST(g->>'$.id' AS BIGINT) AS eg_id, CAST(coalesce(g->>'$.precursor_mz', g->>'$.precursor_mono_mz') AS DOUBLE) AS precursor_mz,
  TRY_CAST(g->>'$.precursor_charge' AS INTEGER) AS charge, CAST(coalesce(g->>'$.mobility_ook0', g->>'$.mobility') AS DOUBLE) AS mobility_ook0, CAST(g->>'$.rt_seconds' AS DOUBLE) AS rt_seconds,
  CAST(CASE WHEN mz IS NULL THEN 0 WHEN len(mz) = len(it) AND (lab IS NULL OR len(lab) = len(mz)) THEN len(mz) END AS INTEGER) AS n_fragments FROM g3""",
    "p1_rejects": "SELECT record_id, CASE WHEN payload IS NULL OR payload = '' THEN 'null' ELSE 'unreadable' END AS shape FROM speclib_elements WHERE payload IS NULL OR NOT json_valid(payload)",
    **{"p1_fragments_" + v.removeprefix("group_"): SHREDDED + FRAGMENT + ("" if v == "group_parallel_bare" else LABEL_SQL) + f" FROM fr WHERE shape = '{v}'" for v in shred.VARIANTS},
}
_NAMED = {"ms": "ms|msec|milliseconds?", "s": r"s|secs?\.?|seconds?", "min": r"m|mins?\.?|minutes?", "h": "h|hrs?|hours?"}
ORACLE["p6_units"] = ORACLE["p6_found"][: ORACLE["p6_found"].index("SELECT rec_table, rec_id, field_name, CAST(round")].rstrip() + r""",
su AS (SELECT source_id, CASE """ + " ".join(f"WHEN regexp_full_match(lower(trim(rt_unit)), '{p}') THEN '{u}'" for u, p in _NAMED.items()) + r""" END AS named,
  CASE WHEN regexp_matches(lower(note), 'hundredths of a minute|0\.01 min') THEN 'cmin' WHEN regexp_matches(n, '\b(ms|milliseconds?)\b') THEN 'ms' WHEN regexp_matches(n, '\b(seconds?|sekunden)\b') THEN 's' WHEN regexp_matches(n, '\b(hours?|h-based)\b') THEN 'h' WHEN regexp_matches(n, '\b(minutes?)\b') THEN 'min' END AS noted
  FROM (SELECT *, regexp_replace(lower(note), '[0-9]+ ?(ms|s|min|h)\b', '', 'g') AS n FROM library_sources)),
z AS (SELECT c.source_id, field_name, CASE WHEN num IS NOT NULL THEN coalesce(named, noted, CASE field_name WHEN 'rt_seconds' THEN 's' ELSE 'min' END) WHEN u IN ('s', 'sec', 'seconds') THEN 's' WHEN u IN ('m', 'min', 'minutes') THEN 'min' WHEN u IN ('h', 'hr', 'hours') THEN 'h' ELSE 'ms' END AS unit,
  CASE WHEN num IS NULL THEN 'text' WHEN named IS NOT NULL THEN 'source' WHEN noted IS NOT NULL THEN 'note' ELSE 'default' END AS unit_origin FROM c LEFT JOIN su ON c.source_id = su.source_id WHERE ms IS NOT NULL)
SELECT source_id, field_name, unit, unit_origin, count(*) AS n FROM z GROUP BY ALL
"""
# The lines that p3_found does not reject, typed.
_WITH = ORACLE["p3_found"][: ORACLE["p3_found"].index("SELECT line_id, unnest(reasons)")].rstrip()
_CANON = {k: [f"vals[list_position(names, '{n}')]" for n in names] for k, names in lines.ALIASES.items()}
_TYPES = {"precursor_mz": "DOUBLE", "charge": "INTEGER", "rt_min": "DOUBLE", "mobility": "DOUBLE", "decoy": "INTEGER", "frag_mz": "DOUBLE", "frag_num": "INTEGER", "frag_charge": "INTEGER", "rel_int": "FLOAT"}
ORACLE["p3_transitions"] = (
    _WITH + " SELECT v.line_id, " + ", ".join(f"{'TRY_CAST(' if k in _TYPES else ''}coalesce({', '.join(c)}){f' AS {_TYPES[k]})' if k in _TYPES else ''} AS {k}" for k, c in _CANON.items()) + " FROM v JOIN r ON v.line_id = r.line_id WHERE len(reasons) = 0"
)
_BEST = ORACLE["p4_found"][: ORACLE["p4_found"].index("cur AS (SELECT")]
ORACLE["p4_lifespans"] = (
    _BEST
    + """no AS (SELECT s, f, row_number() OVER (PARTITION BY s ORDER BY t, f) - 1 AS n FROM (SELECT s, f, min(t) AS t FROM rec GROUP BY 1, 2)),
isl AS (SELECT s, k, jt, n, n - row_number() OVER (PARTITION BY s, k, jt ORDER BY n) AS island FROM best JOIN no ON best.f = no.f)
SELECT s AS export_stream, k AS field, jt AS jtype, min(n) AS first_file_no, max(n) AS last_file_no, count(*) AS n_files FROM isl GROUP BY s, k, jt, island"""
)


def _landed_sql() -> str:
    """The landing written out over the canonical names."""
    first, cut, got, whole, out = [], [], [], ["CASE WHEN id IS NOT NULL THEN 'id' END"], ["export_row_id", "id"]
    for q, (kind, names) in drift.CANONICAL.items():
        t = [f"""coalesce(json_extract_string(j, '$."{n}"."value"'), json_extract_string(j, '$."{n}"'))""" for n in names]
        first.append("CASE " + " ".join(f"WHEN {x} IS NOT NULL THEN '{n}'" for n, x in zip(names, t)) + f" END AS n_{q}, coalesce({', '.join(t)}) AS t_{q}")
        cut.append(rf"""list_filter(string_split_regex(regexp_replace(t_{q}, '"\w+":', ' ', 'g'), '[\s\[\]{{}}",;|]+'), lambda x: x <> '') AS k_{q}""")
        if kind == "string":
            got.append(f"t_{q} AS v_{q}, TRUE AS ok_{q}")
            out.append(f"v_{q} AS {q}")
        elif kind == "array<string>":
            got.append(f"k_{q} AS v_{q}, TRUE AS ok_{q}")
            out.append(f"array_to_string(v_{q}, ',') AS {q}")
        elif kind.startswith("array"):
            num = "CAST(trunc(TRY_CAST(x AS DOUBLE)) AS DOUBLE)" if "int" in kind else "TRY_CAST(x AS DOUBLE)"
            got.append(f"list_transform(k_{q}, lambda x: {num}) AS v_{q}, len(list_filter(k_{q}, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 AS ok_{q}")
            out += [f"CAST(len(v_{q}) AS BIGINT) AS {q}_n", f"CASE WHEN v_{q} IS NOT NULL THEN round(coalesce(list_sum(v_{q}), 0), 6) END AS {q}_sum"]
        else:
            value = {"boolean": f"TRY_CAST(k_{q}[1] AS BOOLEAN)", "float": f"CAST(CAST(TRY_CAST(k_{q}[1] AS DOUBLE) AS FLOAT) AS DOUBLE)"}.get(kind, f"TRY_CAST(k_{q}[1] AS DOUBLE)")
            got.append(f"{value} AS v_{q}, {value} IS NOT NULL AND len(k_{q}) = 1 AS ok_{q}")
            out.append(f"round(v_{q}, 5) AS {q}" if kind in ("double", "float") else f"v_{q} AS {q}" if kind == "boolean" else f"CAST(trunc(v_{q}) AS BIGINT) AS {q}")
        whole.append(f"CASE WHEN ok_{q} THEN n_{q} END")
    known = ", ".join(f"'{n}'" for n in ["id", *(n for _, names in drift.CANONICAL.values() for n in names)])
    return f"""WITH rec AS (SELECT export_row_id, CAST(payload AS JSON) AS j FROM eg_exports), a AS (SELECT export_row_id, j, TRY_CAST(j->>'$.id' AS BIGINT) AS id, {', '.join(first)} FROM rec),
b AS (SELECT *, {', '.join(cut)} FROM a), c AS (SELECT *, {', '.join(got)} FROM b), d AS (SELECT *, list_filter([{', '.join(whole)}], lambda x: x IS NOT NULL) AS landed FROM c)
SELECT {', '.join(out)}, array_to_string(list_sort(list_filter(json_keys(j), lambda k: NOT (list_contains(landed, k) OR (json_type(j, '$."' || k || '"') = 'NULL' AND k IN ({known}))))), ',') AS other FROM d"""


ORACLE["p4_landed_flat"] = _landed_sql()
