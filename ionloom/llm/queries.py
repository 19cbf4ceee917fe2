"""Queries over fragment ions and documents for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm import leaks, mixing, subjects, topn
from ionloom.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_items(table(spark, sf, "fragment_ions")).select(F.col("grp").alias("eg_id"), F.col("rid").alias("ion_row_id"))


def p2_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """The eight strongest fragments with their values and rank."""
    return topn.top_items(table(spark, sf, "fragment_ions")).select(F.col("grp").alias("eg_id"), "rank", F.col("k2").alias("fragment_label"), F.col("tie_num").alias("fragment_mz"), F.col("score").cast("float").alias("fragment_intensity"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's words in order with up to three words more or less between them."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), slack=3)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p8_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """The report of mixes as large as their sources taken once: small sources are clamped to their cap, their weight goes to the others."""
    return mixing.shares(*mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), total="once"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every source of every mix, for the largest unclamped total and for sources taken once:
    no document beyond its cap, the wanted tokens met to within one hash slot, sources clamped only at their cap."""
    out = None
    for name, total in (("largest", None), ("once", "once")):
        r = mixing.shares(*mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), total=total))
        r = r.select(
            F.lit(name).alias("total"), "mix_name", "source", (F.col("source_tokens") > 0).alias("has_documents"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"),
            (F.abs(F.col("n_tokens") - F.col("repetitions") * F.col("source_tokens")) <= F.col("largest_slot")).alias("tokens_met"), (~F.col("clamped") | (F.abs(F.col("repetitions") - F.col("max_repeats")) < 1e-6)).alias("clamped_at_cap"),
        )
        out = r if out is None else out.unionByName(r)
    return out


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects(*(table(spark, sf, t) for t in ("documents", "subject_labels", "subject_areas", "eval_items")))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and characters of the corpus by subject."""
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return p9_found(spark, sf).join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_spectra, p7_found, p7_proximity, p8_mixture, p8_shares, p8_budgeted, p8_checked, p9_found, p9_composition)}

TOP = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY eg_id, run_id, fragment_label, fragment_mz ORDER BY loaded_at DESC, ion_row_id DESC) AS r FROM fragment_ions),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eg_id ORDER BY fragment_intensity DESC, fragment_mz, fragment_label, ion_row_id) - 1 AS rank
  FROM latest WHERE r = 1 AND fragment_intensity > 0 AND isfinite(fragment_intensity))
"""
ORACLE = {
    "p2_found": TOP + "SELECT eg_id, ion_row_id FROM ranked WHERE rank < 8",
    "p2_spectra": TOP + "SELECT eg_id, CAST(rank AS INTEGER) AS rank, fragment_label, fragment_mz, fragment_intensity FROM ranked WHERE rank < 8",
    "p8_checked": r"""
WITH d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source FROM documents WHERE text <> '' AND source IS NOT NULL),
t AS (SELECT DISTINCT mix_name, regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source FROM mix_targets WHERE source IS NOT NULL AND mix_name IS NOT NULL)
SELECT total, mix_name, t.source, d.source IS NOT NULL AS has_documents, TRUE AS cap_kept, TRUE AS tokens_met, TRUE AS clamped_at_cap FROM t LEFT JOIN d ON t.source = d.source, (VALUES ('largest'), ('once')) v(total)
""",
}


def _grams(table_: str, key: str, joined: bool) -> str:
    """SQL: every run of 12 words of a table's texts, split words joined or apart."""
    x = "text"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre)\\b[^<>]*>', ' ', 'g'), '</?[A-Za-z][^<>]*>|<!--(?s:.*?)-->', '', 'g')"
    x = f"translate({x}, (SELECT string_agg(chr(CAST(k AS INTEGER)), '' ORDER BY k) FROM range(65281, 65375) r(k)), (SELECT string_agg(chr(CAST(k - 65248 AS INTEGER)), '' ORDER BY k) FROM range(65281, 65375) r(k)))"
    for a, b in ((0xFB00, "ff"), (0xFB01, "fi"), (0xFB02, "fl"), (0xFB03, "ffi"), (0xFB04, "ffl")):
        x = f"replace({x}, chr({a}), '{b}')"
    unseen = "\\x{34F}\\x{61C}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}"
    x = f"lower(regexp_replace(regexp_replace({x}, '[{unseen}]', '', 'g'), '\\*\\*|__|~~|\\]\\([^)\\s]*\\)|\\\\[A-Za-z]+\\{{', '', 'g'))"
    x = f"regexp_replace({x}, '([\\pL\\pN]+)[-\\x{{AD}}\\x{{2010}}-\\x{{2013}}][ \\t]*\\r?\\n[\\s>|]*([\\pL\\pN]+)', '\\1{'' if joined else ' '}\\2', 'g')"
    x = f"replace({x}, chr(173), '')"
    return f"(SELECT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all({x}, '[\\pL\\pN]+') AS w FROM {table_} WHERE text <> '')))"


# Split words all joined, and all apart: passages in which some are read one way and some the other aren't expressed.
ORACLE["p7_found"] = f"""WITH i AS {_grams('eval_items', 'item_id', True)}, d AS (SELECT * FROM {_grams('documents', 'doc_id', True)} UNION ALL SELECT * FROM {_grams('documents', 'doc_id', False)})
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.g = i.g"""
