"""Traces, peaks and features of time series, over event signals; array kernels over embeddings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import arrays
from ionloom.operators import extract, features, traces
from ionloom.queries import standins as S
from ionloom.queries.standins import ACC, CELLS, TRACES
from ionloom.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {ACC} SELECT query_id, cycle, round(dot, 4) AS dot, CAST(norm2 AS BIGINT) AS norm2, round(sqrt_sum, 4) AS sqrt_sum, CAST(raw AS BIGINT) AS raw, round(ln_sum, 4) AS ln_sum FROM acc")
def a09_cycle_accumulators(spark: SparkSession, sf: str) -> DataFrame:
    a = traces.accumulators(S.cells(spark, sf), S.expected(spark))
    return a.select("query_id", "cycle", F.round("dot", 4).alias("dot"), F.col("norm2").cast("long").alias("norm2"), F.round("sqrt_sum", 4).alias("sqrt_sum"), F.col("raw").cast("long").alias("raw"), F.round("ln_sum", 4).alias("ln_sum"))


@query(f"WITH {CELLS} SELECT query_id, cycle, CAST(sum(intensity) AS BIGINT) AS intensity FROM cells WHERE ion IN ('click', 'view') GROUP BY 1, 2")
def a10_precursor_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Summed signal of the isotopes from 0 up (here two of the kinds)."""
    return S.cells(spark, sf).filter(F.col("ion").isin("click", "view")).groupBy("query_id", "cycle").agg(F.sum("intensity").alias("intensity"))


@query(f"WITH {TRACES} SELECT query_id, cycle, round(cosine, 6) AS cosine, round(scribe, 5) AS scribe, round(lazyscore, 4) AS lazyscore, round(log_intensity, 6) AS log_intensity FROM traces")
def w01_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine, scribe, lazyscore and log intensity per cycle."""
    return S.event_traces(spark, sf).select("query_id", "cycle", *r6("cosine"), F.round("scribe", 5).alias("scribe"), F.round("lazyscore", 4).alias("lazyscore"), *r6("log_intensity"))


@query(f"WITH {TRACES} SELECT query_id, cycle, round(apex_profile, 5) AS apex_profile, round(cosine_profile, 5) AS cosine_profile, round(scribe_profile, 4) + 0.0 AS scribe_profile FROM prof")
def w05_apex_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile peaks are picked on, blurred twice, and its two companions."""
    return S.event_traces(spark, sf).select("query_id", "cycle", F.round("apex_profile", 5).alias("apex_profile"), F.round("cosine_profile", 5).alias("cosine_profile"), F.round("scribe_profile", 4).alias("scribe_profile"))


PEAK = f"""{TRACES},
apex AS (SELECT query_id, cycle AS apex, apex_profile AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY apex_profile DESC, cycle) AS k FROM prof) WHERE k = 1),
st AS (SELECT t.query_id, t.cycle, t.lazyscore, lag(lazyscore) OVER w AS b, lead(lazyscore) OVER w AS n FROM traces t WINDOW w AS (PARTITION BY query_id ORDER BY cycle)),
w1 AS (SELECT a.query_id, a.apex, any_value(a.v) AS v, CAST(least(coalesce(min(apex - cycle) FILTER (cycle < apex AND lazyscore > n), max(apex - cycle) + 1), 10) AS INTEGER) AS rise,
  CAST(least(coalesce(min(cycle - apex) FILTER (cycle > apex AND lazyscore > b), max(cycle - apex) + 1), 10) AS INTEGER) AS fall FROM apex a JOIN st ON a.query_id = st.query_id GROUP BY 1, 2)"""


@query(f"WITH {PEAK} SELECT query_id, apex, round(v, 5) AS apex_value, rise AS apex_rise, fall AS apex_fall FROM w1")
def w08_peak_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Apex of each query and its rise and fall."""
    t = S.event_traces(spark, sf)
    p = traces.steps(t, traces.pick(t, "apex_profile", "apex"), "apex")
    return p.select("query_id", "apex", F.round("apex_value", 5).alias("apex_value"), "apex_rise", "apex_fall")


NEXT = f"""{PEAK},
m1 AS (SELECT p.query_id, p.cycle, p.apex_profile FROM prof p JOIN w1 ON p.query_id = w1.query_id AND (p.cycle < apex - 2 * rise OR p.cycle > apex + 2 * fall)),
sec AS (SELECT query_id, cycle AS apex, apex_profile AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY apex_profile DESC, cycle) AS k FROM m1) WHERE k = 1),
w2 AS (SELECT a.query_id, a.apex, any_value(a.v) AS v, least(coalesce(min(apex - cycle) FILTER (cycle < apex AND lazyscore > n), max(apex - cycle) + 1), 10) AS rise,
  least(coalesce(min(cycle - apex) FILTER (cycle > apex AND lazyscore > b), max(cycle - apex) + 1), 10) AS fall FROM sec a JOIN st ON a.query_id = st.query_id GROUP BY 1, 2),
thr AS (SELECT m1.query_id, max(m1.apex_profile) AS v FROM m1 JOIN w2 ON m1.query_id = w2.query_id AND (m1.cycle < apex - rise OR m1.cycle > apex + fall) GROUP BY 1)"""


@query(f"WITH {NEXT} SELECT w1.query_id, round(w1.v - w2.v, 5) AS delta_next, round(w1.v - thr.v, 5) AS delta_second_next FROM w1 LEFT JOIN w2 ON w1.query_id = w2.query_id LEFT JOIN thr ON w1.query_id = thr.query_id")
def w11_delta_next(spark: SparkSession, sf: str) -> DataFrame:
    """How far the second and third peak lie below the first, with what is around each masked."""
    return traces.peaks(S.event_traces(spark, sf)).select("query_id", F.round("delta_next", 5).alias("delta_next"), F.round("delta_second_next", 5).alias("delta_second_next"))


@query(f"""WITH {PEAK}, ring AS (SELECT w1.query_id, greatest(coalesce(avg(lazyscore) FILTER (d BETWEEN -4 * rise AND 4 * fall AND NOT d BETWEEN -2 * rise AND 2 * fall), 1.0), 1.0) AS lam, max(lazyscore) FILTER (d = 0) AS x
FROM (SELECT w1.*, traces.lazyscore, traces.cycle - apex AS d FROM w1 JOIN traces ON w1.query_id = traces.query_id) w1 GROUP BY 1) SELECT query_id, round(lam, 4) AS lambda, round(x / greatest(sqrt(lam), 1.0), 4) AS lazy_z, round(x / lam, 4) AS lazy_ratio FROM ring""")
def w12_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline around the peak, and the apex against it."""
    t = S.event_traces(spark, sf)
    return traces.baseline(t, traces.peaks(t)).select("query_id", *[F.round(c, 4).alias(c) for c in ("lambda", "lazy_z", "lazy_ratio")])


@query(f"""WITH {CELLS}, axis AS (SELECT DISTINCT user_id AS query_id, CAST(k AS INTEGER) AS cycle FROM events, range(120) AS r(k)),
d AS (SELECT a.query_id, a.cycle, coalesce(sum(intensity) FILTER (ion = 'click'), 0) AS x, coalesce(sum(intensity) FILTER (ion = 'view'), 0) AS y FROM axis a LEFT JOIN cells c ON a.query_id = c.query_id AND a.cycle = c.cycle GROUP BY 1, 2)
SELECT query_id, cycle, round(CASE WHEN n = 11 AND xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END, 6) AS rolling FROM (
  SELECT query_id, cycle, count(*) OVER w AS n, CAST(sum(x * y) OVER w AS DOUBLE) AS xy, CAST(sum(x * x) OVER w AS DOUBLE) AS xx, CAST(sum(y * y) OVER w AS DOUBLE) AS yy FROM d WINDOW w AS (PARTITION BY query_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))""")
def w14_rolling_cosine(spark: SparkSession, sf: str) -> DataFrame:
    c = S.axis(spark, sf).join(S.cells(spark, sf), ["query_id", "cycle"], "left").groupBy("query_id", "cycle").agg(*[F.coalesce(F.sum(F.when(F.col("ion") == k, F.col("intensity"))), F.lit(0)).alias(n) for n, k in (("x", "click"), ("y", "view"))])
    return traces.rolling_cosine(c, "x", "y", 5).select("query_id", "cycle", *r6("rolling"))


@query(f"""WITH {TRACES}, c AS (SELECT query_id, cycle, lag(log_intensity, 2) OVER w * 0.1 + lag(log_intensity, 1) OVER w * 0.2 + log_intensity * 0.4 + lead(log_intensity, 1) OVER w * 0.2 + lead(log_intensity, 2) OVER w * 0.1 AS v FROM traces WINDOW w AS (PARTITION BY query_id ORDER BY cycle))
SELECT query_id, cycle, round(coalesce(v, 0), 6) AS smooth FROM c""")
def w17_convolution(spark: SparkSession, sf: str) -> DataFrame:
    """A kernel over whole windows, 0 at the ends."""
    return traces.convolve_rows(S.event_traces(spark, sf), "log_intensity", [0.1, 0.2, 0.4, 0.2, 0.1], "smooth").select("query_id", "cycle", *r6("smooth"))


def _smoothed(weights: list[float], half: int) -> str:
    """SQL of a weighted mean around each place: left of the start the first value, beyond the end nothing."""
    pairs = ", ".join(f"{{'o': {k - half}, 'w': CAST({w!r} AS DOUBLE)}}" for k, w in enumerate(weights))
    return f"""SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS place, unnest(list_transform(range(1, len(embedding) + 1), lambda i: round(
  list_sum(list_transform(list_filter([{pairs}], lambda s: i + s.o <= len(embedding)), lambda s: s.w * embedding[greatest(i + s.o, 1)])) / list_sum(list_transform(list_filter([{pairs}], lambda s: i + s.o <= len(embedding)), lambda s: s.w)), 6))) AS smooth FROM embeddings"""


@query(_smoothed([max(0.0, 1 - (abs(k - 3) / 3) ** 2) for k in range(7)], 3))
def w16_polynomial_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector smoothed by weights that fall with the square of the distance."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(traces.polynomial_smoothed(F.col("embedding"), 7, 2)).alias("place", "x"))
    return e.select("vec_id", "place", F.round("x", 6).alias("smooth"))


@query(_smoothed([math.exp(-(k * k) / 4.5) for k in range(-5, 6)], 5))
def w15_gaussian_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector smoothed by a Gaussian with its left edge repeated."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(traces.gaussian_smoothed(F.col("embedding"), 1.5)).alias("place", "x"))
    return e.select("vec_id", "place", F.round("x", 6).alias("smooth"))


OG = """pt AS (SELECT least(greatest(CAST(floor((date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) / 2500.0 * 20) AS INTEGER), 0), 19) AS gx, least(greatest(CAST(floor(o_totalprice / 500000.0 * 20) AS INTEGER), 0), 19) AS gy FROM orders), g AS (SELECT gx, gy, count(*) AS weight FROM pt GROUP BY 1, 2)"""


def order_grid(spark: SparkSession, sf: str) -> DataFrame:
    from ionloom.operators.calibrate import grid

    p = table(spark, sf, "orders").select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("library"), F.col("o_totalprice").alias("observed"), F.lit(1.0).alias("weight"))
    return grid(p, 20, (0.0, 2500.0), (0.0, 500000.0))


@query(f"""WITH {OG}, k AS (SELECT a.k AS dx, b.k AS dy FROM (VALUES (-1), (0), (1)) a(k), (VALUES (-1), (0), (1)) b(k)), cell AS (SELECT x.k AS gx, y.k AS gy FROM range(20) x(k), range(20) y(k))
SELECT * FROM (SELECT CAST(cell.gx AS INTEGER) AS gx, CAST(cell.gy AS INTEGER) AS gy, round(sum(coalesce(g.weight, 0) * CASE WHEN dx = 0 AND dy = 0 THEN 0.2 ELSE 0.1 END), 4) AS weight FROM cell, k LEFT JOIN g ON g.gx = least(greatest(cell.gx + dx, 0), 19) AND g.gy = least(greatest(cell.gy + dy, 0), 19) GROUP BY 1, 2) WHERE weight > 0""")
def w18_grid_convolution(spark: SparkSession, sf: str) -> DataFrame:
    """3 x 3 smoothing of a weight grid with clamped edges."""
    return traces.convolve_grid(order_grid(spark, sf), 20).select("gx", "gy", F.round("weight", 4).alias("weight"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x04_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""WITH x AS (SELECT a.vec_id, unnest(CAST(a.embedding AS DOUBLE[])) AS x, unnest(CAST(b.embedding AS DOUBLE[])) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(corr(x, y), 6) AS pearson FROM x GROUP BY 1""")
def x05_pearson(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(arrays.pearson(F.col("embedding"), F.col("other")), 6).alias("pearson"))


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS place FROM embeddings), m AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM x)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)), 6) AS value FROM m""")
def x06_centre_normalise(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.centred(F.col("embedding"))).alias("place", "value"))
    return n.select("vec_id", "place", *r6("value"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM embeddings")
def x09_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).cast("int").alias("place"))


@query("SELECT label, CAST(k AS INTEGER) AS place, round(exp(-(k - 10) * (k - 10) / (2.0 * (1 + label) * (1 + label))), 6) AS value FROM (SELECT DISTINCT label FROM embeddings), range(21) r(k)")
def x08_gaussian_reference(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "embeddings").select("label").distinct()
    return g.select("label", F.posexplode(arrays.gaussian(F.lit(21), F.lit(10), (1.0 + F.col("label")))).alias("place", "value")).select("label", "place", *r6("value"))


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), n AS (SELECT vec_id, sum(ln(greatest(abs(v) * 1000, 1.0))) AS s FROM x GROUP BY 1)
SELECT vec_id, round(CASE WHEN s < 1 THEN 0.0 ELSE s * ln(s) - s + 0.5 * ln(s) + 0.918938533204672742 END, 4) AS lazyscore FROM n""")
def x03_lazyscore(spark: SparkSession, sf: str) -> DataFrame:
    """Stirling's ln n! of summed logarithms."""
    from ionloom.functions.chemistry import lazyscore

    return table(spark, sf, "embeddings").select("vec_id", F.round(lazyscore(F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000)), 4).alias("lazyscore"))


@query("SELECT label, round(exp(avg(ln(abs(v)))), 6) AS log_mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) WHERE v <> 0 GROUP BY 1")
def a25_log_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v")).filter("v <> 0")
    return e.groupBy("label").agg(F.round(F.exp(F.avg(F.log(F.abs(F.col("v").cast("double"))))), 6).alias("log_mean"))


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS place FROM embeddings) SELECT a.vec_id, CAST(b.place AS INTEGER) AS row_j, round(max(a.v) - max(b.v), 6) AS diff FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.place = b.place + 1 GROUP BY a.vec_id, b.place""")
def h01_row_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A function of each row and the one before it."""
    v = F.col("embedding")
    d = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(v, i).cast("double") - F.get(v, i - 1).cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(d).alias("row_j", "diff")).select("vec_id", "row_j", *r6("diff"))


@query("SELECT vec_id, unnest(range(10))::INTEGER AS place, unnest(embedding[11:20]) AS value FROM embeddings")
def h05_slice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 11, 10)).alias("place", "value"))


def scored_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of the elution scores: chromatograms, profiles and apex of each user's events."""
    t = S.event_traces(spark, sf)
    axis = S.axis(spark, sf).groupBy("query_id").agg(F.min("cycle").alias("cycle_lo"), F.max("cycle").alias("cycle_hi"))
    e = S.expected(spark)
    ions = axis.withColumn("ion", F.explode(F.array(*[F.lit(x) for x in sorted(S.EXPECTED)])))
    c = extract.chromatograms(ions, S.cells(spark, sf)).join(F.broadcast(e), "ion")
    frag = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ion", "chromatogram", "expected"))).alias("f"))
    prof = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cycle", "cosine_profile", "scribe_profile"))).alias("p"))
    apex = traces.pick(t, "apex_profile", "apex")
    pre = F.filter("f", lambda x: x.ion.isin("click", "purchase", "view"))
    return frag.join(prof, "query_id").join(apex, "query_id").select("query_id", "apex", F.col("f.chromatogram").alias("fragments"), F.col("f.expected").alias("expected"), F.transform(pre, lambda x: x.chromatogram).alias("precursors"), F.transform(pre, lambda x: x.expected).alias("expected_precursors"), F.col("p.cosine_profile").alias("cosine_profile"), F.col("p.scribe_profile").alias("scribe_profile"))


@query()
def x37_elution_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Split product, the eleven features and the weighted score (X34-X38, FWHM X7)."""
    return features.scores(scored_queries(spark, sf))


@query(f"""WITH {TRACES}, top AS (SELECT query_id, cycle AS pk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine_profile DESC, cycle) AS k FROM prof) WHERE k = 1)
SELECT p.query_id, round(CASE WHEN sum(cosine_profile) > 0 THEN sum(cosine_profile) FILTER (abs(cycle - pk) <= 5) * (1 + 200 * sum(cosine_profile) FILTER (abs(cycle - pk) <= 5) / sum(cosine_profile)) ELSE 0 END, 3) AS area_uniqueness FROM prof p JOIN top ON p.query_id = top.query_id GROUP BY 1""")
def x34_area_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    t = S.event_traces(spark, sf)
    j = t.join(traces.pick(t, "cosine_profile", "at"), "query_id")
    peak, total = F.sum(F.when(F.abs(F.col("cycle") - F.col("at")) <= 5, F.col("cosine_profile"))), F.sum("cosine_profile")
    return j.groupBy("query_id").agg(F.round(F.when(total > 0, peak * (1 + 200 * peak / total)).otherwise(0.0), 3).alias("area_uniqueness"))


@query(f"""WITH {PEAK}, c AS (SELECT w1.query_id, c.intensity FROM w1 JOIN cells c ON w1.query_id = c.query_id AND c.cycle = w1.apex WHERE c.intensity > 0) SELECT w1.query_id, CAST(coalesce(sum(intensity), 0) AS BIGINT) AS intensity, count(c.intensity) AS n FROM w1 LEFT JOIN c ON w1.query_id = c.query_id GROUP BY 1""")
def a11_apex_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Signal and ions with signal at the apex."""
    apex = traces.pick(S.event_traces(spark, sf), "apex_profile", "apex").select("query_id", F.col("apex").alias("cycle"))
    j = apex.join(S.cells(spark, sf).filter("intensity > 0"), ["query_id", "cycle"], "left")
    return j.groupBy("query_id").agg(F.coalesce(F.sum("intensity"), F.lit(0)).alias("intensity"), F.count("intensity").alias("n"))


@query(f"WITH {CELLS}, t AS (SELECT query_id, ion, sum(intensity) AS w FROM cells GROUP BY 1, 2) SELECT query_id, ion, round(ln(1 + w) - ln(1 + sum(w) OVER (PARTITION BY query_id)), 6) AS relative FROM t WHERE w > 0")
def x27_relative_intensity(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    t = S.cells(spark, sf).groupBy("query_id", "ion").agg(F.sum("intensity").alias("w")).filter("w > 0")
    return t.select("query_id", "ion", F.round(F.log1p("w") - F.log1p(F.sum("w").over(Window.partitionBy("query_id"))), 6).alias("relative"))


ROWS_SQL = "r AS (SELECT l_orderkey AS id, list([l_quantity, l_linenumber] ORDER BY l_linenumber, l_quantity) AS m FROM lineitem GROUP BY 1)"


@query(f"""WITH {ROWS_SQL}, e AS (
SELECT id, 'drop' AS edit, m[2:] AS m FROM r UNION ALL SELECT id, 'swap', CASE WHEN len(m) > 1 THEN [m[2], m[1]] || m[3:] ELSE m END FROM r UNION ALL SELECT id, 'replace', [[CAST(0 AS DOUBLE), 9]] || m[2:] FROM r
UNION ALL SELECT id, 'put', [[m[1][1], CAST(-1 AS DOUBLE)]] || m[2:] FROM r) SELECT id, edit, array_to_string(list_transform(flatten(m), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS cells FROM e""")
def h03_row_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table in an array dropped, swapped and replaced, and one value put."""
    li = table(spark, sf, "lineitem")
    r = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("v")))).alias("s")).select("id", F.col("s.v").alias("m"))
    zero, one = F.lit(0), F.lit(1)
    edits = {"drop": arrays.drop_row(F.col("m"), zero), "swap": arrays.swap_rows(F.col("m"), zero, one), "replace": arrays.replace_row(F.col("m"), zero, F.array(F.lit(0.0), F.lit(9.0))), "put": arrays.put_value(F.col("m"), zero, one, F.lit(-1.0))}
    e = r.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("edit"), c.alias("m")) for k, c in edits.items()])))
    return e.select("id", "edit", F.array_join(F.transform(F.flatten("m"), lambda x: x.cast("long").cast("string")), ",").alias("cells"))


@query("SELECT l_orderkey AS id, string_agg('y' || l_linenumber, ',' ORDER BY l_linenumber) AS labels FROM lineitem GROUP BY 1")
def out03_label_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every fragment of a group mapped to another kind."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("label"), F.col("l_extendedprice").alias("mz")))).alias("f"))
    cast = arrays.map_labels(F.col("f"), "label", lambda x: F.concat(F.lit("y"), x.cast("string")))
    return g.select("id", F.array_join(F.transform(cast, lambda x: x.label), ",").alias("labels"))
