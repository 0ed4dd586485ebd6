"""The registered queries, each over its whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.functions import html, timestamps
from kinetext.functions import text as tx
from kinetext.functions import vectors as vx
from kinetext.operators import classify, compare, drift, projection, scores, sentences
from kinetext.operators import kinematics as km
from kinetext.operators.embedding import EmbeddingCache, HashBackend
from kinetext.plans import api
from kinetext.sources import pairs as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Vectors of the embeddings table move little in acceleration; spikes are looked for from here on.
SPIKE = 0.05


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return api.as_sequence(read(spark, d, "embeddings"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


# --- SQL pieces ------------------------------------------------------------------------------------------------------

SEQ = """seq AS (SELECT label AS doc_id, vec_id AS pos, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS e
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""
TOKENS = "regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]+')"
COUNTS = "list_transform(range(64), lambda d: len(list_filter(list_transform(" + TOKENS + ", lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64), lambda b: b = d))::DOUBLE)"
UNIT = "CASE WHEN list_inner_product({c}, {c}) = 0 THEN {c} ELSE list_transform({c}, lambda x: x / sqrt(list_inner_product({c}, {c}))) END"
_HELD = f"regexp_replace(coalesce(text, ''), '{sentences.HOLD[0]}', '\\1\\2' || chr(1), 'g')"
_MARKED = "regexp_replace(" + _HELD + ", '" + sentences.MARK[0].replace("'", "''") + "', '\\1' || chr(2), 'g')"
SENTENCES = f"list_filter(list_transform(string_split({_MARKED}, chr(2)), lambda s: replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), chr(1), '.')), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"
SENT = f"sent AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))"


def hashed(rows: str, t: str, keep: str) -> str:
    """A relation with column ``e``, the hash vector of ``t``."""
    return f"(SELECT {keep}, {UNIT.format(c='c')} AS e FROM (SELECT {keep}, {COUNTS.format(t=t)} AS c FROM {rows}))"


DOCSEQ = f"{SENT}, seq AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n, e FROM {hashed('sent', 'sentence', 'doc_id, pos')})"
CONVSEQ = f"seq AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n, e FROM {hashed('(SELECT conv_id AS doc_id, turn AS pos, text FROM conversations)', 'text', 'doc_id, pos')})"
NORM = "sqrt(list_inner_product({0}, {0}))"
MOTION = f"""m1 AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
m2 AS (SELECT *, list_transform(list_zip(e, coalesce(e1, e)), lambda x: x[1] - x[2]) AS d FROM m1),
m3 AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN {NORM.format('d')} END AS v FROM m2),
m4 AS (SELECT *, lag(v) OVER w AS v1, coalesce(lag(d) OVER w, d) AS d1 FROM m3 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
mo AS (SELECT doc_id, pos, p, n, e, v, v1, abs(v - v1) AS a,
  CASE WHEN e2 IS NOT NULL THEN CASE WHEN {NORM.format('d')} < 1e-10 OR {NORM.format('d1')} < 1e-10 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, list_inner_product(d, d1) / ({NORM.format('d')} * {NORM.format('d1')})))) END END AS k,
  CASE WHEN e2 IS NOT NULL AND {NORM.format('e')} > 1e-10 AND {NORM.format('coalesce(e2, e)')} > 1e-10 THEN list_inner_product(e, coalesce(e2, e)) / ({NORM.format('e')} * {NORM.format('coalesce(e2, e)')}) END AS lag2 FROM m4)"""


def spiked(threshold: float) -> str:
    return f"""s1 AS (SELECT *, lag(a) OVER w AS b, lead(a) OVER w AS f FROM mo WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
s2 AS (SELECT *, CASE WHEN b IS NULL AND f IS NULL THEN NULL WHEN b IS NULL THEN f WHEN f IS NULL THEN b ELSE (b + f) / 2 END AS near FROM s1),
sp AS (SELECT *, p - 2 AS i, CASE WHEN near IS NULL THEN 0.5 ELSE greatest(0.0, tanh(2 * (a - near) / (a + 0.01))) END AS iso, (p - 2) / greatest(n - 3, 1) AS ratio, coalesce(a >= {threshold}, false) AS spike FROM s2)"""


MEASURE = """u AS (SELECT doc_id, k, sum(x) AS s, count(*) AS m FROM (SELECT doc_id, unnest(range(len(e))) AS k, unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) AS x
  FROM seq WHERE sqrt(list_inner_product(e, e)) > 1e-10) GROUP BY ALL),
pw AS (SELECT doc_id, CASE WHEN max(m) > 1 THEN (sum(s * s) - max(m)) / (max(m) * (max(m) - 1)) ELSE 0 END AS pairwise FROM u GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, count(v) AS nv, count(a) AS na, coalesce(avg(v), 0) AS mv, coalesce(var_pop(v), 0) AS vv, coalesce(sum(v), 0) AS path, coalesce(avg(a), 0) AS ma, coalesce(var_pop(a), 0) AS va,
  coalesce(max(a), 0) AS xa, coalesce(max(k), 0) AS xk, coalesce(arg_max(i, {'x': round(a, 9), 'p': -p}) FILTER (a IS NOT NULL), 0) AS ia, coalesce(arg_max(i, {'x': round(k, 9), 'p': -p}) FILTER (k IS NOT NULL) + 1, 0) AS ik, count(*) FILTER (spike) AS ns, coalesce(avg(iso) FILTER (spike), 0) AS isolation, max(a) FILTER (spike) AS top, avg(a) FILTER (NOT spike) AS calm,
  max(a) FILTER (NOT spike) AS calm_top, avg(lag2) AS lag2, arg_min(e, p) AS e0, arg_max(e, p) AS e1, avg(CASE WHEN v1 IS NOT NULL THEN (v1 - v > 1e-12)::INT END) AS falling, regr_slope(v, p) FILTER (v IS NOT NULL) AS slope
  FROM sp GROUP BY doc_id),
h AS (SELECT g.*, pairwise,
  CASE WHEN na < 2 THEN 0 ELSE greatest(0.0, least(1.0, 0.25 * (1 - least(3.0 * ns / na, 1.0)) + 0.35 * isolation + 0.20 * coalesce(1 - least(calm / 0.3, 1.0), 0) + 0.20 * coalesce(tanh(2 * (top - calm_top) / (top + 0.01)), 0))) END AS deadpan,
  CASE WHEN lag2 IS NULL THEN 0 ELSE greatest(0.0, least(1.0, (lag2 - 0.3) / 0.5)) END AS circ,
  CASE WHEN g.n < 2 THEN 0 ELSE greatest(0.0, least(1.0, 0.6 * CASE WHEN coalesce(pairwise, 0) = 0 THEN 0 ELSE greatest(0.0, least(1.0, (pairwise - 0.3) / 0.5)) END
    + 0.4 * CASE WHEN sqrt(list_inner_product(e0, e0)) <= 1e-10 OR sqrt(list_inner_product(e1, e1)) <= 1e-10 THEN 0 ELSE 1 - least(list_distance(e0, e1) / (path + 0.01), 1.0) END)) END AS taut,
  CASE WHEN nv < 2 THEN 0 ELSE greatest(0.0, least(1.0, 0.6 * falling + 0.4 * CASE WHEN nv < 3 THEN 0.5 WHEN abs(slope) < 1e-12 THEN 0 WHEN slope < -0.05 THEN 1.0 WHEN slope < 0 THEN 0.5 ELSE 0 END)) END AS decel
  FROM g LEFT JOIN pw USING (doc_id)),
me AS (SELECT *, greatest(0.0, least(1.0, 0.35 * circ + 0.40 * taut + 0.25 * decel)) AS heller FROM h)"""

METRICS = ["mean_velocity", "velocity_variance", "mean_acceleration", "acceleration_variance", "max_acceleration", "max_acceleration_index", "max_curvature", "max_curvature_index"]
SCORES = ["deadpan_score", "circularity_score", "tautology_density", "deceleration_score", "heller_score"]
_METRICS = dict(zip([*METRICS, "n_spikes", *SCORES], ["round(mv, 4)", "round(vv, 6)", "round(ma, 4)", "round(va, 6)", "round(xa, 4)", "ia", "round(xk, 4)", "ik", "ns", "round(deadpan, 4)", "round(circ, 4)", "round(taut, 4)", "round(decel, 4)", "round(heller, 4)"], strict=True))
_SAID = {
    "spike_interpretation": "CASE WHEN deadpan > 0.6 THEN 'Strong isolated spikes against steady background' WHEN deadpan > 0.4 THEN 'Moderate isolated spike pattern' ELSE 'Weak or no isolated spike pattern' END",
    "circularity_interpretation": "CASE WHEN heller > 0.5 THEN 'Strong circular/repetitive structure with deceleration' WHEN heller > 0.3 THEN 'Moderate circular structure' ELSE 'Weak or no circular structure' END",
}
FEW = "CASE WHEN n < 2 THEN 'Need at least 2 sentences, got ' || n END"


def report_sql(rows: str, error: str = FEW) -> str:
    """The report of ``rows``, a relation with the columns of ``me``; under two sentences only the error."""
    return f"SELECT doc_id, n AS n_sentences, {', '.join(f'CASE WHEN n >= 2 THEN {x} END AS {c}' for c, x in (_METRICS | _SAID).items())}, {error} AS error FROM {rows}"


REPORT = report_sql("me")
DOCUMENT_REPORT = report_sql("documents LEFT JOIN me USING (doc_id)", f"CASE WHEN coalesce(text, '') = '' THEN 'No text provided' WHEN n IS NULL THEN 'Need at least 2 sentences, got 0' ELSE {FEW} END")


def reported(r: DataFrame) -> DataFrame:
    n = F.when(F.col("acceleration_spikes").isNotNull(), F.size("acceleration_spikes")).cast("bigint").alias("n_spikes")
    return r.select("doc_id", F.col("n_sentences").cast("bigint").alias("n_sentences"), *[F.col(c).cast("bigint").alias(c) if c.endswith("index") else c for c in METRICS], n, *SCORES, *_SAID, "error")


# --- motion ----------------------------------------------------------------------------------------------------------


@query(f"WITH {SEQ}, {MOTION} SELECT doc_id, p - 1 AS x, round(v, 6) AS velocity FROM mo WHERE v IS NOT NULL")
def velocity_profile(spark, d):
    return km.motion(vectors(spark, d)).filter("v is not null").select("doc_id", (F.col("p") - 1).cast("bigint").alias("x"), F.round("v", 6).alias("velocity"))


@query(f"WITH {SEQ}, {MOTION} SELECT doc_id, p - 2 AS x, round(a, 6) AS acceleration FROM mo WHERE a IS NOT NULL")
def acceleration_profile(spark, d):
    return km.motion(vectors(spark, d)).filter("a is not null").select("doc_id", (F.col("p") - 2).cast("bigint").alias("x"), F.round("a", 6).alias("acceleration"))


@query(f"WITH {SEQ}, {MOTION} SELECT doc_id, p - 2 AS x, round(k, 6) AS curvature FROM mo WHERE k IS NOT NULL")
def curvature_profile(spark, d):
    return km.motion(vectors(spark, d)).filter("k is not null").select("doc_id", (F.col("p") - 2).cast("bigint").alias("x"), F.round("k", 6).alias("curvature"))


@query(f"WITH {SEQ}, {MOTION}, {spiked(SPIKE)} SELECT doc_id, i AS spike_index, round(a, 4) AS magnitude, round(iso, 4) AS isolation_score, round(ratio, 4) AS position_ratio FROM sp WHERE spike")
def spike_detection(spark, d):
    rows = km.spikes(km.motion(vectors(spark, d)), SPIKE).filter("spike")
    return rows.select("doc_id", F.col("i").cast("bigint").alias("spike_index"), F.round("a", 4).alias("magnitude"), F.round("iso", 4).alias("isolation_score"), F.round("ratio", 4).alias("position_ratio"))


@query(f"WITH {SEQ}, {MOTION}, {spiked(SPIKE)}, {MEASURE} {REPORT}")
def analyze_embeddings(spark, d):
    return reported(scores.report(scores.measure(vectors(spark, d), SPIKE)))


@query(f"WITH {DOCSEQ}, {MOTION}, {spiked(0.3)}, {MEASURE} {DOCUMENT_REPORT}")
def analyze_documents(spark, d):
    return reported(api.analyze_trajectory(texts(spark, d), HashBackend()))


@query(f"WITH {CONVSEQ}, {MOTION}, {spiked(0.3)}, {MEASURE} {REPORT}")
def analyze_conversations(spark, d):
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text").repartition(F.col("doc_id"))
    return reported(scores.report(scores.measure(HashBackend().embed(turns).select("doc_id", "pos", "e"), 0.3)))


def _score(column: str, short: str, label: str):
    @query(f"WITH {SEQ}, {MOTION}, {spiked(SPIKE)}, {MEASURE} SELECT doc_id, round({short}, 4) AS {label} FROM me", label)
    def run(spark, d):
        return scores.measure(vectors(spark, d), SPIKE).select("doc_id", F.round(column, 4).alias(label))


for _column, _short in (("deadpan_score", "deadpan"), ("circularity_score", "circ"), ("tautology_density", "taut"), ("deceleration_score", "decel"), ("heller_score", "heller")):
    _score(_column, _short, _column)


@query(f"WITH {SEQ} SELECT a.doc_id, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS pairwise FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.doc_id")
def pairwise_closed_form(spark, d):
    return scores.pairwise_mean(vectors(spark, d)).select("doc_id", F.round("pairwise", 6).alias("pairwise"))


@query(ORACLES["pairwise_closed_form"])
def pairwise_by_join(spark, d):
    return scores.pairwise_mean_by_join(vectors(spark, d)).select("doc_id", F.round("pairwise", 6).alias("pairwise"))


SMOOTH = f"""{SEQ.replace('seq AS', 'raw AS', 1)}, sm AS (SELECT doc_id, p, n, list(e) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS near FROM raw),
seq AS (SELECT doc_id, p, n - 2 AS n, list_transform(range(1, 65), lambda k: (near[1][k] + near[2][k] + near[3][k]) / 3) AS e FROM sm WHERE len(near) = 3)"""


@query(f"WITH {SMOOTH} SELECT doc_id, p, unnest(range(64)) AS k, round(unnest(e), 6) + 0.0 AS value FROM seq")
def smoothing_w3(spark, d):
    s = km.smooth(vectors(spark, d), 3)
    place = F.row_number().over(km._window("doc_id")) - 1
    s = s.select("doc_id", place.cast("bigint").alias("p"), "e").select("doc_id", "p", F.posexplode("e").alias("k", "value"))
    return s.select("doc_id", "p", F.col("k").cast("bigint").alias("k"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {SMOOTH.replace('SELECT doc_id, p, n - 2', 'SELECT doc_id, p AS pos, p, n - 2')}, {MOTION}, {spiked(SPIKE)}, {MEASURE} SELECT doc_id, n AS n_sentences, round(mv, 4) AS mean_velocity, round(deadpan, 4) AS deadpan_score, round(circ, 4) AS circularity_score, round(heller, 4) AS heller_score FROM me")
def recompute_smoothed(spark, d):
    return scores.recompute(vectors(spark, d), 3, SPIKE).select("doc_id", F.col("n_sentences").cast("bigint").alias("n_sentences"), "mean_velocity", "deadpan_score", "circularity_score", "heller_score")


SMOOTHED = SMOOTH.replace("SELECT doc_id, p, n - 2", "SELECT doc_id, p AS pos, p, n - 2")


@query(f"""WITH {SMOOTHED}, {MOTION}, {spiked(SPIKE)}, {MEASURE}, y AS (SELECT doc_id AS id, n, round(deadpan, 4) AS isolation, round(heller, 4) AS circularity, ns AS spikes FROM me)
SELECT g.id AS golden_id, s.id AS synthetic_id, g.n AS golden_n, g.isolation AS golden_isolation, g.circularity AS golden_circularity, g.spikes AS golden_spikes, s.n AS synthetic_n, s.isolation AS synthetic_isolation, s.circularity AS synthetic_circularity, s.spikes AS synthetic_spikes,
  CASE WHEN least(g.n, s.n) < 3 THEN 'Window too large for passage lengths' END AS error FROM y g JOIN y s ON s.id = g.id + 1""")
def recompute_comparison(spark, d):
    seq = vectors(spark, d)
    out = scores.recompute_pair(seq, seq, _neighbours(spark, d), 3, SPIKE)
    side = lambda x: [F.col(f"{x}_summary.{c}").cast(t).alias(f"{x}_{name}") for c, name, t in (("n_sentences", "n", "bigint"), ("spike_isolation", "isolation", "double"), ("circularity", "circularity", "double"), ("n_spikes", "spikes", "bigint"))]
    return out.select("golden_id", "synthetic_id", *side("golden"), *side("synthetic"), "error")


# --- comparison ------------------------------------------------------------------------------------------------------


def compare_sql(seq: str, threshold: float, pairs: str) -> str:
    """A whole comparison by definition, with ``pairs`` a relation (pair_id, golden_id, synthetic_id): warping row by row, matching spike by spike."""
    return f"""WITH RECURSIVE {seq}, {MOTION}, {spiked(threshold)}, {MEASURE},
ls AS (SELECT doc_id, coalesce(list(a ORDER BY p) FILTER (a IS NOT NULL), []) AS acc, coalesce(list(ratio ORDER BY p) FILTER (spike), []) AS places FROM sp GROUP BY doc_id),
pf AS (SELECT me.*, acc, places FROM me JOIN ls USING (doc_id)),
pr AS (SELECT x.pair_id, x.golden_id, x.synthetic_id, g.n AS gn, s.n AS sn, g.ns AS ng, s.ns AS nsy, g.acc AS ga, s.acc AS sa, g.places AS gp, s.places AS spl, g.deadpan AS gd, g.heller AS gh, s.deadpan AS sd, s.heller AS sh, s.isolation AS si
  FROM {pairs} x JOIN pf g ON g.doc_id = x.golden_id JOIN pf s ON s.doc_id = x.synthetic_id),
r(pair_id, i, lat) AS (
  SELECT pair_id, 0, list_prepend(0::DOUBLE, list_transform(range(1, len(sa) + 1), lambda x: 'inf'::DOUBLE)) FROM pr
  UNION ALL
  SELECT r.pair_id, i + 1, list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, len(sa) + 1), lambda j: [j::DOUBLE])),
    lambda acc, j: list_append(acc, abs(ga[i + 1] - sa[j[1]::INT]) + least(lat[j[1]::INT + 1], acc[j[1]::INT], lat[j[1]::INT]))) FROM r JOIN pr USING (pair_id) WHERE i < len(ga) AND len(sa) > 0),
w AS (SELECT pair_id, lat[len(sa) + 1] / (len(ga) + len(sa) - 1) AS dtw FROM r JOIN pr USING (pair_id) WHERE i = len(ga) AND len(ga) > 0 AND len(sa) > 0),
q(pair_id, i, used, total) AS (
  SELECT pair_id, 0, []::BIGINT[], 0::DOUBLE FROM pr
  UNION ALL
  SELECT pair_id, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, total + CASE WHEN best IS NULL THEN 1.0 ELSE best.d END FROM (
    SELECT q.*, list_sort(list_transform(list_filter(range(1, len(spl) + 1), lambda j: NOT list_contains(used, j) AND abs(gp[i + 1] - spl[j]) < 1), lambda j: {{'d': abs(gp[i + 1] - spl[j]), 'j': j}}))[1] AS best
    FROM q JOIN pr USING (pair_id) WHERE i < len(gp))),
gm AS (SELECT pair_id, total FROM q JOIN pr USING (pair_id) WHERE i = len(gp)),
x AS (SELECT pair_id, ga, sa, greatest(len(ga), len(sa)) AS m, unnest(range(greatest(len(ga), len(sa)))) AS i FROM pr WHERE len(ga) > 1 AND len(sa) > 1),
y AS (SELECT pair_id, ga, sa, i * (len(ga) - 1) / (m - 1) AS xg, i * (len(sa) - 1) / (m - 1) AS xs FROM x),
z AS (SELECT pair_id, ga[floor(xg)::INT + 1] + (ga[least(floor(xg)::INT + 2, len(ga))] - ga[floor(xg)::INT + 1]) * (xg - floor(xg)) AS g, sa[floor(xs)::INT + 1] + (sa[least(floor(xs)::INT + 2, len(sa))] - sa[floor(xs)::INT + 1]) * (xs - floor(xs)) AS s FROM y),
co AS (SELECT pair_id, CASE WHEN stddev_pop(g) > 1e-10 AND stddev_pop(s) > 1e-10 THEN corr(g, s) ELSE 0 END AS corr FROM z GROUP BY pair_id),
cm AS (SELECT pair_id, golden_id, synthetic_id, gn, sn, ng, nsy, round(gd, 4) AS golden_deadpan, round(gh, 4) AS golden_heller, round(sd, 4) AS synthetic_deadpan, round(sh, 4) AS synthetic_heller, round(si, 4) AS synthetic_mean_isolation,
  round(coalesce(dtw, 'inf'::DOUBLE), 4) AS acceleration_dtw, round(coalesce(corr, 0), 4) AS acceleration_correlation,
  round(CASE WHEN ng > 0 AND nsy > 0 THEN 1 - least(total / ng + 0.2 * abs(ng - nsy), 1.0) WHEN ng = 0 AND nsy = 0 THEN 1.0 ELSE 0.0 END, 4) AS spike_position_match,
  round(CASE WHEN ng > 0 THEN least(ng, nsy) / greatest(ng, nsy) WHEN nsy = 0 THEN 1.0 ELSE 0.0 END, 4) AS spike_count_match FROM pr LEFT JOIN w USING (pair_id) LEFT JOIN gm USING (pair_id) LEFT JOIN co USING (pair_id)),
fi AS (SELECT *, round((0.30 * (1 - synthetic_deadpan) + 0.15 * (1 - synthetic_mean_isolation) + 0.20 * least(acceleration_dtw, 1.0) + 0.15 * (1 - greatest(acceleration_correlation, 0.0)) + 0.10 * (1 - spike_position_match) + 0.10 * (1 - spike_count_match))::DECIMAL(18, 8), 4)::DOUBLE AS fitness_score FROM cm),
fin AS (SELECT *, CASE WHEN fitness_score < 0.3 THEN 'Excellent structural match' WHEN fitness_score < 0.5 THEN 'Good match, some rhythm deviation' WHEN fitness_score < 0.7 THEN 'Moderate — structure present but weak' ELSE 'Poor match' END AS interpretation,
  CASE WHEN gn < 2 THEN 'Need at least 2 sentences, got ' || gn WHEN sn < 2 THEN 'Need at least 2 sentences, got ' || sn END AS error FROM fi)"""


COMPARED = ["synthetic_deadpan", "synthetic_heller", "synthetic_mean_isolation", "acceleration_dtw", "acceleration_correlation", "spike_position_match", "spike_count_match", "fitness_score", "interpretation"]
_SUMMARIES = "gn AS golden_n, sn AS synthetic_n, golden_deadpan, golden_heller, ng AS golden_spikes, nsy AS synthetic_spikes"
LABEL_PAIRS = "(SELECT DISTINCT a.label AS pair_id, a.label AS golden_id, b.label AS synthetic_id FROM embeddings a JOIN embeddings b ON b.label = a.label + 1)"
SOURCE_PAIRS = "(SELECT doc_id AS pair_id, doc_id AS synthetic_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id, text) AS golden_id FROM documents)"


def compared(out: DataFrame, *keys: str) -> DataFrame:
    of = lambda side, c, name, t: F.col(f"{side}_summary.{c}").cast(t).alias(name)
    r, c = "reference", "comparison"
    return out.select(*keys, *COMPARED, of(r, "n_sentences", "golden_n", "bigint"), of(c, "n_sentences", "synthetic_n", "bigint"), of(r, "deadpan_score", "golden_deadpan", "double"), of(r, "heller_score", "golden_heller", "double"), of(r, "n_spikes", "golden_spikes", "bigint"), of(c, "n_spikes", "synthetic_spikes", "bigint"), "error")


def _neighbours(spark, d):
    return read(spark, d, "embeddings").select(F.col("label").alias("golden_id"), (F.col("label") + 1).alias("synthetic_id")).distinct()


def _compared(spark, d):
    known = compare.profile_of(vectors(spark, d), SPIKE)
    return compare.compare(_neighbours(spark, d), known, known)


@query(f"{compare_sql(SEQ, SPIKE, LABEL_PAIRS)} SELECT golden_id, synthetic_id, {', '.join(COMPARED)}, {_SUMMARIES}, error FROM fin")
def compare_sequences(spark, d):
    return compared(_compared(spark, d), "golden_id", "synthetic_id")


@query(f"{compare_sql(SEQ, SPIKE, LABEL_PAIRS)} SELECT golden_id, synthetic_id, acceleration_dtw FROM fin")
def dtw_distance(spark, d):
    return _compared(spark, d).select("golden_id", "synthetic_id", "acceleration_dtw")


@query(f"{compare_sql(SEQ, SPIKE, LABEL_PAIRS)} SELECT golden_id, synthetic_id, acceleration_correlation FROM fin")
def acceleration_correlation(spark, d):
    return _compared(spark, d).select("golden_id", "synthetic_id", "acceleration_correlation")


@query(f"{compare_sql(SEQ, SPIKE, LABEL_PAIRS)} SELECT golden_id, synthetic_id, spike_position_match, spike_count_match FROM fin")
def compare_spike_counts(spark, d):
    return _compared(spark, d).select("golden_id", "synthetic_id", "spike_position_match", "spike_count_match")


# --- drift, classification -------------------------------------------------------------------------------------------

LABELS = "CASE WHEN {0} < 0.1 THEN 'Very similar (near-identical semantics)' WHEN {0} < 0.3 THEN 'Similar (related semantics)' WHEN {0} < 0.5 THEN 'Moderate drift (some semantic divergence)' WHEN {0} < 0.7 THEN 'Significant drift (different semantics)' ELSE 'High drift (unrelated or opposite semantics)' END"


@query(f"WITH {SEQ}, x AS (SELECT doc_id, p, 1 - list_cosine_similarity(e, lag(e) OVER (PARTITION BY doc_id ORDER BY p)) AS z FROM seq) SELECT doc_id, p, round(z, 4) AS drift, {LABELS.format('z')} AS interpretation FROM x WHERE z IS NOT NULL")
def vector_drift(spark, d):
    t = vectors(spark, d).withColumns({"p": F.row_number().over(km._window("doc_id")) - 1, "_e1": F.lag("e").over(km._window("doc_id"))}).filter("_e1 is not null")
    t = t.withColumn("z", vx.cosine_distance(F.col("e"), F.col("_e1")))
    return t.select("doc_id", F.col("p").cast("bigint").alias("p"), F.round("z", 4).alias("drift"), drift.interpretation(F.col("z")).alias("interpretation"))


TURNS = "(SELECT conv_id, turn, text AS text_b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text_a FROM conversations)"
DRIFTED = f"""WITH t AS (SELECT * FROM {TURNS} WHERE turn > 0), a AS {hashed('t', 'text_a', 'conv_id, turn, text_a, text_b')}, b AS {hashed('t', 'text_b', 'conv_id, turn')},
z AS (SELECT a.*, CASE WHEN list_inner_product(a.e, a.e) = 0 OR list_inner_product(b.e, b.e) = 0 THEN 1.0 ELSE 1 - list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) END AS z FROM a JOIN b USING (conv_id, turn))"""


def _turn_pairs(spark, d):
    from pyspark.sql import Window

    t = read(spark, d, "conversations").withColumn("text_a", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.filter("turn > 0").select("conv_id", "turn", "text_a", F.col("text").alias("text_b"))


@query(f"{DRIFTED} SELECT conv_id, turn, round(z, 4) AS drift, {LABELS.format('z')} AS interpretation, CASE WHEN length(text_a) > 80 THEN substr(text_a, 1, 80) || '...' ELSE text_a END AS text_a_preview FROM z WHERE coalesce(text_a, '') <> '' AND coalesce(text_b, '') <> ''")
def text_drift(spark, d):
    return api.calculate_drift(_turn_pairs(spark, d), HashBackend()).filter("error is null").select("conv_id", "turn", "drift", "interpretation", "text_a_preview")


@query(f"{DRIFTED} SELECT conv_id * 1000 + turn AS line, round(z, 4) AS drift, {LABELS.format('z')} AS interpretation FROM z WHERE coalesce(text_a, '') <> '' AND coalesce(text_b, '') <> ''")
def bulk_drift(spark, d):
    lines = _turn_pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.to_json(F.struct("text_a", "text_b")).alias("value"))
    return drift.bulk(src.parse_lines(lines), HashBackend()).filter("drift is not null").select("line", "drift", "interpretation")


CATS = "(SELECT lang AS category, dense_rank() OVER (ORDER BY lang) AS ordinal, arg_min(text, doc_id) AS exemplar FROM documents WHERE lang IS NOT NULL GROUP BY lang)"


@query(f"""WITH c AS {hashed(CATS, 'exemplar', 'category, ordinal')}, t AS {hashed("(SELECT doc_id, substr(text, 1, 2000) AS head, length(text) > 2000 AS content_truncated, coalesce(text, '') = '' AS none FROM documents)", 'head', 'doc_id, content_truncated, none')},
s AS (SELECT doc_id, content_truncated, none, category, ordinal, CASE WHEN list_inner_product(t.e, t.e) = 0 OR list_inner_product(c.e, c.e) = 0 THEN 0 ELSE list_inner_product(t.e, c.e) / (sqrt(list_inner_product(t.e, t.e)) * sqrt(list_inner_product(c.e, c.e))) END AS sim FROM t, c),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ordinal) - 1 AS rank, max(sim) OVER (PARTITION BY doc_id) AS top, arg_max(category, {{'s': sim, 'o': -ordinal}}) OVER (PARTITION BY doc_id) AS best FROM s)
SELECT doc_id, CASE WHEN none THEN 0 ELSE rank END AS rank, any_value(CASE WHEN NOT none THEN category END) AS category, any_value(CASE WHEN NOT none THEN round(sim, 4) END) AS category_similarity, any_value(CASE WHEN NOT none THEN best END) AS best_match, any_value(CASE WHEN NOT none THEN round(top, 4) END) AS similarity,
  any_value(CASE WHEN NOT none THEN top >= 0.85 END) AS confident, any_value(CASE WHEN NOT none THEN content_truncated END) AS content_truncated, any_value(CASE WHEN none THEN 'No content provided' END) AS error FROM o GROUP BY ALL""")
def classify_documents(spark, d):
    docs = read(spark, d, "documents")
    cats = docs.filter("lang is not null").groupBy(F.col("lang").alias("category")).agg(F.min_by("text", "doc_id").alias("exemplar"), F.min("lang").alias("ordinal"))
    out = api.classify_document(docs, cats, HashBackend())
    out = out.select("doc_id", "best_match", "similarity", "confident", "content_truncated", "error", F.posexplode_outer("all_similarities").alias("rank", "x"))
    return out.select("doc_id", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), F.col("x.category").alias("category"), F.col("x.similarity").alias("category_similarity"), "best_match", "similarity", "confident", "content_truncated", "error")


@query(f"""WITH {SEQ}, c AS (SELECT doc_id AS category, arg_min(e, pos) AS x FROM seq GROUP BY doc_id), s AS (SELECT pos, category, list_cosine_similarity(e, x) AS sim FROM seq, c)
SELECT pos AS vec_id, arg_max(category, sim)::VARCHAR AS best_match, round(max(sim), 4) AS similarity FROM s GROUP BY pos""")
def classify_vectors(spark, d):
    seq = vectors(spark, d)
    cats = seq.groupBy(F.col("doc_id").cast("string").alias("category")).agg(F.min_by("e", "pos").alias("e"), F.min("doc_id").alias("ordinal"))
    return classify.nearest(seq.select(F.col("pos").alias("vec_id"), "e"), cats, key="vec_id").select("vec_id", "best_match", "similarity")


# --- series ----------------------------------------------------------------------------------------------------------


@query(f"WITH {SEQ} SELECT a.doc_id, a.pos AS i, b.pos AS j, round(list_cosine_similarity(a.e, b.e), 4) + 0.0 AS sim FROM seq a JOIN seq b USING (doc_id)")
def heatmap_pairs(spark, d):
    return projection.similarity_matrix(vectors(spark, d), digits=4).select("doc_id", "i", "j", (F.col("sim") + 0.0).alias("sim"))


@query(f"WITH {SEQ}, {MOTION} SELECT doc_id, round((p - 2) / (n - 3), 6) AS x, round(a, 6) AS y FROM mo WHERE a IS NOT NULL")
def comparison_overlay(spark, d):
    return projection.overlay_series(vectors(spark, d)).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {SEQ}, {MOTION} SELECT doc_id, 'velocity' AS series, p - 1 AS x, round(v, 6) AS y, false AS spike FROM mo WHERE v IS NOT NULL UNION ALL SELECT doc_id, 'acceleration', p - 2, round(a, 6), a >= {SPIKE} FROM mo WHERE a IS NOT NULL
UNION ALL SELECT doc_id, 'curvature', p - 2, round(k, 6), false FROM mo WHERE k IS NOT NULL""")
def profile_series(spark, d):
    return projection.profile_series(vectors(spark, d), SPIKE).select("doc_id", "series", F.col("x").cast("bigint").alias("x"), F.round("y", 6).alias("y"), "spike")


@query()
def pca_projection(spark, d):
    return projection.principal_components(vectors(spark, d))


@query(f"""WITH {DOCSEQ}, {MOTION}, {spiked(0.3)} SELECT sp.doc_id, i AS index, round(a, 4) AS magnitude, CASE WHEN length(sentence) > 50 THEN substr(sentence, 1, 50) || '...' ELSE sentence END AS label
FROM sp JOIN sent ON sent.doc_id = sp.doc_id AND sent.pos = i + 1 WHERE spike""")
def spike_sentences(spark, d):
    docs = texts(spark, d)
    found = api.analyze_trajectory(docs, HashBackend())
    return projection.spike_sentences(sentences.split(docs), found).withColumn("index", F.col("index").cast("bigint"))


@query(f"""WITH {DOCSEQ}, {MOTION} SELECT d.doc_id, s.pos, s.sentence, round(v.v, 4) AS velocity, round(a.a, 4) AS acceleration, round(a.k, 4) AS curvature
FROM documents d LEFT JOIN sent s USING (doc_id) LEFT JOIN mo v ON v.doc_id = s.doc_id AND v.p = s.pos + 1 LEFT JOIN mo a ON a.doc_id = s.doc_id AND a.p = s.pos + 2""")
def trajectories_with_sentences(spark, d):
    """A row per sentence, with the velocity, acceleration and curvature of that index."""
    t = api.analyze_trajectory(texts(spark, d), HashBackend(), include_sentences=True)
    t = t.select("doc_id", F.posexplode_outer(F.arrays_zip("sentences", *km.PROFILES)).alias("pos", "x"))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.sentences").alias("sentence"), *[F.col(f"x.{c}").alias(c.removesuffix("_profile")) for c in km.PROFILES])


@query(f"""{compare_sql(DOCSEQ, 0.3, SOURCE_PAIRS)}, t AS (SELECT doc_id AS pair_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id, text) AS golden FROM documents)
SELECT t.pair_id, {', '.join(COMPARED)}, {_SUMMARIES}, CASE WHEN coalesce(golden, '') = '' THEN 'No golden_text provided' WHEN coalesce(text, '') = '' THEN 'No synthetic_text provided' WHEN error IS NOT NULL THEN error WHEN fitness_score IS NULL THEN 'Need at least 2 sentences, got 0' END AS error
FROM t LEFT JOIN fin USING (pair_id)""")
def compare_documents(spark, d):
    """Each document (pair_id) against the one before it in its source; the first of a source has none and gets the error of an empty text."""
    from pyspark.sql import Window

    t = read(spark, d, "documents").withColumn("golden_text", F.lag("text").over(Window.partitionBy("source").orderBy("doc_id", "text")))
    return compared(api.compare_trajectories(t.select(F.col("doc_id").alias("pair_id"), "golden_text", F.col("text").alias("synthetic_text")), HashBackend()), "pair_id")


# --- texts -----------------------------------------------------------------------------------------------------------


@query(f"WITH {SENT} SELECT doc_id, pos, sentence FROM sent")
def sentence_split(spark, d):
    return sentences.split(texts(spark, d)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(f"WITH e AS {hashed('documents', 'text', 'doc_id')} SELECT doc_id, round(list_max(e), 6) AS top, round(sqrt(list_inner_product(e, e)), 6) AS length, list_position(e, list_max(e)) AS place FROM e")
def hash_embedding(spark, d):
    t = HashBackend().embed(texts(spark, d))
    return t.select("doc_id", F.round(F.array_max("e"), 6).alias("top"), F.round(vx.norm(F.col("e")), 6).alias("length"), F.array_position("e", F.array_max("e")).cast("int").alias("place"))


@query(f"""WITH t AS {hashed('documents', 'text', 'doc_id, text')}, p AS (SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview, 64 AS dimensions, coalesce(text, '') = '' AS none, e FROM t)
SELECT doc_id, unnest(range(CASE WHEN none THEN 1 ELSE 10 END)) AS k, CASE WHEN NOT none THEN text_preview END AS text_preview, CASE WHEN NOT none THEN dimensions END AS dimensions, unnest(CASE WHEN none THEN [NULL] ELSE list_transform(e[1:10], lambda x: round(x, 6)) END) AS value,
  CASE WHEN none THEN 'No text provided' END AS error FROM p""")
def embed_text(spark, d):
    """The ten values of each preview, a row each."""
    t = api.embed_text(texts(spark, d), HashBackend()).select("doc_id", "text_preview", "dimensions", "error", F.posexplode_outer("embedding_preview").alias("k", "value"))
    return t.select("doc_id", F.coalesce("k", F.lit(0)).cast("bigint").alias("k"), "text_preview", "dimensions", F.round("value", 6).alias("value"), "error")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS text_key, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def cache_keys(spark, d):
    t = texts(spark, d).withColumn("text_key", tx.text_key(F.col("text")))
    return t.join(t.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")), "text_key").select("doc_id", "text_key", "copies")


@query(f"WITH e AS {hashed('documents', 'text', 'doc_id, text')} SELECT doc_id, unnest(range(64)) AS k, round(unnest(e), 6) AS value FROM e WHERE text IS NOT NULL")
def cached_embedding(spark, d):
    """All values of all vectors that come back from the cache."""
    t = EmbeddingCache(spark).embed(texts(spark, d).filter("text is not null"), HashBackend())
    return t.select("doc_id", F.posexplode("e").alias("k", "value")).select("doc_id", F.col("k").cast("bigint").alias("k"), F.round("value", 6).alias("value"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_whitespace(spark, d):
    return texts(spark, d).select("doc_id", tx.normalize_whitespace(F.col("text")).alias("normalized"))


@query("SELECT doc_id, length(text) - length(replace(text, '!', '')) AS total FROM documents")
def exclamation_totals(spark, d):
    return texts(spark, d).select("doc_id", tx.exclamation_counts(F.col("text"))["total"].cast("bigint").alias("total"))


CLEAN = "text"
for _p, _f in ((r"```[\s\S]*?```", "g"), (r"`[^`]+`", "g"), (r"(?m)^    .*$", "g"), (r"<![^>]*>", "g"), (r"<[^>]+>", "g"), (r"(?m)^#!/.*$", "g"), (r">\s*[^<\n]+", "g"), (r"\$\s*[!][!$^]", "g")):
    CLEAN = f"regexp_replace({CLEAN}, '{_p}', '', '{_f}')"


@query(f"SELECT doc_id, length({CLEAN}) AS chars, sha256({CLEAN}) AS cleaned FROM documents")
def clean_text(spark, d):
    c = tx.clean_text(F.col("text"))
    return texts(spark, d).select("doc_id", F.length(c).cast("bigint").alias("chars"), F.sha2(c, 256).alias("cleaned"))


_EDGE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_CLEANED = f"coalesce({CLEAN}, '')"


@query(f"""WITH c AS (SELECT doc_id, {_CLEANED} AS c FROM documents), x AS (SELECT doc_id, (length(c) - length(replace(c, '!', ''))) AS total, regexp_matches(regexp_replace(c, '^{_EDGE}|{_EDGE}$', '', 'g'), '(?m)^[^.!?]*!')::INT AS opening, ends_with(regexp_replace(c, '{_EDGE}$', ''), '!')::INT AS closing FROM c)
SELECT doc_id, total, opening, closing, total - opening - CASE WHEN opening <> closing THEN closing ELSE 0 END AS mid FROM x""")
def exclamation_counts(spark, d):
    return texts(spark, d).select("doc_id", tx.exclamation_counts(F.col("text")).alias("c")).select("doc_id", *[F.col(f"c.{c}").cast("bigint").alias(c) for c in ("total", "opening", "closing", "mid")])


WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, coalesce(len({WORDS.format('text')}), 0) AS n_words, coalesce(array_to_string(list_sort({WORDS.format('text')}), ' '), '') AS words FROM documents")
def word_sets(spark, d):
    w = tx.word_set(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


@query(f"""WITH b AS (SELECT item_id, {WORDS.format('text')} AS y FROM benchmark), t AS (SELECT doc_id, {WORDS.format('text')} AS x FROM documents),
n AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(x) AS word FROM t) JOIN (SELECT item_id, unnest(y) AS word FROM b) USING (word) GROUP BY ALL)
SELECT doc_id, item_id, round(n / (len(x) + len(y) - n), 6) AS jaccard FROM n JOIN t USING (doc_id) JOIN b USING (item_id)""")
def jaccard_benchmark(spark, d):
    """The similarity of every document with every item, where it isn't 0: words in common are counted by a join of the word sets of distinct texts."""

    def sets(t, key, size):
        return t.select(tx.text_key(F.col("text")).alias(key), tx.word_set(F.col("text")).alias("w")).dropDuplicates([key]).select(key, F.size("w").alias(size), F.explode("w").alias("word"))

    docs, items = texts(spark, d), read(spark, d, "benchmark").select("item_id", "text")
    both = sets(docs, "x", "n_x").join(sets(items, "y", "n_y"), "word").groupBy("x", "y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("n"))
    found = both.select("x", "y", F.round(F.col("n") / (F.col("n_x") + F.col("n_y") - F.col("n")), 6).alias("jaccard"))
    named = found.join(items.select("item_id", tx.text_key(F.col("text")).alias("y")), "y")
    return docs.select("doc_id", tx.text_key(F.col("text")).alias("x")).join(named, "x").select("doc_id", "item_id", "jaccard")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso8601_format(spark, d):
    return read(spark, d, "events").select("event_id", timestamps.to_iso8601(F.col("ts").cast("timestamp")).alias("iso"))


def _said(*forms):
    """One of the forms of an event's time, by event_id."""
    return F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))


_DAY = "(date_trunc('second', ts) + INTERVAL (event_id % 400) DAY)"


@query(f"SELECT strftime({_DAY}, '%Y-%m') AS month, count(*) AS n FROM events WHERE event_id % 3 <> 2 GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events WHERE event_id % 3 = 2")
def month_rollup(spark, d):
    """Months of texts in their own offsets, spread over 400 days; what can't be read has none."""
    t = read(spark, d, "events").withColumn("at", F.expr("timestampadd(DAY, cast(event_id % 400 as int), cast(ts as timestamp))"))
    said = _said(timestamps.to_iso8601(F.col("at")), F.date_format("at", "yyyyMMdd'T'HHmmss'-0500'"), F.date_format("at", "yyyy-MM-dd"))
    return t.select(timestamps.month(said).alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN '1970-01-01T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS parsed FROM events")
def takeout_timestamps(spark, d):
    """With a zone, without one, padded by other spaces, and texts that can't be read."""
    plain = F.date_format(F.col("ts").cast("timestamp"), "MMM d, yyyy, h:mm:ss a")
    said = _said(F.concat(plain, F.lit(" MDT")), plain, F.concat(F.lit("  "), F.replace(plain, F.lit(" AM"), F.lit("\u202fAM")), F.lit(" EST ")), F.concat(F.lit("at "), plain))
    return read(spark, d, "events").select("event_id", timestamps.takeout_timestamp(said).alias("parsed"))


@query("""SELECT event_id, strftime(CASE event_id % 7 WHEN 2 THEN ts - INTERVAL 2 HOUR WHEN 3 THEN ts + INTERVAL 330 MINUTE WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE ts END, '%Y-%m-%dT%H:%M:%SZ') AS parsed FROM events""")
def parsed_timestamps(spark, d):
    """Spaced, ISO with Z, ahead of and behind UTC, basic, and two that can't be read."""
    at = lambda form: F.date_format(F.col("ts").cast("timestamp"), form)
    said = _said(at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-MM-dd'T'HH:mm:ss'+02:00'"), at("yyyy-MM-dd'T'HH:mm:ss'-05:30'"), at("yyyyMMdd'T'HHmmss'Z'"), at("yyyy-MM-dd"), at("dd.MM.yyyy HH:mm:ss"))
    return read(spark, d, "events").select("event_id", timestamps.to_iso8601(timestamps.parse_timestamp(said)).alias("parsed"))


# Pages hold no block at the top level: all text outside scripts, styles, templates, comments and tags, one piece a line.
_PIECES = r"string_split(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->|<[/!a-z][^>]*>', chr(1), 'g'), chr(1))"
_UNESCAPED = "x"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_e}', '{_c}')"
PAGE_TEXT = f"array_to_string(list_filter(list_transform({_PIECES}, lambda x: regexp_replace({_UNESCAPED}, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, coalesce({PAGE_TEXT}, '') AS text FROM pages")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


_AT = "2024-01-01T00:00:00Z"


@query(f"""SELECT concat_ws('-', conv_id, turn) AS message_id, '{_AT}' AS timestamp, 'webui' AS timestamp_source, role AS speaker, coalesce(text, '') AS text, 'conversations' AS source_file, 'webui' AS source_format, false AS has_thinking, NULL::VARCHAR AS text_html, NULL::VARCHAR AS source_field, NULL::VARCHAR AS version, NULL::VARCHAR AS method, NULL::VARCHAR AS extracted FROM conversations
UNION ALL SELECT page_id::VARCHAR, '{_AT}', 'takeout_html', 'page', coalesce({PAGE_TEXT}, ''), 'pages', 'takeout_html', false, nullif(html, ''), h, v, m, t FROM (SELECT *, CASE WHEN coalesce(html, '') <> '' THEN 'html' END AS h, CASE WHEN coalesce(html, '') <> '' THEN '{html.VERSION}' END AS v, CASE WHEN coalesce(html, '') <> '' THEN '{html.METHOD}' END AS m, CASE WHEN coalesce(html, '') <> '' THEN '{_AT}' END AS t FROM pages)""")
def message_provenance(spark, d):
    c = read(spark, d, "conversations")
    none, at = F.lit(None).cast("string"), F.lit(_AT)
    m = html.message(F.concat_ws("-", "conv_id", "turn"), at, F.col("role"), none, F.col("text"), F.lit("text"), F.lit("conversations"), F.lit("webui"), at)
    p = html.message(F.col("page_id"), at, F.lit("page"), F.col("html"), none, F.lit("html"), F.lit("pages"), F.lit("takeout_html"), at)
    out = c.select(m.alias("m")).select("m.*").unionByName(read(spark, d, "pages").select(p.alias("m")).select("m.*"))
    e = F.col("extraction")
    return out.select(
        *[c for c in out.columns if c not in ("thinking_blocks", "extraction")], e["source_field"].alias("source_field"), e["version"].alias("version"), e["method"].alias("method"), e["timestamp"].alias("extracted")
    )


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview, length(text) > 2000 AS truncated FROM documents")
def previews(spark, d):
    return texts(spark, d).select("doc_id", tx.preview(F.col("text"), 80).alias("preview"), tx.truncate(F.col("text"))[1].alias("truncated"))
