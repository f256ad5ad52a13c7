"""Views of the driver tables that stand in for manifests, metadata and predictions.

Each view exists twice: as a DataFrame and as a SQL CTE with the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.schema import CLASSES

K = 10          # classes of the embedding predictions
DIM = 64
KB = 3          # classes of the line-item predictions
FLAGS = ["A", "N", "R"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- predictions over embeddings ----------------------------------------------

def centroids(spark: SparkSession, sf: str) -> Column:
    """Mean vector per label as one scalar array (K x d numbers)."""
    e = table(spark, sf, "embeddings")
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[d].cast("double")) for d in range(DIM)]).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "m"))), lambda s: s["m"])).scalar()


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, y, z and split ('fit'/'held')."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("e"), centroids(spark, sf).alias("mu")
    )
    dot = lambda m: F.lit(20.0) * F.aggregate(F.zip_with("e", m, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    split = F.when(F.substring(F.md5(F.concat(F.lit("42:"), F.col("row_id").cast("string"))), 1, 1) < "c", "fit").otherwise("held")
    return e.select("row_id", "y", F.transform("mu", dot).alias("z"), split.alias("split"))


def scored(df: DataFrame, k: int = K, *keep: str) -> DataFrame:
    """Adds p, pred and conf."""
    rows = df.withColumn("p", sc.softmax(F.col("z"), k))
    return rows.withColumns({"pred": sc.argmax(F.col("p")), "conf": sc.max_prob_of_logits(F.col("z"), k)})


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return scored(pred(spark, sf))


PRED = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
mu AS (SELECT label AS k, d, avg(v) AS m FROM e GROUP BY 1, 2),
zl AS (SELECT e.vec_id AS row_id, e.label AS y, mu.k AS k, 20 * sum(e.v * mu.m) AS z
       FROM e JOIN mu ON e.d = mu.d GROUP BY 1, 2, 3),
zm AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS zmax FROM zl),
pl AS (SELECT row_id, y, k, z, exp(z - zmax) / sum(exp(z - zmax)) OVER (PARTITION BY row_id) AS p,
              zmax + ln(sum(exp(z - zmax)) OVER (PARTITION BY row_id)) AS lse FROM zm),
pw AS (SELECT *, max(p) OVER (PARTITION BY row_id) AS pmax FROM pl),
pr AS (SELECT row_id, any_value(y) AS y, CAST(min(k) FILTER (WHERE p = pmax) AS INTEGER) AS pred,
              max(p) AS conf, max(p) FILTER (WHERE k = y) AS py FROM pw GROUP BY row_id)
"""

# ---- several models and views --------------------------------------------------

def pred_views(spark: SparkSession, sf: str) -> DataFrame:
    """Three models by four views of every prediction, logits moved by a fixed pattern."""
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("view")) for m in range(3) for v in range(4)])
    rows = pred(spark, sf).select("row_id", "y", "z", F.inline(grid))
    nudge = lambda i: 0.01 * ((F.col("row_id") * 7 + F.col("model") * 3 + F.col("view") + i) % 11 - 5)
    return rows.withColumn("z", F.array(*[F.col("z")[i] + nudge(i) for i in range(K)]))


VIEWS = """
vl AS (SELECT row_id, y, m.model, v.view, k, z + 0.01 * ((row_id * 7 + m.model * 3 + v.view + k) % 11 - 5) AS z
       FROM zl, (SELECT unnest([0, 1, 2]) AS model) m, (SELECT unnest([0, 1, 2, 3]) AS view) v)
"""

# ---- predictions over line items ------------------------------------------------

def pred_big(spark: SparkSession, sf: str) -> DataFrame:
    """row_id is the line's full key as text: unique without numbering the lines of an order."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), F.col("l_orderkey").alias("grp"),
        (F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("l_returnflag")) - 1).cast("int").alias("y"),
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("z"),
    )


BIG = """
bz AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
              l_orderkey AS grp, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS y,
              l_discount * 10 AS z0, l_tax * 10 AS z1, l_quantity / 50 AS z2 FROM lineitem),
bm AS (SELECT *, greatest(z0, z1, z2) AS zm FROM bz),
be AS (SELECT *, exp(z0 - zm) AS e0, exp(z1 - zm) AS e1, exp(z2 - zm) AS e2 FROM bm),
bs AS (SELECT *, (e0 + e1) + e2 AS es FROM be),
bp AS (SELECT row_id, grp, y, z0, z1, z2, e0 / es AS p0, e1 / es AS p1, e2 / es AS p2 FROM bs),
bpr AS (SELECT *, greatest(p0, p1, p2) AS conf,
               CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS pred FROM bp)
"""

# ---- cohorts, lesions, cases ----------------------------------------------------

def cohort_columns(df: DataFrame, key: str = "row_id") -> DataFrame:
    given = lambda c: F.when(F.col(key) % 13 != 0, c)
    return df.withColumns({
        "fitzpatrick": given((F.col(key) % 6 + 1).cast("int")),
        "sex": given(F.when(F.col(key) % 2 == 0, "male").otherwise("female")),
        "age": given((F.col(key) % 97).cast("double")),
    })


COHORT = """
co AS (SELECT pr.*, CASE WHEN row_id % 13 <> 0 THEN CAST(row_id % 6 + 1 AS INTEGER) END AS fitzpatrick,
              CASE WHEN row_id % 13 <> 0 THEN CASE WHEN row_id % 2 = 0 THEN 'male' ELSE 'female' END END AS sex,
              CASE WHEN row_id % 13 <> 0 THEN CAST(row_id % 97 AS DOUBLE) END AS age FROM pr)
"""

# ---- raw metadata ---------------------------------------------------------------

RAW_SITES = ["Head/Neck", " torso ", "leg", None, "ARM", "palms/soles", "moon", "back", "upper extremity", "", "Unknown", "chest"]
RAW_FITZ = ["1", "2", "6", "7", "x", None, "3.0", "0"]


def meta_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), i.cast("int"))
    return c.select(
        F.concat(F.lit("IMG_"), F.col("c_custkey").cast("string")).alias("image"), "c_custkey", "c_nationkey",
        F.floor(F.col("c_acctbal") / 50).cast("int").cast("string").alias("age_raw"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "M").when(F.col("c_mktsegment") == "BUILDING", " female ")
        .when(F.col("c_mktsegment") == "FURNITURE", "f").when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None)).otherwise("x").alias("sex_raw"),
        pick(RAW_SITES, F.col("c_nationkey") % 12).alias("site_raw"),
        pick(RAW_FITZ, F.col("c_custkey") % 8).alias("fitz_raw"),
    )


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


META = f"""
mr AS (SELECT 'IMG_' || c_custkey AS image, c_custkey, c_nationkey, CAST(CAST(floor(c_acctbal / 50) AS INTEGER) AS VARCHAR) AS age_raw,
              CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'M' WHEN 'BUILDING' THEN ' female ' WHEN 'FURNITURE' THEN 'f'
                   WHEN 'HOUSEHOLD' THEN NULL ELSE 'x' END AS sex_raw,
              ({_sql_list(RAW_SITES)})[c_nationkey % 12 + 1] AS site_raw,
              ({_sql_list(RAW_FITZ)})[c_custkey % 8 + 1] AS fitz_raw FROM customer),
alias_map AS (SELECT * FROM (VALUES ('torso','anterior torso'),('trunk','anterior torso'),('face','head/neck'),('neck','head/neck'),
  ('scalp','head/neck'),('ear','head/neck'),('extremity','upper extremity'),('arm','upper extremity'),('leg','lower extremity'),
  ('foot','palms/soles'),('hand','palms/soles'),('back','posterior torso'),('chest','anterior torso'),('abdomen','anterior torso'),
  ('anterior torso','anterior torso'),('head/neck','head/neck'),('lateral torso','lateral torso'),('lower extremity','lower extremity'),
  ('oral/genital','oral/genital'),('palms/soles','palms/soles'),('posterior torso','posterior torso'),
  ('upper extremity','upper extremity'),('unknown','unknown')) t(raw, canon)),
mn AS (SELECT image, c_custkey, c_nationkey, age_raw, sex_raw, site_raw, fitz_raw,
         CASE WHEN TRY_CAST(age_raw AS DOUBLE) > 0 AND TRY_CAST(age_raw AS DOUBLE) < 130 THEN TRY_CAST(age_raw AS DOUBLE) END AS age,
         CASE WHEN lower(trim(sex_raw)) IN ('m', 'male') THEN 'male' WHEN lower(trim(sex_raw)) IN ('f', 'female') THEN 'female' END AS sex,
         CASE WHEN site_raw IS NOT NULL AND site_raw <> '' THEN coalesce(canon, 'unknown') END AS site,
         CASE WHEN TRY_CAST(fitz_raw AS DOUBLE) IS NOT NULL AND trunc(TRY_CAST(fitz_raw AS DOUBLE)) BETWEEN 1 AND 6
              THEN CAST(trunc(TRY_CAST(fitz_raw AS DOUBLE)) AS INTEGER) END AS fitzpatrick
       FROM mr LEFT JOIN alias_map ON alias_map.raw = lower(trim(site_raw)))
"""


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """meta_raw with its normalised columns."""
    from tallyvane.functions import normalize as nz
    return meta_raw(spark, sf).withColumns({
        "age": nz.norm_age(F.col("age_raw")), "sex": nz.norm_sex(F.col("sex_raw")),
        "site": nz.norm_site(F.col("site_raw")), "fitzpatrick": nz.norm_fitzpatrick(F.col("fitz_raw")),
    })


# ---- content and fingerprints ---------------------------------------------------

def content(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, dataset, priority and sha1 of every document's whole text."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("dataset"), F.sha1("text").alias("sha1"),
        F.coalesce(F.regexp_extract("source", "(\\d+)$", 1).try_cast("int"), F.lit(99)).alias("priority"),
    )


CONTENT = """
ct AS (SELECT doc_id, source AS dataset, sha1(text) AS sha1,
              coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), 99) AS priority FROM documents)
"""

NEAR = """
tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM documents),
tc AS (SELECT doc_id, md5(t) AS h, count(*) AS c FROM tok WHERE t <> '' GROUP BY 1, t),
th AS (SELECT doc_id, c, ('0x' || substr(h, 1, 8))::BIGINT AS hi, ('0x' || substr(h, 9, 8))::BIGINT AS lo FROM tc),
bits AS (SELECT unnest(range(0, 32)) AS i),
votes AS (SELECT doc_id, i, sum(CASE WHEN (hi >> i) & 1 = 1 THEN c ELSE -c END) AS vh,
                 sum(CASE WHEN (lo >> i) & 1 = 1 THEN c ELSE -c END) AS vl FROM th, bits GROUP BY 1, 2),
sh AS (SELECT doc_id, CAST(sum(CASE WHEN vh > 0 THEN (1::BIGINT << i) ELSE 0 END) AS BIGINT) AS hi,
              CAST(sum(CASE WHEN vl > 0 THEN (1::BIGINT << i) ELSE 0 END) AS BIGINT) AS lo FROM votes GROUP BY 1)
"""


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


def gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"
    )


# ---- case history and cases -----------------------------------------------------

STATUSES = {"purchase": "Senior review", "error": "In review", "click": "Needs review"}


def history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.lit("Reviewed")
    for kind, s in STATUSES.items():
        status = F.when(F.col("event_type") == kind, s).otherwise(status)
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("date"),
        status.alias("status"), (F.col("value") / 500).alias("confidence"),
        (F.col("user_id") % 3 == 0).alias("samePatient"),
        F.when(F.col("value") > 250, "High concern").otherwise("Routine").alias("urgency"),
    )


HISTORY = """
hi AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS date,
              CASE event_type WHEN 'purchase' THEN 'Senior review' WHEN 'error' THEN 'In review' WHEN 'click' THEN 'Needs review' ELSE 'Reviewed' END AS status,
              value / 500 AS confidence, user_id % 3 = 0 AS samePatient,
              CASE WHEN value > 250 THEN 'High concern' ELSE 'Routine' END AS urgency FROM events)
"""

CASE_SITES = ["head/neck", "anterior torso", "upper extremity", "lower extremity"]


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One row per prediction: class code from the predicted index, metadata and two heat-map summaries.

    The probabilities of all ten labels are folded into the eight codes by ``label % 8``.
    """
    from tallyvane.operators.quality import summarize_heat
    rows = cohort_columns(pred(spark, sf)).withColumn("_p", sc.softmax(F.col("z"), K))
    rows = rows.withColumn("p", F.array(*[sc.fold_sum([F.col("_p")[j] for j in range(i, K, len(CLASSES))]) for i in range(len(CLASSES))])).drop("_p")
    rows = rows.withColumns({"cls": sc.argmax(F.col("p")), "conf": F.round(F.array_max("p"), 4)})
    rows = rows.withColumns({
        "code": F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("cls")),
        "site": F.when(F.col("row_id") % 13 != 0, F.get(F.array(*[F.lit(s) for s in CASE_SITES]), (F.col("row_id") % 4).cast("int"))),
    })
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.reverse("embedding").alias("flipped"))
    tag = lambda df, t: df.select("row_id", *[F.col(c).alias(f"{t}_{c}") for c in ("region", "zone_family", "area_pct", "peak_x", "peak_y")])
    grad = tag(summarize_heat(grid, "row_id", "embedding", 8), "g")
    attn = tag(summarize_heat(grid, "row_id", "flipped", 8), "a")
    return rows.join(grad, "row_id").join(attn, "row_id")


_REGION = """CASE WHEN x BETWEEN 0.34 AND 0.66 AND y BETWEEN 0.34 AND 0.66 THEN 'central lesion body'
  WHEN y >= 0.34 AND y <= 0.66 THEN (CASE WHEN x < 0.34 THEN 'left' WHEN x > 0.66 THEN 'right' ELSE 'central' END) || ' peripheral lesion border'
  WHEN x >= 0.34 AND x <= 0.66 THEN (CASE WHEN y < 0.34 THEN 'upper' ELSE 'lower' END) || ' lesion border'
  ELSE (CASE WHEN y < 0.34 THEN 'upper' ELSE 'lower' END) || '-' || (CASE WHEN x < 0.34 THEN 'left' ELSE 'right' END) || ' lesion border' END"""
_ZONE = """CASE WHEN contains(region, 'central') OR contains(region, 'body') THEN 'central' WHEN contains(region, 'upper') THEN 'upper'
  WHEN contains(region, 'lower') THEN 'lower' WHEN contains(region, 'left') THEN 'left' WHEN contains(region, 'right') THEN 'right'
  WHEN contains(region, 'border') OR contains(region, 'peripheral') THEN 'peripheral' ELSE 'non_specific' END"""


def heat_sql(tag: str, pos: str) -> str:
    """CTEs ending in ``<tag>h``: the heat summary of the 8 x 8 grid; ``pos`` maps d to the cell."""
    return f"""
{tag}0 AS (SELECT vec_id AS row_id, {pos} AS pos, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)),
{tag}1 AS (SELECT *, min(v) OVER (PARTITION BY row_id) AS lo FROM {tag}0),
{tag}2 AS (SELECT row_id, pos, v - lo AS s FROM {tag}1),
{tag}3 AS (SELECT *, max(s) OVER (PARTITION BY row_id) AS hi FROM {tag}2),
{tag}4 AS (SELECT row_id, pos, CASE WHEN hi > 0 THEN s / hi ELSE s END AS a FROM {tag}3),
{tag}5 AS (SELECT row_id, quantile_cont(a, 0.85) AS q, max(a) AS top FROM {tag}4 GROUP BY 1),
{tag}6 AS (SELECT row_id, min(pos) FILTER (WHERE a = top) AS pos,
                 round(100.0 * count(*) FILTER (WHERE a >= greatest(0.55, q)) / count(*), 1) AS area_pct
          FROM {tag}4 JOIN {tag}5 USING (row_id) GROUP BY 1),
{tag}7 AS (SELECT *, (pos % 8) / 7.0::DOUBLE AS x, (pos // 8) / 7.0::DOUBLE AS y FROM {tag}6),
{tag}8 AS (SELECT *, {_REGION} AS region FROM {tag}7),
{tag}h AS (SELECT row_id, region, {_ZONE} AS zone_family, area_pct,
                 CAST(round_even(x * 383, 0) AS INTEGER) AS peak_x, CAST(round_even(y * 383, 0) AS INTEGER) AS peak_y FROM {tag}8)
"""


CASE = PRED + "," + heat_sql("g", "d - 1") + "," + heat_sql("a", "64 - d") + """,
c8 AS (SELECT row_id, y, k, z, max(z) OVER (PARTITION BY row_id) AS m FROM zl),
c9 AS (SELECT row_id, y, k, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id) AS p FROM c8),
cp AS (SELECT row_id, any_value(y) AS y, k % 8 AS k, sum(p) AS p FROM c9 GROUP BY row_id, k % 8),
cw AS (SELECT *, max(p) OVER (PARTITION BY row_id) AS pm FROM cp),
names AS (SELECT * FROM (VALUES (0,'MEL','Melanoma',0.57),(1,'NV','Melanocytic Nevus',0.48),(2,'BCC','Basal Cell Carcinoma',0.42),
  (3,'AK','Actinic Keratosis',0.31),(4,'BKL','Benign Keratosis',0.39),(5,'DF','Dermatofibroma',0.24),(6,'VASC','Vascular Lesion',0.22),
  (7,'SCC','Squamous Cell Carcinoma',0.35)) t(k, code, label, thr)),
cr AS (SELECT row_id, any_value(y) AS y, min(k) FILTER (WHERE p = pm) AS cls, round(max(p), 4) AS conf,
              sum(p) FILTER (WHERE k IN (0, 2, 3, 7)) AS mal, max(p) FILTER (WHERE k = 0) AS mel FROM cw GROUP BY 1),
ca AS (SELECT cr.*, n.code, n.label, n.thr::DOUBLE AS thr,
         CASE WHEN cr.row_id % 13 <> 0 THEN CAST(cr.row_id % 6 + 1 AS INTEGER) END AS fitzpatrick,
         CASE WHEN cr.row_id % 13 <> 0 THEN CASE WHEN cr.row_id % 2 = 0 THEN 'male' ELSE 'female' END END AS sex,
         CASE WHEN cr.row_id % 13 <> 0 THEN CAST(cr.row_id % 97 AS DOUBLE) END AS age,
         CASE WHEN cr.row_id % 13 <> 0 THEN (['head/neck', 'anterior torso', 'upper extremity', 'lower extremity'])[cr.row_id % 4 + 1] END AS site,
         gh.region AS g_region, gh.zone_family AS g_zone_family, gh.area_pct AS g_area_pct, gh.peak_x AS g_peak_x, gh.peak_y AS g_peak_y,
         ah.region AS a_region, ah.zone_family AS a_zone_family
       FROM cr JOIN names n ON n.k = cr.cls JOIN gh ON gh.row_id = cr.row_id JOIN ah ON ah.row_id = cr.row_id),
fl AS (SELECT *, code IN ('MEL', 'BCC', 'AK', 'SCC') AS malignant, code IN ('MEL', 'BCC', 'AK', 'SCC') AND conf >= 0.5 AS requires_biopsy,
         conf < 0.5 AS low_confidence, conf < 0.7 AS differential_diagnosis,
         CASE WHEN g_zone_family = a_zone_family THEN 'aligned'
              WHEN g_zone_family IN ('central', 'peripheral') OR a_zone_family IN ('central', 'peripheral') THEN 'partially_aligned'
              ELSE 'discordant' END AS alignment FROM ca)
"""


def flagged_cases(spark: SparkSession, sf: str) -> DataFrame:
    from tallyvane.functions import clinical as cl
    c = cases(spark, sf)
    flags = cl.clinical_flags(F.col("code"), F.col("conf"), F.col("p"))
    return c.withColumns({**flags, "alignment": cl.evidence_alignment(F.col("g_zone_family"), F.col("a_zone_family"))})
