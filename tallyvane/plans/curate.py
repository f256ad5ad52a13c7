"""Curation queries: sources, normalisers, filters, joins, dedup, near-duplicates, quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import encode as en, normalize as nz, scores as sc, text as tx
from tallyvane.operators import dedup as dd, joins as jn, quality as qg, ranking as rk
from tallyvane.plans.fixtures import (
    CONTENT, DIM, META, NEAR, PRED, content, gate_rows, meta, meta_raw, predictions, table,
)
from tallyvane.plans.registry import query, r, rounded, rq
from tallyvane.schema import CLASSES, MANIFEST_FEATURES, META_FEATURES, SITES
from tallyvane.sources import adapters as ad, catalogue as cg, sinks as sk
from tallyvane.storage import scratch_path, spread

WM = "WITH " + META
SITE8 = SITES[:-1]

# ---- sources -------------------------------------------------------------------------

LABEL_COLS = ["quality", "toxic"]


def labels_wide(spark, sf):
    """One-hot quality/toxic with an unknown flag, as a ground-truth table has it."""
    lab = table(spark, sf, "labels")
    return lab.select(
        F.col("doc_id").alias("image"), F.col("quality").cast("double").alias("Q"), (F.col("toxic") * (1 - F.col("quality"))).cast("double").alias("T"),
        (F.col("doc_id") % 10 == 0).cast("double").alias("UNK"))


LABELS = """lw AS (SELECT doc_id AS image, quality::DOUBLE AS "Q", (toxic * (1 - quality))::DOUBLE AS "T", CASE WHEN doc_id % 10 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "UNK" FROM labels)"""


@query("src1_csv_roundtrip", WM + " SELECT image, age_raw, sex_raw, nullif(site_raw, '') AS site_raw FROM mr WHERE c_custkey >= 0")
def src1(spark, sf):
    path = scratch_path(spark, "csv")
    rows = meta_raw(spark, sf).select("image", "age_raw", F.col("sex_raw"), F.nullif("site_raw", F.lit("")).alias("site_raw"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = ad.read_csv(spark, path, {"image": "string", "age_raw": "string", "sex_raw": "string", "site_raw": "string"})
    return back.filter(F.col("_corrupt_record").isNull()).select("image", "age_raw", "sex_raw", "site_raw")


PAGES = """pg AS (SELECT page_id, url, html, regexp_replace(url, '\\?.*$', '') AS path, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
  page_id % 9 = 0 AS missing FROM pages)"""


def files(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "\\?.*$", "").alias("path"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), (F.col("page_id") % 9 == 0).alias("missing"), "html")


@query("src2_file_listing", "WITH " + PAGES + """ SELECT page_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS ext FROM pg""")
def src2(spark, sf):
    return files(spark, sf).select("page_id", tx.stem(F.col("path")).alias("stem"), tx.extension(F.col("path")).alias("ext"))


@query("src3_file_count", "WITH " + PAGES + """, c AS (SELECT host, count(*) FILTER (WHERE page_id % 5 = 0) AS flat, count(*) AS every FROM pg WHERE NOT missing GROUP BY 1)
SELECT host, CASE WHEN flat > 0 THEN flat ELSE every END AS image_count FROM c""")
def src3(spark, sf):
    rows = files(spark, sf).filter(~F.col("missing")).withColumn("depth", F.when(F.col("page_id") % 5 == 0, 0).otherwise(1))
    return cg.count_images(rows, "host", "depth")


@query("src4_catalogue_verification", "WITH " + PAGES + """, en AS (SELECT host AS dataset_key, CAST(count(*) % 3 + 1 AS INTEGER) AS tier, count(*) * 2 - min(page_id) % 4 AS expected, min(page_id) % 2 AS need FROM pg GROUP BY 1),
ct AS (SELECT host AS dataset_key, count(*) AS c FROM pg WHERE NOT missing GROUP BY 1),
s AS (SELECT en.*, c, coalesce(c, 0) AS n FROM en LEFT JOIN ct USING (dataset_key))
SELECT dataset_key, tier, expected, n AS image_count, c IS NOT NULL AND n >= expected * 0.5 AND need = 0 AS present,
 CAST((CASE WHEN need = 1 THEN 1 ELSE 0 END) + (CASE WHEN c IS NULL OR n = 0 OR n < expected * 0.5 THEN 1 ELSE 0 END) AS INTEGER) AS n_issues FROM s""")
def src4(spark, sf):
    pages = files(spark, sf)
    entries = pages.groupBy(F.col("host").alias("dataset_key")).agg(F.count("*").alias("c"), F.min("page_id").alias("m")).select(
        "dataset_key", (F.col("c") % 3 + 1).cast("int").alias("tier"), (F.col("c") * 2 - F.col("m") % 4).alias("expected"), F.lit("images").alias("image_dir"),
        F.when(F.col("m") % 2 == 1, F.array(F.lit("labels.csv"), F.lit("extra.csv"))).otherwise(F.array(F.lit("labels.csv"))).alias("metadata_files"))
    counts = pages.filter(~F.col("missing")).groupBy(F.col("host").alias("dataset_key")).agg(F.count("*").alias("image_count"))
    meta_files = pages.select(F.col("host").alias("dataset_key"), F.lit("labels.csv").alias("file")).distinct()
    out = cg.verify(entries, counts, meta_files)
    return out.select("dataset_key", "tier", "expected", "image_count", "present", F.size("issues").alias("n_issues"))


NATION_CODES = {"nation_0": "MEL", "nation_1": "NV", "nation_2": "BKL", "nation_3": "BKL", "nation_4": "BKL", "nation_5": "BKL", "nation_6": "BKL", "nation_7": "MEL"}
UPPER_CODES = {k.upper(): v for k, v in NATION_CODES.items()}
_CODES = "CASE n_name WHEN 'NATION_0' THEN 'MEL' WHEN 'NATION_1' THEN 'NV' WHEN 'NATION_7' THEN 'MEL' WHEN 'NATION_2' THEN 'BKL' WHEN 'NATION_3' THEN 'BKL' WHEN 'NATION_4' THEN 'BKL' WHEN 'NATION_5' THEN 'BKL' WHEN 'NATION_6' THEN 'BKL' END"
_IDX = "CAST(list_position(['MEL','NV','BCC','AK','BKL','DF','VASC','SCC'], class_name) - 1 AS INTEGER) AS class_idx"


def coded_meta(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return meta_raw(spark, sf).join(nation, "c_nationkey").withColumns({
        "lesion_id": F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("L"), F.floor(F.col("c_custkey") / 3).cast("string"))),
        "patient_id": F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("P"), (F.col("c_custkey") % 100).cast("string"))),
    })


def canonical_sql(key: str, patient: str, fitz: str, image: str = "image") -> str:
    return WM + f""", cd AS (SELECT mn.*, {_CODES} AS class_name,
 CASE WHEN c_custkey % 5 <> 0 THEN 'L' || (c_custkey // 3) END AS lesion, CASE WHEN c_custkey % 7 <> 0 THEN 'P' || (c_custkey % 100) END AS patient
 FROM mn JOIN nation ON n_nationkey = c_nationkey)
SELECT '{key}' AS dataset_key, {image} AS image_id, '/{key}/images/' || {image} || '.jpg' AS src_image_path, class_name, {_IDX}, coalesce(lesion, {image}) AS lesion_id,
 {patient} AS patient_id, age, sex, site, {fitz} AS fitzpatrick FROM cd WHERE class_name IS NOT NULL"""


@query("src6_adapter_coded", canonical_sql("src_b", "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)"))
def src6(spark, sf):
    spec = ad.Adapter("src_b", "image", (), "n_name", NATION_CODES, F.lower, age="age_raw", sex="sex_raw", site="site_raw")
    return ad.adapt(coded_meta(spark, sf), spec)


@query("src7_adapter_free_text", canonical_sql("src_c", "patient", "CAST(NULL AS INTEGER)"))
def src7(spark, sf):
    spec = ad.Adapter("src_c", "image", (), "n_name", NATION_CODES, lambda c: F.lower(F.trim(c)), patient="patient_id", age="age_raw", sex="sex_raw", site="site_raw")
    return ad.adapt(coded_meta(spark, sf).withColumn("n_name", F.concat(F.lit("  "), "n_name", F.lit(" "))), spec)


@query("src8_adapter_skin_type", canonical_sql("src_d", "patient", "fitzpatrick"))
def src8(spark, sf):
    spec = ad.Adapter("src_d", "img_file", (), "n_name", UPPER_CODES, F.upper, patient="patient_id", age="age_raw", sex="sex_raw",
                      site="site_raw", fitzpatrick="fitz_raw", image_is_path=True)
    return ad.adapt(coded_meta(spark, sf).withColumn("img_file", F.concat("image", F.lit(".png"))), spec)


@query("src5_adapter_one_hot", "WITH " + LABELS + """, j AS (SELECT lw.*, d.source, d.lang FROM lw LEFT JOIN documents d ON d.doc_id = lw.image WHERE NOT ("UNK" = 1)),
m AS (SELECT *, CASE WHEN "Q" > 0 THEN 'MEL' WHEN "T" > 0 THEN 'NV' END AS class_name FROM j)
SELECT 'src_a' AS dataset_key, CAST(image AS VARCHAR) AS image_id, class_name, CAST(CASE class_name WHEN 'MEL' THEN 0 ELSE 1 END AS INTEGER) AS class_idx, coalesce(source, CAST(image AS VARCHAR)) AS lesion_id, count(*) OVER () AS n_rows FROM m WHERE class_name IS NOT NULL""")
def src5(spark, sf):
    lab, docs = labels_wide(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.col("source").alias("lesion_id"))
    joined = jn.attach_metadata(lab, docs, "image").withColumns({**{c: F.lit(0.0) for c in CLASSES[2:]}, "MEL": F.col("Q"), "NV": F.col("T")})
    out = ad.adapt(joined, ad.Adapter("src_a", "image", ()))
    total = out.agg(F.count("*")).scalar()
    return out.select("dataset_key", "image_id", "class_name", "class_idx", "lesion_id", total.alias("n_rows"))


@query("src9_union_of_sources", canonical_sql("src_b", "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)").replace("SELECT 'src_b'", ", u AS (SELECT 'src_b'", 1)
       + " UNION ALL SELECT 'src_d', image, '/src_d/images/' || image || '.jpg', class_name, " + _IDX + """, coalesce(lesion, image), patient, age, sex, site, fitzpatrick FROM cd WHERE class_name IS NOT NULL)
SELECT dataset_key, class_name, count(*) AS n, count(patient_id) AS n_patients, count(DISTINCT lesion_id) AS n_lesions FROM u GROUP BY 1, 2""")
def src9(spark, sf):
    both = dd.union_all([src6(spark, sf), src8(spark, sf)])
    return both.groupBy("dataset_key", "class_name").agg(F.count("*").alias("n"), F.count("patient_id").alias("n_patients"), F.count_distinct("lesion_id").alias("n_lesions"))


@query("src9_quarantine_no_label", "WITH " + LABELS + """ SELECT CAST(image AS VARCHAR) AS image_id, 'no_label' AS reason FROM lw WHERE NOT ("UNK" = 1) AND "Q" <= 0 AND "T" <= 0""")
def src9_quarantine(spark, sf):
    rows = labels_wide(spark, sf).withColumns({**{c: F.lit(0.0) for c in CLASSES[2:]}, "MEL": F.col("Q"), "NV": F.col("T")})
    return ad.quarantined(rows, ad.Adapter("src_a", "image", ()))


@query("src10_tolerant_manifest", WM + """ SELECT image, CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_male, CASE WHEN sex = 'female' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_female,
 coalesce(age, 0.0) AS age_approx, 0.0::DOUBLE AS sex_unknown FROM mn""")
def src10(spark, sf):
    path = scratch_path(spark, "manifest")
    m = meta(spark, sf).select("image", F.initcap((F.col("sex") == "male").cast("string")).alias("sex_male"),
                               F.when(F.col("sex") == "female", "1").otherwise("").alias("sex_female"), F.col("age").cast("string").alias("age_approx"))
    m.write.option("header", True).csv(path)
    return ad.read_manifest(spark, path, ["sex_male", "sex_female", "age_approx", "sex_unknown"])


@query("src12_cached_predictions", "WITH " + PRED + f" SELECT row_id, pred, {rq('conf')} AS conf FROM pr")
def src12(spark, sf):
    from pyspark.sql.functions import lit
    print_id = spark.range(1).select(tx.json_fingerprint({"sf": lit(sf), "k": lit("10"), "v": lit("1")})).first()[0]
    cached = sk.cached_by_config(spark, "predictions", print_id, lambda: predictions(spark, sf).select("row_id", "pred", "conf"))
    return rounded(cached, "conf")


# ---- sinks ---------------------------------------------------------------------------

@query("snk1_partitioned_split_table", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1")
def snk1(spark, sf):
    path = scratch_path(spark, "split")
    sk.write_table(gate_rows(spark, sf).select("l_quantity", "l_returnflag"), path, ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("snk2_json_report", f"SELECT l_returnflag, {rq('avg(l_quantity)')} AS mean FROM lineitem GROUP BY 1")
def snk2(spark, sf):
    path = scratch_path(spark, "report")
    sk.write_json(rounded(gate_rows(spark, sf).groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean")), "mean"), path)
    return spark.read.schema("l_returnflag string, mean double").json(path)


@query("snk3_append_log", "SELECT 'run' || i AS run, count(*) AS n FROM orders, (SELECT unnest([1, 2]) AS i) GROUP BY 1")
def snk3(spark, sf):
    path = scratch_path(spark, "log")
    for i in (1, 2):
        sk.append_log(table(spark, sf, "orders").agg(F.count("*").alias("n")).withColumn("run", F.lit(f"run{i}")), path)
    return spark.read.schema("run string, n long").json(path)


@query("snk4_quarantine", "SELECT CAST(page_id AS VARCHAR) AS id, 'decode' AS failed_stage, 'bad bytes' AS error FROM pages WHERE page_id % 9 = 0")
def snk4(spark, sf):
    path = scratch_path(spark, "quarantine")
    rows = files(spark, sf).select(
        F.col("page_id").cast("string").alias("id"), (~F.col("missing")).alias("ok"), F.lit("decode").alias("failed_stage"), F.lit("bad bytes\nsecond line").alias("error"))
    sk.write_quarantine(rows, path)
    return spark.read.schema("id string, failed_stage string, error string").option("sep", "\t").csv(path)


@query("snk5_path_rewrite", "SELECT p_partkey, 'clean/' || p_type || '/' || p_partkey || '.png' AS image_path FROM part")
def snk5(spark, sf):
    rows = table(spark, sf, "part").withColumn("image_path", F.lit("old"))
    return sk.rewrite_path(rows, "image_path", "clean", F.col("p_type"), F.col("p_partkey").cast("string")).select("p_partkey", "image_path")


@query("snk6_uncertain_report", "WITH " + PRED + " SELECT row_id, pred, y FROM pr WHERE conf < 0.3")
def snk6(spark, sf):
    rows = predictions(spark, sf).select("row_id", "pred", "y", "conf")
    path = scratch_path(spark, "uncertain")
    sk.write_uncertain(rows, path, 0.3)
    return spark.read.schema("row_id bigint, pred int, y int, conf double").json(f"{path}/json").select("row_id", "pred", "y")


# ---- normalisers ---------------------------------------------------------------------

@query("prj1_onehot_to_class", "WITH " + LABELS + """ SELECT image, CAST(CASE WHEN "Q" > 0 AND "Q" >= "T" THEN 0 WHEN "T" > 0 THEN 1 END AS INTEGER) AS class_idx, CASE WHEN "Q" > 0 AND "Q" >= "T" THEN 'quality' WHEN "T" > 0 THEN 'toxic' END AS class_name FROM lw""")
def prj1(spark, sf):
    idx = nz.onehot_index([F.col("Q"), F.col("T")])
    return labels_wide(spark, sf).select("image", idx.alias("class_idx"), nz.label_at(LABEL_COLS, idx).alias("class_name"))


@query("prj2_code_dictionary", f"SELECT c_custkey, {_CODES} AS class_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {_CODES} IS NOT NULL")
def prj2(spark, sf):
    rows = coded_meta(spark, sf).select("c_custkey", nz.code_to_class(F.lower("n_name"), NATION_CODES).alias("class_name"))
    return rows.filter(F.col("class_name").isNotNull())


@query("prj3_6_normalisers", WM + " SELECT image, age, sex, site, fitzpatrick FROM mn")
def prj3(spark, sf):
    return meta(spark, sf).select("image", "age", "sex", "site", "fitzpatrick")


_SAFE = lambda n: n.replace(" ", "_").replace("/", "_")


def _manifest_sql(age: str) -> str:
    bits = [f"{age} AS age_approx", "CASE WHEN sex = 'female' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_female", "CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_male",
            "CASE WHEN sex IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_unknown"]
    bits += [f"CASE WHEN site = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {_SAFE('site_' + s)}" for s in SITE8]
    bits += ["CASE WHEN coalesce(site, 'unknown') = 'unknown' THEN 1.0 ELSE 0.0 END::DOUBLE AS site_unknown"]
    return WM + " SELECT image, " + ", ".join(bits) + " FROM mn"


def _manifest(spark, sf, missing):
    cols = en.manifest_columns(F.col("age"), F.col("sex"), F.col("site"), age_missing=missing)
    return meta(spark, sf).select("image", *[cols[n].cast("double").alias(_SAFE(n)) for n in MANIFEST_FEATURES])


@query("prj7_legacy_encoding", _manifest_sql("coalesce(age, 0.0)"))
def prj7(spark, sf):
    return _manifest(spark, sf, None)


@query("prj8_metadata_13", _manifest_sql("CASE WHEN age IS NULL THEN 0.5 ELSE least(greatest(age, 0.0), 90.0) / 90.0 END::DOUBLE"))
def prj8(spark, sf):
    return _manifest(spark, sf, 0.5)


def _long19(df, *cols):
    cells = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(n).alias("feature"), *[F.col(c)[i].alias(c) for c in cols]) for i, n in enumerate(META_FEATURES)])
    return df.select("image", F.inline(cells))


_VEC = "[CASE WHEN age IS NOT NULL THEN age / 100 ELSE 0 END, CASE WHEN sex = 'female' THEN 1 ELSE 0 END, CASE WHEN sex = 'male' THEN 1 ELSE 0 END, 0, " + \
    ", ".join(f"CASE WHEN site = '{s}' THEN 1 ELSE 0 END" for s in SITES) + ", " + ", ".join(f"CASE WHEN fitzpatrick = {i} THEN 1 ELSE 0 END" for i in range(1, 7)) + "]::DOUBLE[]"
_MASK = "[CASE WHEN age IS NOT NULL THEN 1 ELSE 0 END, " + ", ".join(["CASE WHEN sex IS NOT NULL THEN 1 ELSE 0 END"] * 3 + ["CASE WHEN site IS NOT NULL THEN 1 ELSE 0 END"] * 9 + ["CASE WHEN fitzpatrick IS NOT NULL THEN 1 ELSE 0 END"] * 6) + "]::DOUBLE[]"
_NAMES = "[" + ", ".join(f"'{n}'" for n in META_FEATURES) + "]"


@query("prj9_metadata_19_and_mask", WM + f""", v AS (SELECT image, unnest(range(19)) AS j, unnest({_NAMES}) AS feature, unnest({_VEC}) AS vec, unnest({_MASK}) AS mask FROM mn)
SELECT image, CAST(j AS INTEGER) AS j, feature, vec, mask FROM v""")
def prj9(spark, sf):
    cols = [F.col(c) for c in ("age", "sex", "site", "fitzpatrick")]
    return _long19(meta(spark, sf).withColumns({"vec": en.meta_vector(*cols), "mask": en.meta_mask(*cols)}), "vec", "mask")


@query("prj10_absent_blend", WM + f""", v AS (SELECT image, unnest(range(19)) AS j, unnest({_NAMES}) AS feature, unnest({_VEC}) AS vec, unnest({_MASK}) AS mask FROM mn),
b AS (SELECT image, j, feature, vec * mask + (0.01 * (j + 1)) * (1 - mask) AS x FROM v)
SELECT image, CAST(j AS INTEGER) AS j, feature, {rq('x')} AS x FROM b""")
def prj10(spark, sf):
    cols = [F.col(c) for c in ("age", "sex", "site", "fitzpatrick")]
    absent = [0.01 * (j + 1) for j in range(19)]
    blended = en.blend_absent(en.meta_vector(*cols), en.meta_mask(*cols), absent, 19)
    return rounded(_long19(meta(spark, sf).withColumn("x", blended), "x"), "x")


@query("prj10_random_mask_drop", WM + f""", v AS (SELECT image, unnest(range(19)) AS j, unnest({_MASK}) AS mask FROM mn),
d AS (SELECT j, CASE WHEN ('0x' || substr(md5('7:' || image || ':' || j), 1, 13))::BIGINT / pow(2, 52) < 0.3 THEN 0 ELSE mask END AS m FROM v)
SELECT CAST(j AS INTEGER) AS j, CAST(sum(m) AS BIGINT) AS kept FROM d GROUP BY 1""")
def prj10_drop(spark, sf):
    cols = [F.col(c) for c in ("age", "sex", "site", "fitzpatrick")]
    dropped = en.drop_mask(en.meta_mask(*cols), 0.3, 7, F.col("image"), 19)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col("m")[j].alias("m")) for j in range(19)])
    return meta(spark, sf).withColumn("m", dropped).select(F.inline(cells)).groupBy("j").agg(F.sum("m").cast("bigint").alias("kept"))


@query("prj11_age_scaling", WM + f""" SELECT image, {rq('least(greatest(coalesce(age, 45.0), 0.0), 90.0) / 90.0')} AS clip90, {rq('age / 100.0')} AS by100, {rq('coalesce(age, 45.0) / 100.0')} AS by100_filled FROM mn""")
def prj11(spark, sf):
    a = F.col("age")
    return meta(spark, sf).select(
        "image", r(nz.scale_age(a, 90, F.lit(45.0), True)).alias("clip90"), r(nz.scale_age(a, 100, None, False)).alias("by100"),
        r(nz.scale_age(a, 100, F.lit(45.0), False)).alias("by100_filled"))


SYNTH = """sy AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'SYNTH_' || p_brand || '_' || p_partkey ELSE 'REAL_' || p_partkey END AS image, p_type AS class,
 p_size, p_retailprice, p_size > 25 AS big FROM part)"""


def synth_parts(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat_ws("_", F.lit("SYNTH"), "p_brand", "p_partkey")).otherwise(F.concat(F.lit("REAL_"), F.col("p_partkey").cast("string"))).alias("image"),
        F.col("p_type").alias("class"), "p_size", "p_retailprice", (F.col("p_size") > 25).alias("big"))


@query("prj12_median_flag", "WITH " + SYNTH + " SELECT class, CASE WHEN median(big::INTEGER) > 0.5 THEN 'True' ELSE 'False' END AS flag FROM sy GROUP BY 1")
def prj12(spark, sf):
    med = qg.class_medians(synth_parts(spark, sf), "class", [], ["big"])
    return med.select("class", nz.median_flag(F.col("med_big")).alias("flag"))


@query("prj13_synthetic_prefix", "WITH " + SYNTH + " SELECT starts_with(image, 'SYNTH_') AS synthetic, count(*) AS n FROM sy GROUP BY 1")
def prj13(spark, sf):
    return synth_parts(spark, sf).groupBy(nz.is_synthetic(F.col("image")).alias("synthetic")).agg(F.count("*").alias("n"))


# ---- filters and index joins ------------------------------------------------------------

@query("flt1_drop_unknown", "WITH " + LABELS + """ SELECT image, "Q", "T" FROM lw WHERE NOT ("UNK" = 1)""")
def flt1(spark, sf):
    return jn.known_label(labels_wide(spark, sf)).select("image", "Q", "T")


@query("flt2_existing_file", "WITH " + PAGES + " SELECT page_id, host FROM pg WHERE NOT missing")
def flt2(spark, sf):
    listing = files(spark, sf).filter(~F.col("missing")).select("page_id")
    return jn.existing(files(spark, sf), listing, "page_id").select("page_id", "host")


@query("flt3_sampled_existence", "WITH " + PAGES + " SELECT page_id, NOT missing AS exists FROM pg ORDER BY md5('0:' || page_id) LIMIT 20")
def flt3(spark, sf):
    listing = files(spark, sf).filter(~F.col("missing"))
    return jn.check_sample(files(spark, sf), listing, "page_id", fail=False)


@query("flt5_low_confidence", "WITH " + PRED + " SELECT count(*) FILTER (WHERE conf < 0.7) AS below_07, count(*) FILTER (WHERE conf < 0.2) AS below_02 FROM pr")
def flt5(spark, sf):
    rows = predictions(spark, sf)
    return jn.low_confidence(rows, 0.7).agg(F.count("*").alias("below_07"), F.count_if(F.col("conf") < 0.2).alias("below_02"))


@query("flt6_drop_invalid", "WITH " + PAGES + " SELECT host, count(*) AS n FROM pg WHERE NOT missing AND length(html) > 0 GROUP BY 1")
def flt6(spark, sf):
    return jn.drop_invalid(files(spark, sf), ~F.col("missing"), F.length("html") > 0).groupBy("host").agg(F.count("*").alias("n"))


@query("flt7_required_columns", WM + " SELECT image, age, sex, site FROM mn")
def flt7(spark, sf):
    return jn.require_columns(meta(spark, sf), ["image", "age", "sex", "site"]).select("image", "age", "sex", "site")


INTAKE_SQL = """ik AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"ageYears": ' || (event_id % 90) || ', "sex": "Female", "anatomicalSite": "back", "modelMode": "Full Hybrid"}'
 WHEN 1 THEN '{"sex": "male", "anatomicalSite": "leg"}' WHEN 2 THEN '{"ageYears": 40, "sex": "other", "anatomicalSite": " "}' WHEN 3 THEN '{broken' WHEN 4 THEN props ELSE NULL END AS js FROM events)"""


def intake(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 6
    js = (F.when(m == 0, F.concat(F.lit('{"ageYears": '), (F.col("event_id") % 90).cast("string"), F.lit(', "sex": "Female", "anatomicalSite": "back", "modelMode": "Full Hybrid"}')))
          .when(m == 1, '{"sex": "male", "anatomicalSite": "leg"}').when(m == 2, '{"ageYears": 40, "sex": "other", "anatomicalSite": " "}')
          .when(m == 3, "{broken").when(m == 4, F.col("props")))
    return e.select("event_id", js.alias("js"))


@query("flt8_intake_validation", "WITH " + INTAKE_SQL + """ SELECT event_id, event_id % 6 = 0 AS accepted, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '422 ageYears is required'
 WHEN 2 THEN '422 sex is required|422 anatomicalSite is required' WHEN 4 THEN '422 ageYears is required|422 sex is required|422 anatomicalSite is required' ELSE '400 metadata must be valid JSON' END AS errors FROM ik""")
def flt8(spark, sf):
    return jn.split_intake(intake(spark, sf), "js").select("event_id", "accepted", F.array_join("errors", "|").alias("errors"))


@query("flt10_listing_by_class", "WITH " + PRED + f" SELECT y, row_id, pred, {rq('py')} AS true_prob FROM pr WHERE y IN (0, 1) AND row_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt10(spark, sf):
    listed = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id"))
    rows = predictions(spark, sf).select("y", "row_id", "pred", r(F.col("p")[F.col("y")]).alias("true_prob"))
    return jn.listed_rows(rows, listed, "row_id", "y", [0, 1])


@query("jn1_labels_with_metadata", "SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l LEFT JOIN documents d USING (doc_id)")
def jn1(spark, sf):
    out = jn.attach_metadata(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return out.select("doc_id", "quality", "lang", "n_chars")


@query("jn2_union_first_wins", """WITH u AS (SELECT 0 AS src, o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, c_custkey, -1 FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, v) AS rn FROM u) SELECT k, v FROM s WHERE rn = 1""")
def jn2(spark, sf):
    a = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    return dd.first_by_key([a, b], "k")


@query("jn3_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn3(spark, sf):
    return jn.existing(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").filter("quality = 1"), "doc_id")


_VERS = """tk AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS a,
 list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[0-9.,;:!?]+', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS b FROM documents),
vs AS (SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS score FROM tk)"""


def versions(spark, sf):
    """Every text as it is and without digits and stops: the tokens that held one differ."""
    d = table(spark, sf, "documents")
    a = d.select("doc_id", tx.tokens(F.col("text")).alias("items"))
    b = d.select("doc_id", tx.tokens(F.regexp_replace(F.lower("text"), "[0-9.,;:!?]+", " ")).alias("items"))
    return dd.version_pairs(a, b, "doc_id", "items")


@query("jn4_qg7_version_pairs", "WITH " + _VERS + f" SELECT doc_id, {rq('score')} AS score FROM vs")
def jn4(spark, sf):
    return rounded(versions(spark, sf), "score")


@query("agg31_similarity_audit", "WITH " + _VERS + f" SELECT count(*) AS n, {rq('avg(score)')} AS mean, {rq('min(score)')} AS min, {rq('max(score)')} AS max, count(*) FILTER (WHERE score < 0.65) AS below_limit FROM vs")
def agg31(spark, sf):
    return rounded(qg.similarity_audit(versions(spark, sf), "score"), "mean", "min", "max")


@query("agg31_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(40)),
h AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)""")
def agg31_hist(spark, sf):
    return qg.histogram(gate_rows(spark, sf), "l_extendedprice")


@query("qg7_cosine_pairs", f"""WITH e AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
SELECT a.pair, {rq('sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))')} AS score FROM e a JOIN e b ON a.pair = b.pair AND a.d = b.d AND a.side = 0 AND b.side = 1 GROUP BY 1""")
def qg7(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("v"))
    a, b = e.filter("side = 0").select("pair", F.col("v").alias("a")), e.filter("side = 1").select("pair", F.col("v").alias("b"))
    return a.join(b, "pair").select("pair", r(sc.cosine(F.col("a"), F.col("b"))).alias("score"))


@query("jn5_unused_ids", "SELECT id FROM (SELECT unnest(range(1500, 1700 + (SELECT count(*) FROM orders))) AS id) WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY id LIMIT 200")
def jn5(spark, sf):
    return dd.unused_ids(spark, table(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderkey", 1500, 200)


@query("jn6_nearest_value", """WITH c AS (SELECT event_id, value FROM events WHERE event_type = 'purchase'), f AS (SELECT value AS v, min(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY 1),
j AS (SELECT c.event_id, c.value, arg_min(f.id, (abs(f.v - c.value), f.id)) AS nearest_id FROM c, f GROUP BY 1, 2) SELECT event_id, value, nearest_id FROM j""")
def jn6(spark, sf):
    e = table(spark, sf, "events")
    ask, ref = e.filter("event_type = 'purchase'").select("event_id", "value"), e.filter("event_type = 'view'").select(F.col("event_id").alias("rid"), F.col("value").alias("rv"))
    return rk.nearest_value(ask, ref, "value", "rv", "rid").select("event_id", "value", "nearest_id")


@query("jn8_reindex_aggregate", "WITH a AS (SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT a.o_custkey, first_date, n FROM a JOIN b USING (o_custkey)")
def jn8(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp_ntz").cast("timestamp").alias("first_date"))
    b = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return jn.align(a, b, "o_custkey").select("o_custkey", "first_date", "n")


# ---- dedup and set operations -------------------------------------------------------------

@query("set1_content_dedup", "WITH " + CONTENT + ", k AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY priority, doc_id) AS rn FROM ct) SELECT doc_id, dataset, sha1 FROM k WHERE rn = 1")
def set1(spark, sf):
    return dd.content_dedup(content(spark, sf), "sha1", "priority", "doc_id").select("doc_id", "dataset", "sha1")


@query("set1_cross_dataset_only", "WITH " + CONTENT + ", k AS (SELECT *, first_value(dataset) OVER (PARTITION BY sha1 ORDER BY priority, doc_id) AS best FROM ct) SELECT doc_id, dataset, sha1 FROM k WHERE dataset = best")
def set1_across(spark, sf):
    return dd.content_dedup(content(spark, sf), "sha1", "priority", "doc_id", within="dataset").select("doc_id", "dataset", "sha1")


@query("set1_copy_summary", "WITH " + CONTENT + " SELECT sha1, count(*) AS n_copies, count(DISTINCT dataset) AS n_datasets FROM ct GROUP BY 1 HAVING count(*) > 1")
def set1_summary(spark, sf):
    return dd.duplicate_summary(content(spark, sf), "sha1", "dataset")


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("qg6_simhash", "WITH " + NEAR + " SELECT doc_id, hi, lo FROM sh")
def qg6(spark, sf):
    return dd.simhash(documents(spark, sf), "doc_id", "text")


_PAIRS = """fp AS (SELECT hi, lo, min(doc_id) AS id, count(*) AS n FROM sh GROUP BY 1, 2),
pp AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM fp a JOIN fp b ON a.id < b.id
 WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) < 8)"""


def fingerprints(spark, sf):
    from tallyvane.storage import cut_lineage
    return cut_lineage(dd.copies(dd.simhash(documents(spark, sf), "doc_id", "text"), "doc_id"))


@query("jn7_near_pairs", "WITH " + NEAR + "," + _PAIRS + " SELECT id_a, id_b, n_a, n_b, distance FROM pp")
def jn7(spark, sf):
    return dd.near_pairs(fingerprints(spark, sf))


@query("jn7_pair_totals", "WITH " + NEAR + """ SELECT CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance, count(*) AS n_pairs
FROM sh a JOIN sh b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) < 8 GROUP BY 1""")
def jn7_totals(spark, sf):
    return dd.near_pair_totals(fingerprints(spark, sf))


@query("set2_greedy_near_dedup", "WITH RECURSIVE " + NEAR + """, o AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, hi, lo FROM sh),
g(i, ks) AS (SELECT 0::BIGINT, []::STRUCT(h BIGINT, l BIGINT)[] UNION ALL SELECT g.i + 1, CASE WHEN len(list_filter(g.ks, lambda k: bit_count(xor(k.h, o.hi)) + bit_count(xor(k.l, o.lo)) < 8)) > 0
 THEN g.ks ELSE list_append(g.ks, {'h': o.hi, 'l': o.lo}) END FROM g JOIN o ON o.i = g.i + 1),
n AS (SELECT i, len(ks) - lag(len(ks), 1, 0) OVER (ORDER BY i) AS grew FROM g) SELECT d.doc_id, coalesce(grew, 1) = 1 AS kept FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN n USING (i)""")
def set2(spark, sf):
    return dd.near_dedup(documents(spark, sf), "doc_id", "text")


@query("set3_union_all", "SELECT 'd' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'b', item_id, NULL FROM benchmark")
def set3(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"))
    return dd.union_all([a, b])


@query("set5_unseen_vocabulary", """WITH t AS (SELECT p_name, p_partkey FROM part) SELECT DISTINCT p_name || p_partkey % 50 AS v FROM t WHERE p_partkey % 10 = 0 EXCEPT SELECT p_name || p_partkey % 50 FROM t WHERE p_partkey % 10 <> 0""")
def set5(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", (F.col("p_partkey") % 50).cast("string")).alias("v"))
    return dd.unseen_values(p.filter("p_partkey % 10 = 0"), p.filter("p_partkey % 10 <> 0"), "v")


@query("set6_latest_upsert", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def set6(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return dd.latest_by_key(e, "user_id", ["ts", "event_id"])


# ---- statistics and gates --------------------------------------------------------------------

METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg4_metric_stats", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {rq(f'avg({m})', 4)} AS mean, {rq(f'stddev_pop({m})', 4)} AS std, min({m}) AS min, max({m}) AS max FROM lineitem" for m in METRICS))
def agg4(spark, sf):
    return rounded(qg.metric_stats(gate_rows(spark, sf), METRICS), "mean", "std", digits=4)


@query("agg5_class_medians", """SELECT l_returnflag, median(l_quantity) AS med_l_quantity, median(l_extendedprice) AS med_l_extendedprice, median((l_discount > 0.05)::INTEGER)::DOUBLE AS med_deep FROM lineitem GROUP BY 1""")
def agg5(spark, sf):
    rows = gate_rows(spark, sf).withColumn("deep", F.col("l_discount") > 0.05)
    return qg.class_medians(rows, "l_returnflag", ["l_quantity", "l_extendedprice"], ["deep"])


_GATE = """rs AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) AS es, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds FROM lineitem WHERE l_linestatus = 'O'),
gd AS (SELECT l.*, qm, qs, em, es, dm, ds, l_quantity < qm - 2*qs OR l_quantity > qm + 3*qs AS bq, l_extendedprice < em - 2*es OR l_extendedprice > em + 2*es AS be, l_discount < dm - 2*ds OR l_discount > dm + 2*ds AS bd FROM lineitem l, rs WHERE l_linestatus = 'F')"""


def gate_sides(spark, sf):
    rows = gate_rows(spark, sf)
    return rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")


@query("qg2_grade", "WITH " + _GATE + """ SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bq OR be OR bd THEN 'FAIL' ELSE 'PASS' END AS grade,
 concat_ws('; ', CASE WHEN bq THEN 'l_quantity=' || printf('%.1f', round(l_quantity, 1)) || ' outside [' || printf('%.1f', round(qm - 2*qs, 1)) || ', ' || printf('%.1f', round(qm + 3*qs, 1)) || ']' END,
  CASE WHEN be THEN 'l_extendedprice=' || printf('%.1f', round(l_extendedprice, 1)) || ' outside [' || printf('%.1f', round(em - 2*es, 1)) || ', ' || printf('%.1f', round(em + 2*es, 1)) || ']' END,
  CASE WHEN bd THEN 'l_discount=' || printf('%.1f', round(l_discount, 1)) || ' outside [' || printf('%.1f', round(dm - 2*ds, 1)) || ', ' || printf('%.1f', round(dm + 2*ds, 1)) || ']' END) AS fail_reasons FROM gd""")
def qg2(spark, sf):
    cand, real = gate_sides(spark, sf)
    out = qg.grade(cand, real, METRICS, wide="l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "grade", "fail_reasons")


@query("qg3_gate_by_class", f"""WITH rs AS (SELECT l_returnflag, avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) AS es FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_quantity BETWEEN qm - 2*qs AND qm + 3*qs AND l_extendedprice BETWEEN em - 2*es AND em + 2*es) AS passed,
 round(100.0 * count(*) FILTER (WHERE l_quantity BETWEEN qm - 2*qs AND qm + 3*qs AND l_extendedprice BETWEEN em - 2*es AND em + 2*es) / count(*), 2) AS pass_rate_pct
FROM lineitem JOIN rs USING (l_returnflag) WHERE l_linestatus = 'F' GROUP BY 1""")
def qg3(spark, sf):
    cand, real = gate_sides(spark, sf)
    return qg.gate_by_class(cand, real, "l_returnflag", METRICS[:2], wide="l_quantity")


def _fid_sql(metrics, by=""):
    """CTE ``fd``: diagonal distance of candidates from real rows in units of the real deviation."""
    side = lambda m, s, f: f"{f}({m}) FILTER (WHERE l_linestatus = '{s}')"
    term = lambda m: f"(pow({side(m, 'O', 'avg')} - {side(m, 'F', 'avg')}, 2) + {side(m, 'O', 'var_samp')} + {side(m, 'F', 'var_samp')} - 2 * sqrt({side(m, 'O', 'var_samp')} * {side(m, 'F', 'var_samp')})) / {side(m, 'O', 'var_samp')}"
    return f"fd AS (SELECT {by + ', ' if by else ''}{' + '.join(map(term, metrics))} AS fid FROM lineitem{' GROUP BY ' + by if by else ''})"


@query("agg33_quality_summary", "WITH " + _GATE + ", " + _fid_sql(METRICS) + """ SELECT count(*) AS candidate_count, count(*) FILTER (WHERE NOT (bq OR be OR bd)) AS pass_count, count(*) FILTER (WHERE bq OR be OR bd) AS fail_count,
 (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS real_count, round(100.0 * count(*) FILTER (WHERE NOT (bq OR be OR bd)) / count(*), 2) AS pass_rate_pct, round((SELECT fid FROM fd), 6) AS fid, (SELECT (count(*) - count(DISTINCT (l_quantity, l_extendedprice, l_discount)))::BIGINT FROM lineitem WHERE l_linestatus = 'F') AS surplus_copies,
 CASE WHEN (SELECT fid FROM fd) < 50 AND count(*) FILTER (WHERE NOT (bq OR be OR bd)) / count(*) > 0.85 THEN 'PASS' WHEN (SELECT fid FROM fd) < 100 AND count(*) FILTER (WHERE NOT (bq OR be OR bd)) / count(*) > 0.7 THEN 'MARGINAL' ELSE 'REVIEW' END AS verdict FROM gd""")
def agg33(spark, sf):
    cand, real = gate_sides(spark, sf)
    fid, copies = qg.metric_distance(real, cand, METRICS).scalar(), qg.surplus_copies(cand, METRICS).scalar()
    return rounded(qg.quality_summary(qg.grade(cand, real, METRICS, wide="l_quantity"), real, fid, copies, "surplus_copies"), "fid")


_RUN = """dc AS (SELECT doc_id, n_chars::DOUBLE AS chars, doc_id % 3 = 0 AS candidate FROM documents), ds AS (SELECT avg(chars) AS m, stddev_pop(chars) AS s FROM dc WHERE NOT candidate),
dg AS (SELECT chars BETWEEN m - 2 * s AND m + 2 * s AS passed FROM dc, ds WHERE candidate),
df AS (SELECT (pow(avg(chars) FILTER (WHERE NOT candidate) - avg(chars) FILTER (WHERE candidate), 2) + var_samp(chars) FILTER (WHERE NOT candidate) + var_samp(chars) FILTER (WHERE candidate)
  - 2 * sqrt(var_samp(chars) FILTER (WHERE NOT candidate) * var_samp(chars) FILTER (WHERE candidate))) / var_samp(chars) FILTER (WHERE NOT candidate) AS fid FROM dc),
np AS (SELECT count(*) AS n FROM sh a JOIN sh b ON a.doc_id < b.doc_id AND a.doc_id % 3 = 0 AND b.doc_id % 3 = 0 WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) < 8)"""


@query("agg33_quality_run", "WITH " + NEAR + "," + _RUN + """ SELECT count(*) AS candidate_count, count(*) FILTER (WHERE passed) AS pass_count, count(*) FILTER (WHERE NOT passed) AS fail_count,
 (SELECT count(*) FROM dc WHERE NOT candidate) AS real_count, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 2) AS pass_rate_pct, round((SELECT fid FROM df), 6) AS fid, (SELECT n FROM np) AS near_duplicates,
 CASE WHEN (SELECT fid FROM df) < 50 AND count(*) FILTER (WHERE passed) / count(*) > 0.85 THEN 'PASS' WHEN (SELECT fid FROM df) < 100 AND count(*) FILTER (WHERE passed) / count(*) > 0.7 THEN 'MARGINAL' ELSE 'REVIEW' END AS verdict FROM dg""")
def agg33_run(spark, sf):
    """Candidates are a third of the documents, judged against the rest; near duplicates by fingerprint."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("chars")))
    cand, real = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    fid, near = qg.metric_distance(real, cand, ["chars"]).scalar(), qg.near_duplicate_pairs(cand, "doc_id", "text").scalar()
    return rounded(qg.quality_summary(qg.grade(cand.drop("text"), real.drop("text"), ["chars"]), real, fid, near), "fid")


@query("agg30_fid_diagonal", f"""WITH e AS (SELECT vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT d, avg(v) FILTER (WHERE side = 0) AS ma, avg(v) FILTER (WHERE side = 1) AS mb, var_samp(v) FILTER (WHERE side = 0) AS va, var_samp(v) FILTER (WHERE side = 1) AS vb FROM e GROUP BY 1)
SELECT {rq('sum(pow(ma - mb, 2) + va + vb - 2 * sqrt(va * vb))')} AS fid_diagonal FROM s""")
def agg30_diag(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))
    return rounded(qg.frechet_diagonal(e, "embedding", "side", 0, 1, DIM), "fid_diagonal")


@query("agg30_fid", f"""WITH e AS (SELECT vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT d, avg(v) FILTER (WHERE side = 0) AS ma, avg(v) FILTER (WHERE side = 1) AS mb, var_samp(v) FILTER (WHERE side = 0) AS va, var_samp(v) FILTER (WHERE side = 1) AS vb FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM embeddings) AS n, {rq('sum(pow(ma - mb, 2))')} AS mean_part, {rq('sum(va + vb)')} AS trace_part, TRUE AS within FROM s""")
def agg30(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))
    fid = qg.frechet_distance(e, "embedding", "side", 0, 1)
    # the distance lies between its mean part and that plus both traces; its parts come from one plain aggregate
    of = lambda fn, d, t: fn(F.when(F.col("side") == t, F.col("embedding")[d].cast("double")))
    parts = e.agg(F.count("*").alias("n"), *[x.alias(f"{n}{d}") for d in range(DIM) for n, x in (
        ("m", F.pow(of(F.avg, d, 0) - of(F.avg, d, 1), F.lit(2.0))), ("v", of(F.var_samp, d, 0) + of(F.var_samp, d, 1)))])
    total = lambda n: sc.fold_sum([F.col(f"{n}{d}") for d in range(DIM)])
    out = parts.select("n", total("m").alias("mean_part"), total("v").alias("trace_part"))
    return rounded(out.withColumn("within", (F.lit(fid) >= F.col("mean_part") - 1e-9) & (F.lit(fid) <= F.col("mean_part") + F.col("trace_part"))), "mean_part", "trace_part")


@query("agg29_class_manifest", f"""WITH {_fid_sql(METRICS, "l_returnflag")}, rl AS (SELECT l_returnflag, count(*) AS r FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), sy AS (SELECT l_returnflag, count(*) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
rs AS (SELECT l_returnflag, avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
pr AS (SELECT l_returnflag, round(100.0 * count(*) FILTER (WHERE l_quantity BETWEEN qm - 2*qs AND qm + 2*qs) / count(*), 2) AS p FROM lineitem JOIN rs USING (l_returnflag) WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_returnflag, r AS real_images, s AS synthetic_images, r + s AS total_images, round(s / r, 2) AS synth_ratio, round(fid, 2) AS fid, p AS pass_rate_pct FROM rl JOIN sy USING (l_returnflag) JOIN pr USING (l_returnflag) JOIN fd USING (l_returnflag)""")
def agg29(spark, sf):
    cand, real = gate_sides(spark, sf)
    gate = qg.gate_by_class(cand, real, "l_returnflag", ["l_quantity"])
    return qg.class_manifest(real, cand, "l_returnflag", gate, qg.metric_distance(real, cand, METRICS, "l_returnflag"))


# ---- image statistics and record jobs -------------------------------------------------------

def heat_images(spark, sf):
    """An 8 x 8 three-channel image per embedding, in the layout of the image source."""
    b = F.floor((F.col("v") + 1.0) / 2.0 * 255.0).cast("int")
    hexa = F.transform("embedding", lambda v: F.concat(*[
        F.lpad(F.hex(c), 2, "0") for c in (
            F.floor((v + 1.0) / 2.0 * 255.0), (F.floor((v + 1.0) / 2.0 * 255.0) * 3 + 17) % 256, 255 - F.floor((v + 1.0) / 2.0 * 255.0))]))
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("img"), F.col("vec_id").cast("string")).alias("file"),
        F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.unhex(F.array_join(hexa, "")).alias("data")).alias("image"))


@query("qg1_image_stats", f"""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor((unnest(embedding)::FLOAT + 1.0::DOUBLE) / 2.0 * 255.0) AS BIGINT) AS b FROM embeddings),
x AS (SELECT vec_id, i // 8 AS yy, i % 8 AS xx, b, (b * 3 + 17) % 256 AS g, 255 - b AS r FROM c),
y AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS gray, greatest(b, g, r) AS mx, least(b, g, r) AS mn FROM x),
z AS (SELECT *, CASE WHEN mx > 0 THEN ((mx - mn) * CAST(round_even(1044480.0::DOUBLE / mx, 0) AS BIGINT) + 2048) >> 12 ELSE 0 END AS sat FROM y),
n AS (SELECT a.vec_id, a.yy, a.xx, a.gray, u.gray + d.gray + l.gray + q.gray - 4 * a.gray AS lap FROM z a
 JOIN z u ON u.vec_id = a.vec_id AND u.xx = a.xx AND u.yy = CASE WHEN a.yy = 0 THEN 1 ELSE a.yy - 1 END
 JOIN z d ON d.vec_id = a.vec_id AND d.xx = a.xx AND d.yy = CASE WHEN a.yy = 7 THEN 6 ELSE a.yy + 1 END
 JOIN z l ON l.vec_id = a.vec_id AND l.yy = a.yy AND l.xx = CASE WHEN a.xx = 0 THEN 1 ELSE a.xx - 1 END
 JOIN z q ON q.vec_id = a.vec_id AND q.yy = a.yy AND q.xx = CASE WHEN a.xx = 7 THEN 6 ELSE a.xx + 1 END),
s AS (SELECT vec_id, CAST(64 * sum(lap * lap) - sum(lap) * sum(lap) AS DOUBLE) / 4096 AS sharpness FROM n GROUP BY 1)
SELECT 'img' || vec_id AS file, any_value(sharpness) AS sharpness, avg(gray) AS brightness, avg(sat) AS saturation, avg(r) AS r_mean, avg(g) AS g_mean, avg(b) AS b_mean FROM z JOIN s USING (vec_id) GROUP BY vec_id""")
def qg1(spark, sf):
    return qg.folder_stats(heat_images(spark, sf))


def _decode(body: bytes) -> bytes:
    return body.decode("utf-8").encode("utf-8")


def _non_empty(body: bytes) -> bytes:
    if len(body) < 200:
        raise ValueError("too short")
    return body


STAGES = [("decode", _decode), ("size", _non_empty), ("upper", bytes.upper)]


def stage_input(spark, sf):
    body = F.when(F.col("page_id") % 9 == 0, F.unhex(F.lit("FFFE"))).when(F.col("page_id") % 9 == 1, F.encode(F.lit("short"), "UTF-8")).otherwise(F.encode("url", "UTF-8"))
    padded = F.when(F.col("page_id") % 9 > 1, F.encode(F.rpad("url", 200, "."), "UTF-8")).otherwise(body)
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), padded.alias("content"))


_STAGE_SQL = """CASE page_id % 9 WHEN 0 THEN 'decode' WHEN 1 THEN 'size' END"""


@query("qg4_record_job", f"SELECT CAST(page_id AS VARCHAR) AS id, page_id % 9 > 1 AS ok, {_STAGE_SQL} AS failed_stage, CASE WHEN page_id % 9 > 1 THEN sha1(upper(rpad(url, 200, '.'))) END AS output_sha1 FROM pages")
def qg4(spark, sf):
    return qg.run_stages(stage_input(spark, sf), STAGES).select("id", "ok", "failed_stage", "output_sha1")


@query("agg6_stage_failures", f"WITH s AS (SELECT coalesce({_STAGE_SQL}, 'ok') AS stage, count(*) AS n FROM pages GROUP BY 1) SELECT stage, n, {rq('n / sum(n) OVER ()')} AS share FROM s")
def agg6(spark, sf):
    return rounded(qg.stage_failures(qg.run_stages(stage_input(spark, sf), STAGES)), "share")


@query("agg6_throughput", "SELECT count(*) FILTER (WHERE page_id % 9 > 1) AS n_ok, count(*) FILTER (WHERE page_id % 9 <= 1) AS n_failed, TRUE AS has_rate FROM pages")
def agg6_rate(spark, sf):
    """The rate is of this run, so only its presence can be compared."""
    return qg.throughput(qg.run_stages(stage_input(spark, sf), STAGES)).select("n_ok", "n_failed", (F.col("records_per_task_second") > 0).alias("has_rate"))


@query("qg5_incremental_rerun", "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE page_id % 9 <= 1 OR page_id % 4 = 0")
def qg5(spark, sf):
    source = stage_input(spark, sf).withColumn("id", F.col("id").cast("string"))
    done = qg.run_stages(source.filter(F.col("id").cast("int") % 4 != 0), STAGES)
    return qg.pending(source, done).select("id")


# ---- sources read from files ------------------------------------------------------------

def written_sources(spark, sf) -> str:
    """Source folders made of customers: a training pair, a test pair without its metadata, one coded table."""
    root = scratch_path(spark, "raw")
    c = table(spark, sf, "customer").withColumn("image", F.concat(F.lit("IMG_"), F.col("c_custkey").cast("string")))
    k = F.col("c_custkey")
    put = lambda df, name: df.write.option("header", True).csv(f"{root}/{name}")
    onehot = [(k % 8 == i).cast("double").alias(code) for i, code in enumerate(CLASSES)]
    put(c.filter(k % 4 != 0).select("image", *onehot), "isic2019/ISIC_2019_Training_GroundTruth.csv")
    put(c.filter(k % 4 == 0).select("image", *onehot), "isic2019/ISIC_2019_Test_GroundTruth.csv")
    meta_cols = ((k % 97).alias("age_approx"), F.when(k % 3 == 0, "male").otherwise("female").alias("sex"), F.lit("head/neck").alias("anatom_site_general"))
    put(c.filter(k % 5 != 0).select("image", *meta_cols, F.concat(F.lit("L"), F.floor(k / 3).cast("string")).alias("lesion_id")), "isic2019/ISIC_2019_Training_Metadata.csv")
    codes = F.array(*[F.lit(x) for x in ("mel", "nv", "bcc", "zzz")])
    put(c.select(F.col("image").alias("image_id"), F.get(codes, (k % 4).cast("int")).alias("dx"), (k % 90).alias("age"), F.lit("m").alias("sex"), F.lit("back").alias("localization"), F.col("image").alias("lesion_id")),
        "ham10000/HAM10000_metadata.csv")
    return root


_CODES = ", ".join(f"'{c}'" for c in CLASSES)
_FROM_FILES = f"""a AS (SELECT 'isic2019' AS dataset_key, 'IMG_' || c_custkey AS image_id, ([{_CODES}])[c_custkey % 8 + 1] AS class_name,
  CASE WHEN c_custkey % 5 <> 0 THEN 'L' || c_custkey // 3 ELSE 'IMG_' || c_custkey END AS lesion_id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 97 > 0 THEN (c_custkey % 97)::DOUBLE END AS age,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'male' ELSE 'female' END END AS sex FROM customer WHERE c_custkey % 4 <> 0),
h AS (SELECT 'ham10000' AS dataset_key, 'IMG_' || c_custkey AS image_id, (['MEL', 'NV', 'BCC'])[c_custkey % 4 + 1] AS class_name, 'IMG_' || c_custkey AS lesion_id,
  CASE WHEN c_custkey % 90 > 0 THEN (c_custkey % 90)::DOUBLE END AS age, 'male' AS sex FROM customer WHERE c_custkey % 4 <> 3)"""


@query("src5_pairs_from_files", "WITH " + _FROM_FILES + " SELECT image_id, class_name, lesion_id, age, sex FROM a")
def src5_files(spark, sf):
    rows, _ = ad.load_all(spark, ["isic2019"], written_sources(spark, sf))
    return rows.select("image_id", "class_name", "lesion_id", "age", "sex")


@query("src9_load_from_files", "WITH " + _FROM_FILES + " SELECT * FROM a UNION ALL SELECT * FROM h")
def src9_files(spark, sf):
    rows, _ = ad.load_all(spark, ["isic2019", "ham10000", "pad_ufes_20"], written_sources(spark, sf))
    return rows.select("dataset_key", "image_id", "class_name", "lesion_id", "age", "sex")


@query("src9_load_status", """WITH c AS (SELECT count(*) FILTER (WHERE c_custkey % 4 <> 0) AS i, count(*) FILTER (WHERE c_custkey % 4 <> 3) AS h FROM customer)
SELECT * FROM (SELECT 'isic2019' AS dataset_key, 'loaded without ISIC_2019_Test_GroundTruth.csv + ISIC_2019_Test_Metadata.csv' AS status, i AS n FROM c UNION ALL SELECT 'ham10000', 'loaded', h FROM c
 UNION ALL SELECT 'pad_ufes_20', 'no files', 0 FROM c UNION ALL SELECT 'other', 'no adapter', 0 FROM c)""")
def src9_status(spark, sf):
    rows, status = ad.load_all(spark, ["isic2019", "ham10000", "pad_ufes_20", "other"], written_sources(spark, sf))
    counts = rows.groupBy("dataset_key").agg(F.count("*").alias("n"))
    said = spark.createDataFrame(status, "dataset_key string, status string").withColumn("status", F.regexp_replace("status", "^no files.*", "no files"))
    return said.join(counts, "dataset_key", "left").select("dataset_key", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("src2_scanned_folders", "SELECT CAST(page_id % 7 AS VARCHAR) AS folder, 'txt' AS ext, count(*) AS n_lines, sum(strlen(url) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1")
def src2_scan(spark, sf):
    """Pages written as text files in folders, found and read again by the scanner."""
    root = scratch_path(spark, "listing")
    pages = table(spark, sf, "pages").select(F.col("url").alias("value"), (F.col("page_id") % 7).alias("folder"))
    pages.write.partitionBy("folder").text(root)
    found = cg.list_files(spark, root).select(F.regexp_extract("path", "folder=([0-9]+)", 1).alias("folder"), F.ltrim(F.col("ext"), F.lit(".")).alias("ext"), "length", F.decode("content", "UTF-8").alias("text"))
    return found.groupBy("folder", "ext").agg(F.sum(F.regexp_count("text", F.lit("\n"))).cast("bigint").alias("n_lines"), F.sum("length").alias("n_bytes"))
