"""Report queries: strings, dates, JSON, conditional columns and case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import clinical as cl, normalize as nz, scores as sc, text as tx
from tallyvane.operators import casebook as cb, joins as jn, quality as qg, ranking as rk
from tallyvane.plans.curate import INTAKE_SQL, intake
from tallyvane.plans.fixtures import CASE, HISTORY, META, cases, flagged_cases, heat_sql, history, meta_raw, table
from tallyvane.plans.registry import query, r, rq
from tallyvane.schema import CLASSES, MALIGNANT_REPORT

WC = "WITH " + CASE
WM = "WITH " + META

# ---- strings, dates, JSON ---------------------------------------------------------------


@query("str1_stem_and_extension", """SELECT page_id, regexp_replace(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '\\.[^.]*$', ''), '_downsampled$', '') AS stem,
 CASE WHEN lower(regexp_extract(regexp_extract(u, '([^/]*)$', 1), '\\.([^.]+)$', 1)) = '' THEN 'png' ELSE lower(regexp_extract(regexp_extract(u, '([^/]*)$', 1), '\\.([^.]+)$', 1)) END AS ext
 FROM (SELECT page_id, regexp_replace(url, '\\?.*$', '') || CASE page_id % 3 WHEN 0 THEN '_downsampled.JPG' WHEN 1 THEN '.Png' ELSE '' END AS u FROM pages)""")
def str1(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, "_downsampled.JPG").when(F.col("page_id") % 3 == 1, ".Png").otherwise("")
    u = F.concat(F.regexp_replace("url", "\\?.*$", ""), tail)
    return table(spark, sf, "pages").select("page_id", tx.stem(u).alias("stem"), tx.extension(u, "png").alias("ext"))


@query("str2_feature_titles", "SELECT p_partkey, 'Site: ' || (['Head/Neck', 'Anterior Torso', 'Oral/Genital'])[p_partkey % 3 + 1] AS title, 'Age Approx' AS plain FROM part")
def str2(spark, sf):
    name = F.concat(F.lit("site_"), F.get(F.array(F.lit("head/neck"), F.lit("anterior torso"), F.lit("oral/genital")), (F.col("p_partkey") % 3).cast("int")))
    return table(spark, sf, "part").select("p_partkey", tx.feature_title(name).alias("title"), tx.feature_title(F.lit("age_approx")).alias("plain"))


_RULE = "━" * 49


def narratives(spark, sf):
    """Conversation texts, two thirds of them wrapped in the report headings."""
    c = table(spark, sf, "conversations")
    m = (F.col("conv_id") + F.col("turn")) % 6
    head = f"{_RULE}\nACME CLINICAL EXPLAINABILITY REPORT\n{_RULE}\r\n\nPREDICTION\n  Diagnosis   : Melanoma.\n  Confidence  : 80% .\n  Threshold   : 0.57 . \n\nEVIDENCE\n  "
    tail = F.when(m == 3, " You should biopsy.").when(m == 4, " <b>").otherwise("")
    return c.select("conv_id", "turn", F.when(m >= 2, F.concat(F.lit(head), "text", tail)).when(m == 1, "  ").otherwise(F.col("text")).alias("raw"))


NARR = f"""nr AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 >= 2 THEN '{_RULE}' || chr(10) || 'ACME CLINICAL EXPLAINABILITY REPORT' || chr(10) || '{_RULE}' || chr(13) || chr(10) || chr(10) || 'PREDICTION' || chr(10)
 || '  Diagnosis   : Melanoma.' || chr(10) || '  Confidence  : 80% .' || chr(10) || '  Threshold   : 0.57 . ' || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || '  ' || text || CASE (conv_id + turn) % 6 WHEN 3 THEN ' You should biopsy.' WHEN 4 THEN ' <b>' ELSE '' END
 WHEN (conv_id + turn) % 6 = 1 THEN '  ' ELSE text END AS raw FROM conversations)"""


@query("str3_sanitise_narrative", "WITH " + NARR + f""", s1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\r\\n', chr(10), 'g'), '\\s+', ' ', 'g'), '{_RULE}', '', 'g'), '[A-Z]+ CLINICAL EXPLAINABILITY REPORT', '', 'g') AS t FROM nr),
s2 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '\\bPREDICTION\\b', '', 'g'), '\\bEVIDENCE\\b', '', 'g'), '\\bREASONING\\b', '', 'g') AS t FROM s1)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\bDiagnosis\\s*:[^.]*', '', 'gi'), '\\bConfidence\\s*:[^.]*', '', 'gi'), '\\bThreshold\\s*:[^.]*', '', 'gi')) AS clean FROM s2""")
def str3(spark, sf):
    return narratives(spark, sf).select("conv_id", "turn", tx.sanitise(F.col("raw")).alias("clean"))


@query("str4_validate_narrative", "WITH " + NARR + """, v AS (SELECT conv_id, turn, trim(raw) AS t FROM nr),
k AS (SELECT *, t <> '' AND contains(t, 'CLINICAL EXPLAINABILITY REPORT') AND contains(t, 'PREDICTION') AND contains(t, 'Diagnosis') AND contains(t, 'Confidence') AND contains(t, 'Threshold') AND contains(t, 'EVIDENCE')
 AND NOT (contains(t, '[') OR contains(t, ']') OR contains(t, '<') OR contains(t, '>')) AND NOT (contains(lower(t), 'you should biopsy') OR contains(lower(t), 'biopsy is required') OR contains(lower(t), 'no follow-up needed') OR contains(lower(t), 'definitively benign')) AS ok FROM v)
SELECT conv_id, turn, CASE WHEN ok THEN t ELSE 'FALLBACK' END AS report FROM k""")
def str4(spark, sf):
    return narratives(spark, sf).select("conv_id", "turn", tx.validate_narrative(F.col("raw"), F.lit("FALLBACK")).alias("report"))


@query("str7_number_formats", "SELECT p_partkey, printf('%.1f', round(p_retailprice * 0.01, 1)) || '%' AS pct, CASE WHEN p_retailprice - 1000 >= 0 THEN '+' ELSE '' END || printf('%.3f', round(p_retailprice - 1000, 3)) AS delta FROM part")
def str7(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(tx.fixed(F.col("p_retailprice") * 0.01, 1), F.lit("%")).alias("pct"), tx.signed(F.col("p_retailprice") - 1000).alias("delta"))


@query("str8_mode_aliases", """SELECT p_partkey, (['full', 'image_only', 'effnet_only', 'swin_only', 'full'])[p_partkey % 5 + 1] AS mode, CASE WHEN p_partkey % 5 = 3 THEN 'Swin Only' ELSE 'Full Hybrid' END AS display,
 CASE WHEN p_partkey % 5 = 3 THEN 'swin_only' ELSE 'full' END AS code FROM part""")
def str8(spark, sf):
    spelled = F.get(F.array(*[F.lit(m) for m in ("full hybrid", " IMAGE-ONLY ", "effnet only", "Swin Only", None)]), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf, "part").select("p_partkey", nz.normalize_mode(spelled).alias("mode"), nz.display_mode(spelled).alias("display"), nz.display_mode_code(spelled).alias("code"))


@query("str9_na_parsing", WM + """ SELECT image, CASE WHEN upper(trim(site_raw)) IN ('', 'NA', 'UNKNOWN') THEN NULL ELSE lower(trim(site_raw)) END AS site, TRY_CAST(age_raw AS DOUBLE) AS age,
 CASE WHEN lower(trim(sex_raw)) = 'female' THEN 'Female' WHEN lower(trim(sex_raw)) = 'male' THEN 'Male' ELSE 'Unknown' END AS sex_shown, CASE WHEN trim(coalesce(site_raw, '')) = '' THEN 'Unknown' ELSE trim(site_raw) END AS site_shown FROM mr""")
def str9(spark, sf):
    return meta_raw(spark, sf).select(
        "image", nz.na_lower(F.col("site_raw")).alias("site"), nz.na_age(F.col("age_raw")).alias("age"),
        nz.display_sex(F.col("sex_raw")).alias("sex_shown"), nz.display_site(F.col("site_raw")).alias("site_shown"))


@query("dat1_tolerant_dates", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) END AS parsed FROM events""")
def dat1(spark, sf):
    ts, m = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    text = (F.when(m == 0, F.date_format(ts, "yyyy-MM-dd")).when(m == 1, F.date_format(ts, "yyyy-MM-dd'T'H:mm")).when(m == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(m == 3, F.concat(F.lit("  "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(m == 4, "not a date").otherwise("2024-13-45"))
    return table(spark, sf, "events").select("event_id", tx.parse_date(text).alias("parsed"))


@query("jsn1_parse_intake", "WITH " + INTAKE_SQL + """ SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(js) THEN js END, '$.ageYears') AS DOUBLE) AS age, lower(json_extract_string(CASE WHEN json_valid(js) THEN js END, '$.sex')) AS sex FROM ik WHERE json_valid(js)""")
def jsn1(spark, sf):
    doc = F.from_json("js", "ageYears double, sex string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = intake(spark, sf).withColumn("d", doc).filter(F.col("js").isNotNull() & F.col("d._bad").isNull())
    return rows.select("event_id", F.col("d.ageYears").alias("age"), F.lower("d.sex").alias("sex"))


@query("jsn1_diagnosis_document", WC + """ SELECT row_id, code AS class, label AS class_full, conf AS confidence, malignant AS is_malignant, round(mal, 4) AS malignant_total, 8::BIGINT AS n_probabilities, 3 AS n_top FROM fl""")
def jsn1_doc(spark, sf):
    docs = flagged_cases(spark, sf).select("row_id", cb.diagnosis_json().alias("doc"))
    back = F.from_json("doc", "prediction struct<class:string,class_full:string,confidence:double,is_malignant:boolean>, probabilities map<string,double>, "
                       "top3 array<struct<class:string,probability:double>>, clinical_flags struct<malignant_total_prob:double>")
    d = docs.withColumn("d", back)
    return d.select(
        "row_id", "d.prediction.class", "d.prediction.class_full", "d.prediction.confidence", "d.prediction.is_malignant",
        F.col("d.clinical_flags.malignant_total_prob").alias("malignant_total"), F.size("d.probabilities").cast("bigint").alias("n_probabilities"), F.size("d.top3").alias("n_top"))


@query("jsn2_fingerprint", """SELECT c_custkey, sha1('{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def jsn2(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.json_fingerprint({"segment": F.col("c_mktsegment"), "key": F.col("c_custkey")}).alias("fingerprint"))


# ---- conditional columns -------------------------------------------------------------------


@query("cnd1_4_levels_and_flags", WC + f""" SELECT row_id, code, conf, CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.5 THEN 'moderate' ELSE 'low' END AS level, thr AS threshold, {rq('conf - thr', 4)} AS margin,
 {rq('mal', 4)} AS malignant_total, requires_biopsy, low_confidence, differential_diagnosis, CASE WHEN code IN ('MEL', 'SCC') OR requires_biopsy THEN 'High concern' WHEN code IN ('BCC', 'AK') THEN 'Expedited review' ELSE 'Routine' END AS urgency,
 code IN ('MEL', 'BCC', 'SCC') AS malignant_ui FROM fl""")
def cnd1(spark, sf):
    code, conf = F.col("code"), F.col("conf")
    return flagged_cases(spark, sf).select(
        "row_id", "code", "conf", cl.confidence_level(conf).alias("level"), cl.class_threshold(code).alias("threshold"), r(cl.threshold_margin(code, conf), 4).alias("margin"),
        r("malignant_total_prob", 4).alias("malignant_total"), "requires_biopsy", "low_confidence", "differential_diagnosis",
        cl.urgency(code, F.col("requires_biopsy")).alias("urgency"), cl.is_malignant(code, MALIGNANT_REPORT).alias("malignant_ui"))


@query("cnd4_recommendation", WC + """ SELECT row_id, CASE WHEN requires_biopsy THEN 'Prioritize dermatologist review for ' || label || '; biopsy consideration requires clinician confirmation.'
 WHEN low_confidence OR differential_diagnosis THEN 'Review the differential diagnosis and image evidence before final disposition.'
 ELSE 'Routine dermatologist review; model confidence is ' || CAST(round_even(conf * 100, 0) AS INTEGER) || '% with calibrated threshold support.' END AS recommendation,
 CASE WHEN code IN ('MEL', 'SCC') OR requires_biopsy THEN 'HIGH — requires immediate dermatologist review' WHEN code IN ('BCC', 'AK') THEN 'ELEVATED — prioritize clinician review' ELSE 'ROUTINE — clinician review still required' END AS priority FROM fl""")
def cnd4(spark, sf):
    c = flagged_cases(spark, sf)
    return c.select(
        "row_id", cl.recommendation(F.col("code"), F.col("conf"), F.col("requires_biopsy"), F.col("low_confidence"), F.col("differential_diagnosis")).alias("recommendation"),
        cl.priority_label(cl.urgency(F.col("code"), F.col("requires_biopsy"))).alias("priority"))


@query("cnd5_evidence_alignment", WC + " SELECT row_id, g_zone_family, a_zone_family, alignment FROM fl")
def cnd5(spark, sf):
    return flagged_cases(spark, sf).select("row_id", "g_zone_family", "a_zone_family", "alignment")


@query("cnd6_arr1_heat_summary", "WITH " + heat_sql("g", "d - 1") + " SELECT * FROM gh")
def arr1(spark, sf):
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return qg.summarize_heat(grid, "row_id", "embedding", 8)


_HINTS = """hn AS (SELECT *, CASE WHEN code = 'VASC' THEN 'vascular emphasis' WHEN contains(g_region, 'border') THEN 'border irregularity' WHEN contains(g_region, 'central') AND code IN ('BCC', 'SCC') THEN 'central nodule'
 WHEN contains(g_region, 'central') THEN 'lesion body' ELSE 'non-specific localisation' END AS prim,
 CASE WHEN site IN ('head/neck', 'upper extremity') AND malignant THEN 'sun-exposed site increases suspicion' WHEN age < 35 AND sex = 'female' AND contains(coalesce(site, ''), 'torso') THEN 'torso site in young female slightly lowers concern' ELSE 'metadata non-contributory' END AS context,
 concat_ws('|', CASE WHEN conf < 0.5 THEN 'low_confidence' END, CASE WHEN alignment = 'discordant' THEN 'discordant_attention' END, CASE WHEN abs(conf - thr) <= 0.08 THEN 'borderline_threshold' END) AS flags FROM fl)"""


@query("cnd7_feature_hints", WC + "," + _HINTS + """ SELECT row_id, prim AS primary_feature, concat_ws('|', CASE WHEN prim = 'border irregularity' THEN 'asymmetry' END, CASE alignment WHEN 'aligned' THEN 'convergent image attribution' WHEN 'discordant' THEN 'discordant image attribution' END) AS secondary,
 context, flags FROM hn""")
def cnd7(spark, sf):
    c = cb.with_hints(flagged_cases(spark, sf))
    return c.select("row_id", "primary_feature", F.array_join("secondary_features", "|").alias("secondary"), F.col("clinical_context").alias("context"), F.array_join("uncertainty_flags", "|").alias("flags"))


@query("cnd8_abcde", WC + """, s AS (SELECT row_id, mel, CAST(row_id % 3 + (row_id // 3) % 3 + (row_id // 9) % 3 + (row_id // 27) % 2 + (row_id // 54) % 2 AS INTEGER) AS score FROM fl)
SELECT row_id, score, CASE WHEN score >= 5 OR (score >= 4 AND mel >= 0.25) OR mel >= 0.5 THEN 'High Concern — Biopsy Recommended' WHEN score >= 3 OR mel >= 0.15 THEN 'Moderate Concern — Short-term Follow-up' ELSE 'Low Concern — Routine Surveillance' END AS composite,
 CASE WHEN score >= 5 THEN 'High Concern (Biopsy Indicated)' WHEN score >= 3 THEN 'Moderate Concern (Close Follow-Up)' ELSE 'Low Concern (Routine)' END AS tier FROM s""")
def cnd8(spark, sf):
    c = cases(spark, sf)
    score = cl.abcde_score(cb.abcde_points(F.col("row_id")))
    return c.select("row_id", score.alias("score"), cl.abcde_composite(score, F.col("p")[CLASSES.index("MEL")]).alias("composite"), cl.abcde_tier(score, cl.ABCDE_REPORT_TIERS).alias("tier"))


@query("cnd9_audit_checks", WC + """, m AS (SELECT row_id, age IS NOT NULL AND sex IS NOT NULL AND site IS NOT NULL AS full_meta, row_id % 2 = 0 AS gen FROM fl), i AS (SELECT unnest(['preprocess', 'metadata', 'explainability', 'slm']) AS id)
SELECT row_id, id, CASE id WHEN 'metadata' THEN CASE WHEN full_meta THEN 'pass' ELSE 'warning' END WHEN 'slm' THEN CASE WHEN gen THEN 'pass' ELSE 'review-needed' END ELSE 'pass' END AS status FROM m, i""")
def cnd9(spark, sf):
    c = cases(spark, sf)
    status = F.when(F.col("row_id") % 2 == 0, "Generated locally").otherwise("Fallback")
    checks = cl.audit_checks(cl.metadata_complete(F.col("age"), F.col("sex"), F.col("site")), status)
    return c.select("row_id", F.inline(checks)).select("row_id", "id", "status")


@query("str5_fallback_report", WC + "," + _HINTS + """, o AS (SELECT row_id, k, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, k) AS pos FROM cp), al AS (SELECT o.row_id, n.label AS alt, CAST(round(CAST(CAST(round(p, 4) * 100 AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE) AS altp FROM o JOIN names n USING (k) WHERE pos = 2),
f AS (SELECT hn.*, alt, altp, CAST(round(CAST(CAST(conf * 100 AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE) AS cp1 FROM hn JOIN al USING (row_id))
SELECT row_id, """ + f"""'{_RULE}' || chr(10) || 'CLINICAL EXPLAINABILITY REPORT' || chr(10) || '{_RULE}' || chr(10) || chr(10) || 'PREDICTION' || chr(10) || '  Diagnosis   : ' || label || ' (' || code || ')' || chr(10)
 || '  Confidence  : ' || printf('%.1f', cp1) || '% (' || CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.5 THEN 'moderate' ELSE 'low' END || ' confidence)' || chr(10) || '  Threshold   : ' || printf('%.2f', thr) || ' (tuned — default 0.50)' || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || '  ' ||
 concat_ws(' ', 'The model favours ' || label || ' because Grad-CAM++ activation concentrates on the ' || g_region || CASE WHEN g_area_pct > 0 THEN ' (' || printf('%.1f', g_area_pct) || '% coverage)' ELSE '' END || ', suggesting the key discriminative signal is ' || prim || '.',
 CASE alignment WHEN 'aligned' THEN 'Both EfficientNet (Grad-CAM++) and SwinV2 (attention) branches converge on the ' || g_region || ', providing corroborative spatial support for the predicted class.'
  WHEN 'discordant' THEN 'The EfficientNet branch highlights the ' || g_region || ' while SwinV2 attention peaks at the ' || a_region || ' — this discordance reduces diagnostic certainty and warrants closer dermoscopic inspection.'
  ELSE 'The two branches show partial overlap: Grad-CAM++ peaks at the ' || g_region || ' and SwinV2 at the ' || a_region || '; the evidence is not fully convergent.' END,
 CASE WHEN cp1 - altp < 15 THEN 'The closest differential is ' || alt || ' at ' || printf('%.1f', altp) || '% — only ' || printf('%.1f', CAST(round(CAST(CAST(cp1 - altp AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE)) || ' pts below the primary prediction. This narrow separation means clinical correlation is especially important.'
  ELSE 'The nearest alternative, ' || alt || ' (' || printf('%.1f', altp) || '%), trails by ' || printf('%.1f', CAST(round(CAST(CAST(cp1 - altp AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE)) || ' pts, providing reasonable separation from the primary prediction.' END,
 CASE WHEN malignant THEN 'The lesion classifies as malignant with a combined malignant probability of ' || printf('%.1f', CAST(round(CAST(CAST(round(mal, 4) * 100 AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE)) || '%.' || CASE WHEN context <> 'metadata non-contributory' THEN ' Metadata context: ' || context || '.' ELSE '' END
  WHEN context <> 'metadata non-contributory' THEN 'Clinical context: ' || context || '.' END,
 CASE WHEN flags <> '' THEN 'Uncertainty flags raised: ' || replace(replace(flags, '|', ', '), '_', ' ') || '. Clinician should verify with direct dermoscopic examination of structural features (pigment network, vascular patterns, symmetry) that the model cannot reliably assess.'
  ELSE 'No specific uncertainty flags were raised, but clinician verification remains required — the model does not assess dermoscopic structures such as pigment network regularity, vascular patterns, or ulceration directly.' END) AS report FROM f""")
def str5(spark, sf):
    return cb.with_narrative(cb.with_hints(flagged_cases(spark, sf))).select("row_id", F.col("fallback").alias("report"))


@query("str6_full_report")
def str6(spark, sf):
    c = cb.with_narrative(cb.with_hints(flagged_cases(spark, sf)))
    return cb.with_report(c, cb.abcde_points(F.col("row_id"))).select("row_id", "report")


@query("str10_heat_sentence", "WITH " + heat_sql("g", "d - 1") + """ SELECT row_id, 'Grad-CAM++ concentrates on the ' || region || ', activating ' || printf('%.1f', area_pct) || '% of the image area (peak at pixel ' || peak_x || ', ' || peak_y || ').' AS sentence,
 'SwinV2 attention was not generated for this inference mode.' AS missing FROM gh""")
def str10(spark, sf):
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    h = qg.summarize_heat(grid, "row_id", "embedding", 8)
    none = F.lit(None).cast("string")
    return h.select(
        "row_id", cl.heat_sentence("Grad-CAM++", F.lit(True), F.col("region"), F.col("area_pct"), F.col("peak_x"), F.col("peak_y")).alias("sentence"),
        cl.heat_sentence("SwinV2 attention", F.lit(False), none, none.cast("double"), none.cast("int"), none.cast("int")).alias("missing"))


# ---- histories and case records --------------------------------------------------------------


@query("flt9_history_filter", "WITH " + HISTORY + " SELECT 'patient' AS mode, count(*) AS n FROM hi WHERE samePatient UNION ALL SELECT 'high', count(*) FROM hi WHERE urgency = 'High concern' UNION ALL SELECT 'all', count(*) FROM hi")
def flt9(spark, sf):
    h = history(spark, sf)
    parts = [jn.history_filter(h, m).groupBy().agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("patient", "high", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SEV = "CASE status WHEN 'Senior review' THEN 3 WHEN 'In review' THEN 2 WHEN 'Needs review' THEN 1 ELSE 0 END"


@query("srt6_review_order", "WITH " + HISTORY + f", o AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY date DESC NULLS LAST, {_SEV} DESC, confidence DESC, id) AS pos FROM hi) SELECT user_id, id, CAST(pos AS INTEGER) AS pos FROM o")
def srt6(spark, sf):
    h = history(spark, sf).withColumn("one", F.lit(1))
    order = jn.review_order(F.col("date"), F.col("status"), F.col("confidence"), F.col("id"))
    ranked = rk.prefix_sums(h, ["user_id"], order, ["one"])
    return ranked.select("user_id", "id", F.col("cum_one").cast("int").alias("pos"))


@query("srt6_case_entries", WC + """, et AS (SELECT row_id, i, row_id * 10 + i AS id, CASE WHEN (row_id + i) % 4 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * ((row_id * i) % 3) END AS date,
 (['Reviewed', 'Needs review', 'In review', 'Senior review'])[(row_id + i) % 4 + 1] AS status, conf AS confidence FROM fl, (SELECT unnest(range(1, 6)) AS i)),
o AS (SELECT row_id, id, row_number() OVER (PARTITION BY row_id ORDER BY date DESC NULLS LAST, """ + _SEV + """ DESC, confidence DESC, id) AS pos FROM et) SELECT row_id, id, CAST(pos AS INTEGER) AS pos FROM o""")
def srt6_case(spark, sf):
    """The entries array of one case record, sorted inside the record."""
    status = lambda n: F.get(F.array(*[F.lit(x) for x in ("Reviewed", "Needs review", "In review", "Senior review")]), ((F.col("row_id") + n) % 4).cast("int"))
    day = lambda n: F.when((F.col("row_id") + n) % 4 != 0, F.timestamp_add("DAY", ((F.col("row_id") * n) % 3).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    entries = F.array(*[F.struct((F.col("row_id") * 10 + n).alias("id"), day(n).alias("date"), status(n).alias("status"), F.col("conf").alias("confidence")) for n in range(1, 6)])
    rows = cases(spark, sf).select("row_id", entries.alias("entries"))
    return rows.select("row_id", F.posexplode_outer(jn.review_array(F.col("entries"))).alias("pos", "e")).select("row_id", F.col("e.id").alias("id"), (F.col("pos") + 1).alias("pos"))


@query("srt6_review_queue", "WITH " + HISTORY + f" SELECT id, status, confidence FROM hi ORDER BY date DESC NULLS LAST, {_SEV} DESC, confidence DESC, id")
def srt6_queue(spark, sf):
    h = history(spark, sf)
    order = jn.review_order(F.col("date"), F.col("status"), F.col("confidence"), F.col("id"))
    return h.orderBy(*order).select("id", "status", "confidence")


@query("cse1_case_record", WC + """ SELECT row_id, 'CASE-' || row_id AS id, code AS predicted, urg AS urgency, CASE WHEN age IS NOT NULL AND sex IS NOT NULL AND site IS NOT NULL THEN 'Complete' ELSE 'Partial' END AS completeness,
 8 AS n_scores, 1 AS n_history, CASE WHEN row_id % 2 = 0 THEN 2 ELSE 1 END AS n_compare, CASE WHEN row_id % 2 = 0 THEN 'Raw input' ELSE 'Previous same-patient review' END AS first_label
 FROM (SELECT *, CASE WHEN code IN ('MEL', 'SCC') OR requires_biopsy THEN 'High concern' WHEN code IN ('BCC', 'AK') THEN 'Expedited review' ELSE 'Routine' END AS urg FROM fl)""")
def cse1(spark, sf):
    c = cb.case_records(flagged_cases(spark, sf), compare_when=F.col("row_id") % 2 == 0)
    return c.select(
        "row_id", "record.id", F.col("record.predictedClassCode").alias("predicted"), "record.urgency", F.col("record.metadata.metadataCompleteness").alias("completeness"),
        F.size("record.predictionScores").alias("n_scores"), F.size("record.historyEntries").alias("n_history"),
        F.size("record.compareEntries").alias("n_compare"), F.col("record.compareEntries")[0]["label"].alias("first_label"))
