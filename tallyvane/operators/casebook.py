"""Case assembly: hints, narrative, report text, diagnosis document and nested case record.

Input rows carry row_id, code, conf, p (eight classes), age/sex/site, the two heat summaries
(g_*, a_*), the clinical flags and the alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import clinical as cl, normalize as nz, scores as sc, text as tx
from tallyvane.schema import CLASS_LABELS, CLASS_THRESHOLDS, CLASSES, DEFAULT_THRESHOLD, MALIGNANT

# --- Fixed values: notes of the case record -------------------------------------
BANNER = "Decision support only; dermatologist review required before clinical action."
HISTORY_NOTE = "Live backend inference result from uploaded dermoscopy image."
RAW_NOTE = "Raw image retained for preprocessing comparison and audit."
BUNDLE_NOTE = "Final preprocessed image, Grad-CAM, attention, and diagnosis JSON are available."
STATUS = "Needs review"
# -----------------------------------------------------------------------------


def with_hints(df: DataFrame) -> DataFrame:
    """CND7."""
    code = F.col("code")
    available = F.col("g_region").isNotNull() | F.col("a_region").isNotNull()
    df = df.withColumn("primary_feature", cl.primary_feature(code, F.col("g_region"), available))
    return df.withColumns({
        "secondary_features": cl.secondary_features(F.col("primary_feature"), F.col("alignment")),
        "clinical_context": cl.clinical_context(code, F.col("age"), F.col("sex"), F.col("site")),
        "uncertainty_flags": cl.uncertainty_flags(code, F.col("conf"), F.col("alignment")),
    })


def with_narrative(df: DataFrame, generated: Column | None = None) -> DataFrame:
    """STR4/STR5. The fallback text and the narrative to show."""
    df = df.withColumn("top3", sc.top_k(F.col("p"), 3, CLASSES))
    second = F.get("top3", F.lit(1))
    text = cl.fallback_report(
        F.col("code"), F.col("conf"), second["class"], F.round(second["probability"], 4), cl.is_malignant(F.col("code")),
        F.col("malignant_total_prob"), F.col("g_region"), F.col("g_area_pct"), F.col("a_region"), F.col("alignment"),
        F.col("primary_feature"), F.col("clinical_context"), F.col("uncertainty_flags"),
    )
    df = df.withColumn("fallback", text)
    shown = F.col("fallback") if generated is None else tx.validate_narrative(generated, F.col("fallback"))
    return df.withColumn("narrative", shown)


def abcde_points(key: Column) -> dict[str, Column]:
    """Five criteria derived from a numeric key, for cases without a clinician's entry."""
    digit = lambda div, base: (F.floor(key / div) % base).cast("int")
    return {"asymmetry": digit(1, 3), "border": digit(3, 3), "color": digit(9, 3), "diameter": digit(27, 2), "evolution": digit(54, 2)}


def reasoning(narrative: Column, code: Column, conf: Column, rec: Column, grad: Column, attn: Column) -> Column:
    """STR6. Cleaned narrative, or a structured sentence while it is missing or pending, then the
    spatial evidence."""
    clean = tx.sanitise(F.coalesce(narrative, F.lit("")))
    whole = F.floor(conf * 100.0 + 0.5).cast("int")
    level = F.when(whole >= 75, "high").when(whole >= 50, "moderate").otherwise("low")
    plain = F.concat(F.lit("The model favours "), cl.class_label(code), F.lit(" ("), code, F.lit(") at "), whole.cast("string"),
                     F.lit("% "), level, F.lit(" confidence. "), rec)
    usable = (clean != "") & ~F.contains(F.lower(clean), F.lit("pending"))
    lines = F.array(
        F.when(usable, clean).otherwise(plain),
        F.concat(F.lit("Spatial evidence (Grad-CAM++): "), grad), F.concat(F.lit("Spatial evidence (SwinV2): "), attn),
    )
    return F.array_join(F.transform(F.array_compact(lines), lambda x: F.concat(F.lit("  "), x)), "\n\n")


def _sentences() -> tuple[Column, Column]:
    grad = cl.heat_sentence("Grad-CAM++", F.col("g_region").isNotNull(), F.col("g_region"), F.col("g_area_pct"), F.col("g_peak_x"), F.col("g_peak_y"))
    attn = cl.heat_sentence("SwinV2 attention", F.col("a_region").isNotNull(), F.col("a_region"), F.col("a_area_pct"), F.col("a_peak_x"), F.col("a_peak_y"))
    return grad, attn


def with_report(df: DataFrame, abcde: dict[str, Column] | None = None, product: str = "") -> DataFrame:
    """STR6."""
    code, conf = F.col("code"), F.col("conf")
    grad, attn = _sentences()
    df = df.withColumns({
        "urgency": cl.urgency(code, F.col("requires_biopsy")),
        "recommendation": cl.recommendation(code, conf, F.col("requires_biopsy"), F.col("low_confidence"), F.col("differential_diagnosis")),
        "grad_text": grad, "attn_text": attn,
    })
    near = F.transform(
        sc.closest_alternatives(F.col("p"), F.col("cls"), CLASSES), lambda s: F.concat(s["class"], F.lit(" ("), tx.percent(s["probability"]), F.lit(")"))
    )
    df = df.withColumns({
        "reasoning": reasoning(F.col("narrative"), code, conf, F.col("recommendation"), F.col("grad_text"), F.col("attn_text")), "near": near,
    })
    return df.withColumn("report", cl.full_report(
        code, conf, F.col("reasoning"), F.col("grad_text"), F.col("near"), F.col("urgency"), F.col("recommendation"),
        F.col("age"), nz.display_sex(F.col("sex")), nz.display_site(F.col("site")), abcde, product,
    ))


def _top3_struct() -> Column:
    return F.transform(sc.top_k(F.col("p"), 3, CLASSES), lambda s: F.struct(
        s["class"].alias("class"), cl.class_label(s["class"]).alias("full_name"), F.round(s["probability"], 4).alias("probability"),
        s["class"].isin(*MALIGNANT).alias("is_malignant")))


def diagnosis_json(image: Column | None = None) -> Column:
    """JSN1. The diagnosis document, numbers rounded to four places."""
    probs = F.map_from_entries(F.transform(sc.ranked(F.col("p"), CLASSES), lambda s: F.struct(s["class"], F.round(s["probability"], 4))))
    heat = lambda t: F.struct(F.col(f"{t}_region").alias("region"), F.col(f"{t}_area_pct").alias("area_pct"), F.col(f"{t}_zone_family").alias("zone_family"))
    return F.to_json(F.struct(
        F.lit("1.0").alias("version"), (image if image is not None else F.concat(F.lit("case-"), F.col("row_id").cast("string"), F.lit(".png"))).alias("image"),
        F.struct(
            F.col("code").alias("class"), cl.class_label(F.col("code")).alias("class_full"), F.round("conf", 4).alias("confidence"),
            cl.is_malignant(F.col("code")).alias("is_malignant"),
        ).alias("prediction"),
        probs.alias("probabilities"), _top3_struct().alias("top3"),
        F.struct(*[F.col(c) for c in ("malignant_total_prob", "requires_biopsy", "low_confidence", "differential_diagnosis")]).alias("clinical_flags"),
        F.struct(heat("g").alias("gradcam_summary"), heat("a").alias("attention_summary")).alias("explainability"),
        F.struct("age", "sex", "site").alias("metadata_input"),
    ), {"ignoreNullFields": "false"})


def compare_entries(compare: Column, history: Column) -> Column:
    """CSE1. The compare list, or the history mapped to its shape when the list is empty."""
    mapped = F.transform(history, lambda h: F.struct(
        h["id"].alias("id"), h["date"].alias("date"),
        F.when(h["samePatient"], "Previous same-patient review").otherwise("Historical review").alias("label"),
        h["predictedClassCode"].alias("predictedClassCode"), h["predictedClassLabel"].alias("predictedClassLabel"),
        h["confidence"].alias("calibratedConfidence"), h["status"].alias("reviewStatus"), h["note"].alias("summary"),
    ))
    return F.when(F.size(compare) > 0, compare).otherwise(mapped)


def case_records(df: DataFrame, when: Column | None = None, compare_when: Column | None = None) -> DataFrame:
    """CSE1. (row_id, record): the nested case record of each row."""
    code, conf = F.col("code"), F.col("conf")
    label = cl.class_label(code)
    case_id = F.concat(F.lit("CASE-"), F.col("row_id").cast("string"))
    date = F.date_format(when if when is not None else F.lit("2024-01-01").cast("timestamp"), "yyyy-MM-dd")
    complete = cl.metadata_complete(F.col("age"), F.col("sex"), F.col("site"))
    urgent = cl.urgency(code, F.col("requires_biopsy"))
    grad, attn = _sentences()
    scores = F.transform(sc.scores_with_margin(F.col("p"), CLASSES, CLASS_THRESHOLDS, DEFAULT_THRESHOLD), lambda s: F.struct(
        s["classCode"].alias("classCode"), F.try_element_at(nz.literal_map(CLASS_LABELS), s["classCode"]).alias("classLabel"),
        s["probability"].alias("probability"), s["threshold"].alias("threshold"), s["thresholdMargin"].alias("thresholdMargin")))
    df = df.withColumns({"_id": case_id, "_date": date, "_label": label, "_urgent": urgent, "_scores": scores, "_complete": complete})
    history = F.array(F.struct(
        F.concat("_id", F.lit("-current")).alias("id"), F.col("_date").alias("date"), code.alias("predictedClassCode"), F.col("_label").alias("predictedClassLabel"),
        conf.alias("confidence"), F.lit(STATUS).alias("status"), F.col("_urgent").alias("urgency"), F.lit(HISTORY_NOTE).alias("note"), F.lit(True).alias("samePatient"),
    ))
    entry = lambda suffix, name, note: F.struct(
        F.concat("_id", F.lit(suffix)).alias("id"), F.col("_date").alias("date"), F.lit(name).alias("label"), code.alias("predictedClassCode"),
        F.col("_label").alias("predictedClassLabel"), conf.alias("calibratedConfidence"), F.lit(STATUS).alias("reviewStatus"), F.lit(note).alias("summary"))
    compare = F.array(entry("-raw", "Raw input", RAW_NOTE), entry("-inference", "Final inference bundle", BUNDLE_NOTE))
    if compare_when is not None:
        compare = F.when(compare_when, compare).otherwise(F.slice(compare, 1, 0))
    df = df.withColumns({"_history": history, "_compare": compare})
    record = F.struct(
        F.col("_id").alias("id"), F.col("_id").alias("caseId"), F.col("_date").alias("visitDate"), F.lit(STATUS).alias("reviewStatus"),
        F.lit(BANNER).alias("decisionSupportBanner"), code.alias("predictedClassCode"), F.col("_label").alias("predictedClassLabel"),
        conf.alias("calibratedConfidence"), cl.threshold_margin(code, conf).alias("thresholdMargin"),
        cl.recommendation(code, conf, F.col("requires_biopsy"), F.col("low_confidence"), F.col("differential_diagnosis")).alias("recommendation"),
        F.col("_urgent").alias("urgency"),
        F.struct(
            F.coalesce(F.col("age").cast("int"), F.lit(0)).alias("ageYears"), nz.display_sex(F.col("sex")).alias("sex"), nz.display_site(F.col("site")).alias("anatomicalSite"),
            F.when(F.col("_complete"), "Complete").otherwise("Partial").alias("metadataCompleteness"),
        ).alias("metadata"),
        F.col("_scores").alias("predictionScores"),
        F.struct(grad.alias("gradcamSummary"), attn.alias("attentionSummary"), cl.audit_checks(F.col("_complete"), F.lit("Fallback")).alias("auditChecks")).alias("explainability"),
        F.col("_history").alias("historyEntries"), compare_entries(F.col("_compare"), F.col("_history")).alias("compareEntries"),
    )
    return df.select("row_id", record.alias("record"))
