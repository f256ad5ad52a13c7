"""Conditional report columns: levels, flags, tiers, hints and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.normalize import literal_map
from tallyvane.functions.scores import fold_sum
from tallyvane.functions.text import DIVIDER, REPORT_TITLE, fixed, percent
from tallyvane.schema import (
    CLASS_LABELS,
    CLASS_THRESHOLDS,
    CLASSES,
    DEFAULT_THRESHOLD,
    MALIGNANT,
)

# --- Fixed values: cut-offs and sentences of the reports ----------------------
LEVELS = [(0.75, "high"), (0.5, "moderate")]
REVIEW_AT = 0.5
DIFFERENTIAL_BELOW = 0.7
BORDERLINE_WITHIN = 0.08
CENTRAL = (0.34, 0.66)
SUN_SITES = ["head/neck", "upper extremity"]
PRIORITY = {
    "High concern": "HIGH — requires immediate dermatologist review",
    "Expedited review": "ELEVATED — prioritize clinician review",
}
PRIORITY_DEFAULT = "ROUTINE — clinician review still required"
REC_REVIEW = ("Prioritize dermatologist review for ", "; biopsy consideration requires clinician confirmation.")
REC_DIFFERENTIAL = "Review the differential diagnosis and image evidence before final disposition."
REC_ROUTINE = ("Routine dermatologist review; model confidence is ", "% with calibrated threshold support.")
CONTEXT_NONE = "metadata non-contributory"
CONTEXT_SUN = "sun-exposed site increases suspicion"
CONTEXT_TORSO = "torso site in young female slightly lowers concern"
ABCDE_TIERS = ["High Concern — Biopsy Recommended", "Moderate Concern — Short-term Follow-up", "Low Concern — Routine Surveillance"]
ABCDE_REPORT_TIERS = ["High Concern (Biopsy Indicated)", "Moderate Concern (Close Follow-Up)", "Low Concern (Routine)"]
ABCDE_MODAL_TIERS = ["High Concern — Urgent Biopsy Indicated", "Moderate Concern — Short-Term Monitoring", "Low Concern — Routine Surveillance"]
ABCDE_LABELS = {
    "asymmetry": ["Symmetric", "1-Axis Asymmetric", "2-Axis Asymmetric"],
    "border": ["Regular", "Mild notching", "Marked jaggedness"],
    "color": ["Uniform", "Dual shade", "Variegated 3+ shades"],
    "diameter": ["< 6 mm", "≥ 6 mm"],
    "evolution": ["Static", "Evolving / Symptomatic"],
}
ABCDE_LINES = {
    "asymmetry": ("A — Asymmetry", "pts"),
    "border": ("B — Border   ", "pts"),
    "color": ("C — Color    ", "pts"),
    "diameter": ("D — Diameter ", "pt"),
    "evolution": ("E — Evolution", "pt"),
}
AUDIT_NOTES = {
    "preprocess": ("Preprocessing trace", "Raw, DullRazor, normalization, CLAHE, and final model input artifacts were generated."),
    "metadata": ("Hybrid metadata", "Age, sex, and anatomical site are required for full hybrid inference."),
    "explainability": ("Visual explanations", "Grad-CAM and attention artifacts are included when the active image branches support them."),
    "slm": ("Clinical narrative generator", "Clinical explainability report produced with decision support and evidence breakdown."),
}
VERIFY_WITH_FLAGS = (
    "Clinician should verify with direct dermoscopic examination of structural features "
    "(pigment network, vascular patterns, symmetry) that the model cannot reliably assess."
)
VERIFY_NO_FLAGS = (
    "No specific uncertainty flags were raised, but clinician verification remains required — "
    "the model does not assess dermoscopic structures such as pigment network regularity, "
    "vascular patterns, or ulceration directly."
)
# -----------------------------------------------------------------------------


def confidence_level(conf: Column) -> Column:
    """CND1."""
    return F.when(conf >= LEVELS[0][0], LEVELS[0][1]).when(conf >= LEVELS[1][0], LEVELS[1][1]).otherwise("low")


def class_threshold(code: Column) -> Column:
    """CND2."""
    return F.coalesce(F.try_element_at(literal_map(CLASS_THRESHOLDS), code), F.lit(DEFAULT_THRESHOLD))


def threshold_margin(code: Column, conf: Column) -> Column:
    return conf - class_threshold(code)


def class_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CLASS_LABELS), code), code)


def is_malignant(code: Column, members: list[str] = MALIGNANT) -> Column:
    """The malignant set differs between consumers, so it is always a parameter."""
    return code.isin(*members)


def malignant_total(p: Column, members: list[str] = MALIGNANT) -> Column:
    return fold_sum([p[CLASSES.index(c)] for c in members])


def clinical_flags(code: Column, conf: Column, p: Column, members: list[str] = MALIGNANT) -> dict[str, Column]:
    """CND3."""
    return {
        "malignant_total_prob": F.round(malignant_total(p, members), 4),
        "requires_biopsy": is_malignant(code, members) & (conf >= REVIEW_AT),
        "low_confidence": conf < REVIEW_AT,
        "differential_diagnosis": conf < DIFFERENTIAL_BELOW,
    }


def urgency(code: Column, requires_biopsy: Column) -> Column:
    """CND4."""
    return (
        F.when(code.isin("MEL", "SCC") | requires_biopsy, "High concern")
        .when(code.isin("BCC", "AK"), "Expedited review")
        .otherwise("Routine")
    )


def recommendation(code: Column, conf: Column, requires_biopsy: Column, low: Column, differential: Column) -> Column:
    """CND4."""
    return (
        F.when(requires_biopsy, F.concat(F.lit(REC_REVIEW[0]), class_label(code), F.lit(REC_REVIEW[1])))
        .when(low | differential, REC_DIFFERENTIAL)
        .otherwise(F.concat(F.lit(REC_ROUTINE[0]), F.bround(conf * 100.0).cast("int").cast("string"), F.lit(REC_ROUTINE[1])))
    )


def priority_label(urgency_col: Column) -> Column:
    """CND4."""
    return F.coalesce(F.try_element_at(literal_map(PRIORITY), urgency_col), F.lit(PRIORITY_DEFAULT))


def region(x: Column, y: Column) -> Column:
    """CND6. Named region of a point given in 0..1 coordinates."""
    lo, hi = CENTRAL
    vertical = F.when(y < lo, "upper").when(y > hi, "lower").otherwise("mid")
    horizontal = F.when(x < lo, "left").when(x > hi, "right").otherwise("central")
    return (
        F.when(x.between(lo, hi) & y.between(lo, hi), "central lesion body")
        .when(vertical == "mid", F.concat(horizontal, F.lit(" peripheral lesion border")))
        .when(horizontal == "central", F.concat(vertical, F.lit(" lesion border")))
        .otherwise(F.concat(vertical, F.lit("-"), horizontal, F.lit(" lesion border")))
    )


def zone_family(reg: Column) -> Column:
    """CND6."""
    has = lambda w: F.contains(reg, F.lit(w))
    chain = F.when(reg.isNull() | (reg == ""), F.lit(None).cast("string")).when(has("central") | has("body"), "central")
    for word in ("upper", "lower", "left", "right"):
        chain = chain.when(has(word), word)
    return chain.when(has("border") | has("peripheral"), "peripheral").otherwise("non_specific")


def evidence_alignment(zone_a: Column, zone_b: Column) -> Column:
    """CND5. A missing zone counts as partial agreement."""
    both = zone_a.isNotNull() & zone_b.isNotNull()
    loose = zone_a.isin("central", "peripheral") | zone_b.isin("central", "peripheral")
    return (
        F.when(both & (zone_a == zone_b), "aligned")
        .when(both & ~loose, "discordant")
        .otherwise("partially_aligned")
    )


def primary_feature(code: Column, reg: Column, evidence_available: Column) -> Column:
    """CND7."""
    has = lambda w: F.coalesce(F.contains(reg, F.lit(w)), F.lit(False))
    return (
        F.when((code == "VASC") & evidence_available, "vascular emphasis")
        .when(has("border"), "border irregularity")
        .when(has("central") & code.isin("BCC", "SCC"), "central nodule")
        .when(has("central"), "lesion body")
        .otherwise("non-specific localisation")
    )


def secondary_features(primary: Column, alignment: Column) -> Column:
    """CND7. Sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(primary == "border irregularity", "asymmetry"),
        F.when(alignment == "aligned", "convergent image attribution")
        .when(alignment == "discordant", "discordant image attribution"),
    ))))


def clinical_context(code: Column, age: Column, sex: Column, site: Column, members: list[str] = MALIGNANT) -> Column:
    """CND7."""
    place = F.lower(F.coalesce(site, F.lit("")))
    return (
        F.when(place.isin(*SUN_SITES) & is_malignant(code, members), CONTEXT_SUN)
        .when((age < 35) & (F.lower(sex) == "female") & F.contains(place, F.lit("torso")), CONTEXT_TORSO)
        .otherwise(CONTEXT_NONE)
    )


def uncertainty_flags(code: Column, conf: Column, alignment: Column) -> Column:
    """CND7. In fixed order: low confidence, discordance, close to the class threshold."""
    return F.array_compact(F.array(
        F.when(conf < REVIEW_AT, "low_confidence"),
        F.when(alignment == "discordant", "discordant_attention"),
        F.when(F.abs(threshold_margin(code, conf)) <= BORDERLINE_WITHIN, "borderline_threshold"),
    ))


def abcde_score(points: dict[str, Column]) -> Column:
    """CND8. Sum of the five criteria, 0 to 8."""
    return fold_sum([points[k] for k in ABCDE_LABELS]).cast("int")


def abcde_composite(score: Column, mel_prob: Column) -> Column:
    """CND8. Tier from the score together with the melanoma probability."""
    return (
        F.when((score >= 5) | ((score >= 4) & (mel_prob >= 0.25)) | (mel_prob >= 0.5), ABCDE_TIERS[0])
        .when((score >= 3) | (mel_prob >= 0.15), ABCDE_TIERS[1])
        .otherwise(ABCDE_TIERS[2])
    )


def abcde_tier(score: Column, tiers: list[str]) -> Column:
    return F.when(score >= 5, tiers[0]).when(score >= 3, tiers[1]).otherwise(tiers[2])


def metadata_complete(age: Column, sex: Column, site: Column) -> Column:
    """CND9. All three inputs given and recognised."""
    return (
        age.isNotNull()
        & F.coalesce(F.lower(F.trim(sex)).isin("female", "male"), F.lit(False))
        & (F.trim(F.coalesce(site, F.lit(""))) != "")
    )


def audit_checks(complete: Column, narrative_status: Column) -> Column:
    """CND9. The checklist as an array of structs."""
    status = {
        "preprocess": F.lit("pass"),
        "metadata": F.when(complete, "pass").otherwise("warning"),
        "explainability": F.lit("pass"),
        "slm": F.when(narrative_status.startswith("Generated"), "pass").otherwise("review-needed"),
    }
    return F.array(*[
        F.struct(
            F.lit(k).alias("id"), F.lit(label).alias("label"),
            status[k].alias("status"), F.lit(note).alias("note"),
        )
        for k, (label, note) in AUDIT_NOTES.items()
    ])


def heat_sentence(branch: str, available: Column, reg: Column, area: Column, peak_x: Column, peak_y: Column) -> Column:
    """STR10."""
    text = F.concat(
        F.lit(f"{branch} concentrates on the "), F.coalesce(reg, F.lit("lesion region")),
        F.when(area.isNotNull(), F.concat(F.lit(", activating "), fixed(area, 1), F.lit("% of the image area"))).otherwise(""),
        F.when(
            peak_x.isNotNull(),
            F.concat(F.lit(" (peak at pixel "), peak_x.cast("string"), F.lit(", "), peak_y.cast("string"), F.lit(")")),
        ).otherwise(""),
        F.lit("."),
    )
    return F.when(F.coalesce(available, F.lit(False)), text).otherwise(f"{branch} was not generated for this inference mode.")


def fallback_report(
    code: Column, conf: Column, alternative: Column, alt_prob: Column, malignant: Column,
    malignant_prob: Column, grad_region: Column, grad_area: Column, attn_region: Column,
    alignment: Column, primary: Column, context: Column, flags: Column, product: str = "",
) -> Column:
    """STR5. Deterministic narrative used when a generated one is missing or unusable."""
    label, pct1 = class_label(code), F.round(conf * 100.0, 1)
    with_grad, with_attn = grad_region.isNotNull(), attn_region.isNotNull()
    spatial = F.concat(
        F.lit("The model favours "), label, F.lit(" because "),
        F.when(with_grad, F.concat(
            F.lit("Grad-CAM++ activation concentrates on the "), grad_region,
            F.when(grad_area > 0, F.concat(F.lit(" ("), fixed(grad_area, 1), F.lit("% coverage)"))).otherwise(""),
            F.lit(", suggesting the key discriminative signal is "), primary, F.lit("."),
        )).otherwise(F.concat(
            F.lit("the calibrated probability of "), fixed(pct1, 1),
            F.lit("% exceeds the class threshold, though spatial evidence was not generated for this mode."),
        )),
    )
    branches = F.when(with_grad & with_attn, F.when(alignment == "aligned", F.concat(
        F.lit("Both EfficientNet (Grad-CAM++) and SwinV2 (attention) branches converge on the "), grad_region,
        F.lit(", providing corroborative spatial support for the predicted class."),
    )).when(alignment == "discordant", F.concat(
        F.lit("The EfficientNet branch highlights the "), grad_region,
        F.lit(" while SwinV2 attention peaks at the "), attn_region,
        F.lit(" — this discordance reduces diagnostic certainty and warrants closer dermoscopic inspection."),
    )).otherwise(F.concat(
        F.lit("The two branches show partial overlap: Grad-CAM++ peaks at the "), grad_region,
        F.lit(" and SwinV2 at the "), attn_region, F.lit("; the evidence is not fully convergent."),
    )))
    alt_pct = F.round(alt_prob * 100.0, 1)
    margin = pct1 - alt_pct
    nearest = F.when(alternative.isNotNull(), F.when(margin < 15, F.concat(
        F.lit("The closest differential is "), class_label(alternative), F.lit(" at "), fixed(alt_pct, 1),
        F.lit("% — only "), fixed(margin, 1),
        F.lit(" pts below the primary prediction. This narrow separation means clinical correlation is especially important."),
    )).otherwise(F.concat(
        F.lit("The nearest alternative, "), class_label(alternative), F.lit(" ("), fixed(alt_pct, 1),
        F.lit("%), trails by "), fixed(margin, 1),
        F.lit(" pts, providing reasonable separation from the primary prediction."),
    )))
    informative = context != CONTEXT_NONE
    danger = F.when(malignant, F.concat(
        F.lit("The lesion classifies as malignant"),
        F.when(malignant_prob > 0, F.concat(F.lit(" with a combined malignant probability of "), percent(malignant_prob))).otherwise(""),
        F.lit("."),
        F.when(informative, F.concat(F.lit(" Metadata context: "), context, F.lit("."))).otherwise(""),
    )).when(informative, F.concat(F.lit("Clinical context: "), context, F.lit(".")))
    verify = F.when(F.size(flags) > 0, F.concat(
        F.lit("Uncertainty flags raised: "), F.replace(F.array_join(flags, ", "), F.lit("_"), F.lit(" ")),
        F.lit(". " + VERIFY_WITH_FLAGS),
    )).otherwise(VERIFY_NO_FLAGS)
    title = f"{product} {REPORT_TITLE}".strip()
    return F.concat(
        F.lit(f"{DIVIDER}\n{title}\n{DIVIDER}\n\nPREDICTION\n  Diagnosis   : "), label, F.lit(" ("), code,
        F.lit(")\n  Confidence  : "), fixed(pct1, 1), F.lit("% ("), confidence_level(conf),
        F.lit(" confidence)\n  Threshold   : "), fixed(class_threshold(code), 2),
        F.lit(" (tuned — default 0.50)\n\nEVIDENCE\n  "),
        F.concat_ws(" ", spatial, branches, nearest, danger, verify),
    )


def abcde_section(points: dict[str, Column]) -> Column:
    total = abcde_score(points)
    parts: list[Column] = [F.lit("\nABCDE CLINICAL ASSESSMENT\n")]
    for name, (head, unit) in ABCDE_LINES.items():
        labels = ABCDE_LABELS[name]
        words = F.lit(labels[-1])
        for i in reversed(range(len(labels) - 1)):
            words = F.when(points[name] == i, labels[i]).otherwise(words)
        parts += [F.lit(f"  {head} : +"), points[name].cast("string"), F.lit(f" {unit} ("), words, F.lit(")\n")]
    parts += [F.lit("  Total Score   : "), total.cast("string"), F.lit(" / 8 points ["),
              abcde_tier(total, ABCDE_REPORT_TIERS), F.lit("]\n")]
    return F.concat(*parts)


def full_report(
    code: Column, conf: Column, reasoning: Column, grad_text: Column, alternatives: Column,
    urgency_col: Column, rec: Column, age: Column, sex: Column, site: Column,
    abcde: dict[str, Column] | None = None, product: str = "",
) -> Column:
    """STR6. The printable report; ``alternatives`` is an array of 'CODE (p%)' strings."""
    near = (
        F.when(F.size(alternatives) == 0, "No close alternate class probabilities were returned.")
        .otherwise(F.array_join(alternatives, " and "))
    )
    title = f"{product} {REPORT_TITLE}".strip()
    return F.concat(
        F.lit(f"{DIVIDER}\n{title}\n{DIVIDER}\n\nPREDICTION\n  Diagnosis   : "), class_label(code),
        F.lit(" ("), code, F.lit(")\n  Confidence  : "), percent(conf), F.lit(" ("), confidence_level(conf),
        F.lit(" confidence)\n  Threshold   : "), fixed(class_threshold(code), 2), F.lit(" (tuned — default 0.50)\n"),
        abcde_section(abcde) if abcde else F.lit(""),
        F.lit("\nREASONING\n"), reasoning,
        F.lit("\n\nFLAGGED REGION\n  ⚑ Location  : Model-highlighted lesion evidence region\n  ⚑ Feature   : "), grad_text,
        F.lit("\n  ⚑ Area      : See Grad-CAM and attention artifacts for spatial coverage\n"
              "  ⚑ Pixel     : See diagnosis.json for peak activation if generated\n\n"
              "DIFFERENTIAL DIAGNOSIS\n  Closest alternatives: "), near,
        F.lit("\n  (Consider these if clinical presentation is ambiguous)\n\nURGENCY & ACTION\n  Priority  : "),
        priority_label(urgency_col), F.lit("\n  Recommend : "), rec,
        F.lit("\n\nMETADATA\n  Age       : "), F.when(age > 0, age.cast("int").cast("string")).otherwise("Unknown"),
        F.lit("\n  Sex       : "), sex, F.lit("\n  Site      : "), site,
        F.lit(f"\n\n{DIVIDER}\nDISCLAIMER: AI decision-support tool only.\n"
              f"Final diagnosis must be made by a qualified clinician.\n{DIVIDER}"),
    )
