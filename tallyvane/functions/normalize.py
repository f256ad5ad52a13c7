"""Row normalisers: raw metadata spellings to the canonical domains (Column -> Column)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.schema import SITE_ALIASES, SITES

# --- Fixed values: spellings of "not given" and of the run modes --------------
NA_WORDS = ["", "NA", "UNKNOWN"]
MODE_ALIASES = {
    "full": "full", "full hybrid": "full",
    "image_only": "image_only", "image only": "image_only",
    "effnet_only": "effnet_only", "effnet only": "effnet_only",
    "swin_only": "swin_only", "swin only": "swin_only",
}
DISPLAY_MODES = {
    "Full Hybrid": "full", "Image Only": "image_only",
    "EffNet Only": "effnet_only", "Swin Only": "swin_only",
}
# -----------------------------------------------------------------------------


def literal_map(entries: Mapping[str, object]) -> Column:
    """A constant-folded map literal; for dictionaries of a fixed, small size."""
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def try_double(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def norm_site(c: Column) -> Column:
    """PRJ3. Null (or empty) stays null; an unrecognised site becomes 'unknown'."""
    key = F.lower(F.trim(c))
    known = literal_map({**{s: s for s in SITES}, **SITE_ALIASES})
    return F.when(c.isNotNull() & (c != ""), F.coalesce(F.try_element_at(known, key), F.lit("unknown")))


def norm_sex(c: Column) -> Column:
    """PRJ4."""
    key = F.lower(F.trim(c))
    return F.when(key.isin("m", "male"), "male").when(key.isin("f", "female"), "female")


def norm_age(c: Column) -> Column:
    """PRJ5. Years strictly between 0 and 130, else null."""
    v = try_double(c)
    return F.when((v > 0) & (v < 130) & ~F.isnan(v), v)


def norm_fitzpatrick(c: Column) -> Column:
    """PRJ6. Skin type 1..6, truncating a decimal spelling the way an int parse would."""
    v = try_double(c)
    whole = v.cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v) & whole.between(1, 6), whole)


def code_to_class(c: Column, codes: Mapping[str, str]) -> Column:
    """PRJ2. Dictionary lookup; unmapped codes are null and are filtered by the caller."""
    return F.try_element_at(literal_map(codes), c)


def onehot_index(columns: Sequence[Column]) -> Column:
    """PRJ1. Index of the first largest indicator; null when no indicator is set."""
    vec = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    top = F.array_max(vec)
    return F.when(top > 0, F.array_position(vec, top).cast("int") - 1)


def label_at(names: Sequence[str], idx: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), idx)


def parse_flag(c: Column) -> Column:
    """SRC10. A manifest cell as a number: True/False in any case, a number, or blank = 0."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text == "true", 1.0)
        .when(text == "false", 0.0)
        .otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))
    )


def na_to_null(c: Column) -> Column:
    """STR9. Blank, NA and UNKNOWN in any case are missing."""
    return F.when(~F.upper(F.trim(c)).isin(*NA_WORDS), c)


def na_age(c: Column) -> Column:
    return try_double(na_to_null(c))


def na_lower(c: Column) -> Column:
    return F.lower(F.trim(na_to_null(c)))


def scale_age(age: Column, norm: float, missing: Column | None, clip: bool) -> Column:
    """PRJ11. The age variants: clip to [0, norm] or not, divide, fill a missing age."""
    v = age if missing is None else F.coalesce(age, missing)
    if clip:
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(float(norm))))
    return v / F.lit(float(norm))


def median_flag(median: Column) -> Column:
    """PRJ12. 'True' only when the median is above one half."""
    return F.when(median > 0.5, "True").otherwise("False")


def is_synthetic(image: Column) -> Column:
    """PRJ13."""
    return image.startswith("SYNTH_")


def normalize_mode(c: Column) -> Column:
    """STR8. Mode spellings to one name; an unsupported spelling fails the query."""
    key = F.lower(F.trim(F.when(c.isNull() | (c == ""), "full").otherwise(c)))
    key = F.replace(key, F.lit("-"), F.lit("_"))
    found = F.try_element_at(literal_map(MODE_ALIASES), key)
    return F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported inference mode: "), c)).cast("string")
    )


def display_mode(c: Column) -> Column:
    return F.when(c.isin(*DISPLAY_MODES), c).otherwise("Full Hybrid")


def display_mode_code(c: Column) -> Column:
    return F.try_element_at(literal_map(DISPLAY_MODES), display_mode(c))


def display_sex(c: Column) -> Column:
    key = F.lower(F.trim(c))
    return F.when(key == "female", "Female").when(key == "male", "Male").otherwise("Unknown")


def display_site(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", "Unknown").otherwise(text)
