"""String, date and JSON expressions of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns and word lists of the narrative checks ------------
DIVIDER = "━" * 49
REPORT_TITLE = "CLINICAL EXPLAINABILITY REPORT"
SANITISE_STEPS = [
    ("\\r\\n", "\n"),
    ("\\s+", " "),
    (DIVIDER, ""),
    ("[A-Z]+ CLINICAL EXPLAINABILITY REPORT", ""),
    ("\\bPREDICTION\\b", ""),
    ("\\bEVIDENCE\\b", ""),
    ("\\bREASONING\\b", ""),
    ("(?i)\\bDiagnosis\\s*:[^.]*", ""),
    ("(?i)\\bConfidence\\s*:[^.]*", ""),
    ("(?i)\\bThreshold\\s*:[^.]*", ""),
]
REQUIRED_TOKENS = [REPORT_TITLE, "PREDICTION", "Diagnosis", "Confidence", "Threshold", "EVIDENCE"]
FORBIDDEN_TOKENS = ["[", "]", "<", ">"]
UNSAFE_PHRASES = ["you should biopsy", "biopsy is required", "no follow-up needed", "definitively benign"]
DATE_PATTERN = "^(\\d{4}-\\d{2}-\\d{2})(?:[T\\s](\\d{1,2}):(\\d{2})(?::(\\d{2}))?)?"
# -----------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def stem(path: Column, strip_suffix: str = "_downsampled") -> Column:
    """STR1. File name without extension and without a trailing marker."""
    base = F.regexp_replace(file_name(path), "\\.[^.]*$", "")
    return F.regexp_replace(base, f"{strip_suffix}$", "") if strip_suffix else base


def extension(path: Column, default: str = "") -> Column:
    """STR1. Lower-case extension without the dot."""
    ext = F.lower(F.regexp_extract(file_name(path), "\\.([^.]+)$", 1))
    return F.when(ext == "", default).otherwise(ext)


def feature_title(name: Column) -> Column:
    """STR2. site_head/neck -> Site: Head/Neck; every letter run starts upper case."""
    spaced = F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("site "), F.lit("Site: "))
    # initcap splits on blanks only, so a mark after each other separator is opened and closed
    opened = F.regexp_replace(spaced, "([^A-Za-z ])([A-Za-z])", "$1 \u0001$2")
    marked = F.regexp_replace(F.lower(opened), " \u0001", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def sanitise(text: Column) -> Column:
    """STR3. Strip report furniture from a generated narrative."""
    for pattern, repl in SANITISE_STEPS:
        text = F.regexp_replace(text, pattern, repl)
    return F.trim(text)


def narrative_problems(text: Column) -> Column:
    """STR4. Names of the checks a narrative fails; an empty array means usable."""
    body = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(body)
    has = lambda words, c: _any([F.contains(c, F.lit(w)) for w in words])
    return F.array_compact(F.array(
        F.when(body == "", "empty"),
        F.when(~_all([F.contains(body, F.lit(w)) for w in REQUIRED_TOKENS]), "missing_token"),
        F.when(has(FORBIDDEN_TOKENS, body), "forbidden_character"),
        F.when(has(UNSAFE_PHRASES, low), "unsafe_phrase"),
    ))


def validate_narrative(text: Column, fallback: Column) -> Column:
    """STR4. The trimmed narrative when it passes every check, else the fallback."""
    return F.when(F.size(narrative_problems(text)) == 0, F.trim(text)).otherwise(fallback)


def _any(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def fixed(v: Column, digits: int) -> Column:
    """STR7. A number with a fixed count of decimals and no grouping marks."""
    return F.format_string(f"%.{digits}f", F.round(v, digits))


def percent(v: Column, digits: int = 1) -> Column:
    """STR7."""
    return F.concat(fixed(v * 100.0, digits), F.lit("%"))


def signed(v: Column, digits: int = 3) -> Column:
    """STR7. Explicit sign on values that are not negative."""
    return F.concat(F.when(v >= 0, "+").otherwise(""), fixed(v, digits))


def parse_date(text: Column) -> Column:
    """DAT1. Date with optional T or blank, time and seconds; anything else is null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, DATE_PATTERN, i)
    clock = lambda i: F.when(part(i) == "", "0").otherwise(part(i))
    stamp = F.concat_ws(" ", part(1), F.concat_ws(":", clock(2), clock(3), clock(4)))
    return F.when(part(1) != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd H:m:s")))


def json_fingerprint(fields: dict[str, Column]) -> Column:
    """JSN2. sha1 of the JSON with its keys in sorted order."""
    return F.sha1(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens of the whole text."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda t: t != "")
