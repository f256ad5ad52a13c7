"""Canonical schema and the fixed domains every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: domains of the canonical row -----------------------------
CLASSES = ["MEL", "NV", "BCC", "AK", "BKL", "DF", "VASC", "SCC"]
CLASS_LABELS = {
    "MEL": "Melanoma",
    "NV": "Melanocytic Nevus",
    "BCC": "Basal Cell Carcinoma",
    "AK": "Actinic Keratosis",
    "BKL": "Benign Keratosis",
    "DF": "Dermatofibroma",
    "VASC": "Vascular Lesion",
    "SCC": "Squamous Cell Carcinoma",
}
CLASS_THRESHOLDS = {
    "MEL": 0.57, "NV": 0.48, "BCC": 0.42, "BKL": 0.39,
    "AK": 0.31, "SCC": 0.35, "VASC": 0.22, "DF": 0.24,
}
DEFAULT_THRESHOLD = 0.5
MALIGNANT = ["MEL", "BCC", "AK", "SCC"]
MALIGNANT_REPORT = ["MEL", "BCC", "SCC"]
CLINICAL_WEIGHTS = [2.5, 0.5, 1.0, 1.5, 1.0, 0.8, 0.8, 3.0]
SITES = [
    "anterior torso", "head/neck", "lateral torso", "lower extremity", "oral/genital",
    "palms/soles", "posterior torso", "upper extremity", "unknown",
]
SITE_ALIASES = {
    "torso": "anterior torso", "trunk": "anterior torso", "face": "head/neck",
    "neck": "head/neck", "scalp": "head/neck", "ear": "head/neck",
    "extremity": "upper extremity", "arm": "upper extremity", "leg": "lower extremity",
    "foot": "palms/soles", "hand": "palms/soles", "back": "posterior torso",
    "chest": "anterior torso", "abdomen": "anterior torso",
}
SEXES = ["female", "male", "unknown"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]
# -----------------------------------------------------------------------------

META_FEATURES = (
    ["age_norm"]
    + [f"sex_{s}" for s in SEXES]
    + [f"site_{s}" for s in SITES]
    + [f"fitz_{i}" for i in range(1, 7)]
)
META_GROUPS = {
    "age": [0],
    "sex": [1, 2, 3],
    "site": list(range(4, 13)),
    "fitz": list(range(13, 19)),
}
# The 13-feature manifest: same names without skin type, addressed by name only.
MANIFEST_FEATURES = ["age_approx"] + [f"sex_{s}" for s in SEXES] + [f"site_{s}" for s in SITES]

CANONICAL = T.StructType([
    T.StructField("dataset_key", T.StringType(), False),
    T.StructField("image_id", T.StringType(), False),
    T.StructField("src_image_path", T.StringType(), False),
    T.StructField("class_name", T.StringType(), False),
    T.StructField("class_idx", T.IntegerType(), False),
    T.StructField("lesion_id", T.StringType(), False),
    T.StructField("patient_id", T.StringType(), True),
    T.StructField("age", T.DoubleType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("site", T.StringType(), True),
    T.StructField("fitzpatrick", T.IntegerType(), True),
])
REQUIRED_SPLIT_COLUMNS = ["image_id", "src_image_path", "class_name", "class_idx", "lesion_id"]

QUALITY = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("sharpness", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
    T.StructField("saturation", T.DoubleType()),
    T.StructField("r_mean", T.DoubleType()),
    T.StructField("g_mean", T.DoubleType()),
    T.StructField("b_mean", T.DoubleType()),
])

RECORD_JOB = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("failed_stage", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.DoubleType()),
    T.StructField("output", T.BinaryType()),
])


def class_index(name: str) -> int:
    return CLASSES.index(name)
