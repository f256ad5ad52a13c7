"""Source adapters: heterogeneous label and metadata tables to the canonical row.

An adapter is a description, not code: where each canonical field comes from and how the label
is given. ``adapt`` turns any table into canonical rows lazily; ``load`` reads the files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.functions import normalize as nz
from tallyvane.functions.text import stem
from tallyvane.operators.dedup import union_all
from tallyvane.operators.joins import attach_metadata, existing, known_label
from tallyvane.schema import CANONICAL, CLASSES
from tallyvane.storage import path_exists

# --- Fixed values: diagnosis codes of the three coded sources -------------------
HAM_CODES = {"mel": "MEL", "nv": "NV", "bcc": "BCC", "akiec": "AK", "bkl": "BKL", "df": "DF", "vasc": "VASC"}
ISIC20_CODES = {
    "melanoma": "MEL", "nevus": "NV", "seborrheic keratosis": "BKL", "lentigo": "BKL",
    "lichenoid keratosis": "BKL", "solar lentigo": "BKL", "cafe-au-lait macule": "BKL",
    "atypical melanocytic proliferation": "MEL",
}
PAD_CODES = {"MEL": "MEL", "NEV": "NV", "BCC": "BCC", "ACK": "AK", "SEK": "BKL", "SCC": "SCC"}
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Adapter:
    """How one source maps to the canonical row. Column names are the source's own."""

    key: str
    image: str
    files: tuple[tuple[str, ...], ...]
    label: str | None = None                      # coded diagnosis column; None = one-hot classes
    codes: Mapping[str, str] = field(default_factory=dict)
    clean: Callable[[Column], Column] = F.lower
    lesion: str = "lesion_id"
    patient: str | None = None
    age: str = "age"
    sex: str = "sex"
    site: str = "site"
    fitzpatrick: str | None = None
    image_is_path: bool = False


ADAPTERS = {
    a.key: a for a in (
        Adapter("isic2019", "image", (
            ("ISIC_2019_Training_GroundTruth.csv", "ISIC_2019_Training_Metadata.csv"),
            ("ISIC_2019_Test_GroundTruth.csv", "ISIC_2019_Test_Metadata.csv"),
        ), age="age_approx", site="anatom_site_general"),
        Adapter("ham10000", "image_id", (("HAM10000_metadata.csv",),), "dx", HAM_CODES, F.lower, site="localization"),
        Adapter("isic2020", "image_name", (("ISIC_2020_Training_GroundTruth.csv",),), "diagnosis", ISIC20_CODES,
                lambda c: F.lower(F.trim(c)), patient="patient_id", age="age_approx", site="anatom_site_general_challenge"),
        Adapter("pad_ufes_20", "img_id", (("metadata.csv",),), "diagnostic", PAD_CODES, F.upper, patient="patient_id",
                sex="gender", site="region", fitzpatrick="fitspatrick", image_is_path=True),
    )
}

QUARANTINE_NO_LABEL = "no_label"


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """SRC1. CSV with a header and an explicit schema; a malformed line is kept in ``_corrupt_record``."""
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])
    schema = schema.add("_corrupt_record", T.StringType())
    return (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", False)
        .csv(path if isinstance(path, str) else list(path))
    )


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 for sources whose column set varies: the header names the columns, all text, no inference."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _col(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`") if name and name in df.columns else F.lit(None).cast("string")


def labelled(df: DataFrame, adapter: Adapter) -> DataFrame:
    """PRJ1/PRJ2. Adds class_name; null where the source gives no usable label."""
    if adapter.label is None:
        if "UNK" in df.columns:
            df = known_label(df.withColumn("UNK", F.col("UNK").cast("double")))
        idx = nz.onehot_index([F.col(c).cast("double") for c in CLASSES])
        return df.withColumn("class_name", nz.label_at(CLASSES, idx))
    return df.withColumn("class_name", nz.code_to_class(adapter.clean(_col(df, adapter.label)), adapter.codes))


def adapt(df: DataFrame, adapter: Adapter, image_root: str = "") -> DataFrame:
    """SRC5-SRC8. Canonical rows of one source.

    Lesion falls back to the image id; a missing patient stays null.
    """
    image = stem(_col(df, adapter.image), "") if adapter.image_is_path else _col(df, adapter.image).cast("string")
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    rows = labelled(df, adapter).filter(F.col("class_name").isNotNull())
    out = rows.select(
        F.lit(adapter.key).alias("dataset_key"), image.alias("image_id"),
        F.concat(F.lit(f"{image_root}/{adapter.key}/images/"), image, F.lit(".jpg")).alias("src_image_path"),
        F.col("class_name"),
        (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class_name")) - 1).cast("int").alias("class_idx"),
        F.coalesce(filled(_col(rows, adapter.lesion)), image).alias("lesion_id"),
        filled(_col(rows, adapter.patient)).alias("patient_id"),
        nz.norm_age(_col(rows, adapter.age)).alias("age"), nz.norm_sex(_col(rows, adapter.sex).cast("string")).alias("sex"),
        nz.norm_site(_col(rows, adapter.site).cast("string")).alias("site"),
        nz.norm_fitzpatrick(_col(rows, adapter.fitzpatrick)).alias("fitzpatrick"),
    )
    return out.select(*[f.name for f in CANONICAL.fields])


def quarantined(df: DataFrame, adapter: Adapter) -> DataFrame:
    """Rows without a usable label, with the reason; they never reach a split."""
    return labelled(df, adapter).filter(F.col("class_name").isNull()).select(
        _col(df, adapter.image).cast("string").alias("image_id"), F.lit(QUARANTINE_NO_LABEL).alias("reason")
    )


def skipped_groups(spark: SparkSession, adapter: Adapter, raw_root: str) -> list[str]:
    """File groups of a source of which a file is missing; none of their rows are read."""
    return [" + ".join(group) for group in adapter.files if not all(path_exists(spark, f"{raw_root}/{adapter.key}/{name}") for name in group)]


def read_source(spark: SparkSession, adapter: Adapter, raw_root: str) -> DataFrame:
    """SRC5-SRC8. The source's own table: (labels ⟕ metadata) pairs unioned, a missing pair skipped."""
    parts, skipped = [], skipped_groups(spark, adapter, raw_root)
    for group in adapter.files:
        if " + ".join(group) in skipped:
            continue
        paths = [f"{raw_root}/{adapter.key}/{name}" for name in group]
        tables = [read_csv_text(spark, p) for p in paths]
        parts.append(tables[0] if len(tables) == 1 else attach_metadata(tables[0], tables[1], adapter.image))
    if not parts:
        raise FileNotFoundError(f"no files for {adapter.key} under {raw_root}")
    return union_all(parts)


def load_all(
    spark: SparkSession, keys: Sequence[str], raw_root: str, image_root: str = "", listing: DataFrame | None = None,
    adapters: Mapping[str, Adapter] = ADAPTERS,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """SRC9. Union over the requested datasets with a status per key; unknown or failed ones are skipped.

    The status of a loaded dataset names the file groups that were left out because a file is missing.
    """
    frames, status = [], []
    for key in keys:
        if key not in adapters:
            status.append((key, "no adapter"))
            continue
        try:
            rows = adapt(read_source(spark, adapters[key], raw_root), adapters[key], image_root)
            frames.append(existing(rows, listing, "src_image_path") if listing is not None else rows)
            skipped = skipped_groups(spark, adapters[key], raw_root)
            status.append((key, f"loaded without {', '.join(skipped)}" if skipped else "loaded"))
        except FileNotFoundError as e:
            status.append((key, str(e)))
    if not frames:
        raise RuntimeError("no rows loaded")
    return union_all(frames), status


def read_manifest(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """SRC10. Manifest CSV whose feature cells may be True/False, numbers or blank; absent features are 0."""
    raw = read_csv_text(spark, path)
    return parse_manifest(raw, features)


def parse_manifest(raw: DataFrame, features: Sequence[str]) -> DataFrame:
    other = [c for c in raw.columns if c not in features]
    cells = [nz.parse_flag(F.col(f"`{f}`")).alias(f) if f in raw.columns else F.lit(0.0).alias(f) for f in features]
    return raw.select(*[F.col(f"`{c}`") for c in other], *cells)
