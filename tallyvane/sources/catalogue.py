"""Dataset catalogue, file listings and catalogue verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions.text import extension, stem
from tallyvane.schema import IMAGE_EXTENSIONS


@dataclass(frozen=True)
class Dataset:
    """T1. One catalogue entry; tier 1 essential, 2 high, 3 external validation only."""

    key: str
    tier: int
    expected: int
    image_dir: str
    metadata_files: tuple[str, ...]
    columns: tuple[str, ...]
    licence: str


# --- Fixed values: the catalogue ----------------------------------------------
CATALOGUE = [
    Dataset("isic2019", 1, 33569, "images", (
        "ISIC_2019_Training_GroundTruth.csv", "ISIC_2019_Training_Metadata.csv",
        "ISIC_2019_Test_GroundTruth.csv", "ISIC_2019_Test_Metadata.csv",
    ), ("age_approx", "sex", "anatom_site_general"), "CC BY-NC 4.0"),
    Dataset("ham10000", 1, 10015, "HAM10000_images", ("HAM10000_metadata.csv",),
            ("age", "sex", "localization", "dx_type", "lesion_id"), "CC BY-NC 4.0"),
    Dataset("isic2020", 1, 33126, "train", ("ISIC_2020_Training_GroundTruth.csv",), (
        "patient_id", "lesion_id", "age_approx", "sex", "anatom_site_general_challenge", "diagnosis", "benign_malignant",
    ), "CC BY-NC 4.0"),
    Dataset("pad_ufes_20", 1, 2298, "imgs", ("metadata.csv",), (
        "patient_id", "lesion_id", "age", "gender", "region", "fitspatrick", "diameter_1", "diameter_2",
        "smoke", "drink", "background_father", "background_mother", "pesticide", "has_piped_water",
        "has_sewage_system", "itch", "grew", "hurt", "changed", "bleed", "elevation",
    ), "CC BY 4.0"),
    Dataset("fitzpatrick17k", 1, 16577, "images", ("fitzpatrick17k.csv",), (
        "md5hash", "fitzpatrick_scale", "fitzpatrick_centaur", "label", "nine_partition_label", "three_partition_label",
    ), "Open (research)"),
    Dataset("derm7pt", 2, 2045, "images", ("meta.csv",), (
        "lesion_id", "diagnosis", "pigment_network", "streaks", "pigmentation", "regression_structures",
        "dots_and_globules", "blue_whitish_veil", "vascular_structures",
    ), "Research-only (registration required)"),
    Dataset("ph2", 3, 200, "PH2_Dataset_images", ("PH2_dataset.txt",), (
        "clinical_diagnosis", "asymmetry", "pigment_network", "dots_globules", "streaks", "regression", "blue_whitish_veil",
    ), "Research-only"),
]
# -----------------------------------------------------------------------------

CATALOGUE_SCHEMA = (
    "dataset_key string, tier int, expected long, image_dir string, "
    "metadata_files array<string>, columns array<string>, licence string"
)


def catalogue(spark: SparkSession, entries: Sequence[Dataset] = CATALOGUE) -> DataFrame:
    return spark.createDataFrame(
        [(d.key, d.tier, d.expected, d.image_dir, list(d.metadata_files), list(d.columns), d.licence) for d in entries],
        CATALOGUE_SCHEMA,
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC2. Every file below ``root`` with stem, extension and depth; contents are not read
    unless a later step selects ``content``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", "length", "modificationTime", "content").withColumns(
        {"image_id": stem(F.col("path")), "ext": extension(F.col("path"))}
    )


def images_only(listing: DataFrame, path: str = "path") -> DataFrame:
    """SRC2. Case-insensitive extension filter."""
    return listing.filter(extension(F.col(path)).isin(*IMAGE_EXTENSIONS))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """SRC2 for pixels: the built-in image source, undecodable files dropped."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return raw.select(F.regexp_extract("image.origin", "([^/]*)$", 1).alias("file"), "image")


def count_images(listing: DataFrame, key: str, depth: str) -> DataFrame:
    """SRC3. Images per dataset: the flat files when there are any, else all below."""
    counts = listing.groupBy(key).agg(F.count_if(F.col(depth) == 0).alias("_flat"), F.count("*").alias("_all"))
    return counts.select(key, F.when(F.col("_flat") > 0, F.col("_flat")).otherwise(F.col("_all")).alias("image_count"))


def verify(entries: DataFrame, counts: DataFrame, metadata: DataFrame, only_tier: int | None = None) -> DataFrame:
    """SRC4. Status row per dataset.

    ``counts``: (dataset_key, image_count) for image folders that exist. ``metadata``:
    (dataset_key, file). Present = folder exists, at least half the expected images, and all
    metadata files.
    """
    if only_tier is not None:
        entries = entries.filter(F.col("tier") == only_tier)
    found = metadata.groupBy("dataset_key").agg(F.collect_set("file").alias("_found"))
    rows = entries.join(counts, "dataset_key", "left").join(found, "dataset_key", "left")
    missing = F.array_except("metadata_files", F.coalesce("_found", F.array().cast("array<string>")))
    n, half = F.coalesce("image_count", F.lit(0)), F.col("expected") * 0.5
    issues = F.concat(
        F.transform(F.array_sort(missing), lambda m: F.concat(F.lit("metadata file missing: "), m)),
        F.array_compact(F.array(
            F.when(F.col("image_count").isNull(), F.concat(F.lit("image directory missing: "), F.col("image_dir")))
            .when(n == 0, F.concat(F.lit("image directory empty: "), F.col("image_dir")))
            .when(n < half, F.concat(F.lit("image count low: "), n.cast("string"), F.lit(" found, ~"),
                                     F.col("expected").cast("string"), F.lit(" expected (more than 50% missing)"))),
        )),
    )
    return rows.select(
        "dataset_key", "tier", "expected", n.alias("image_count"), issues.alias("issues"),
        (F.col("image_count").isNotNull() & (n >= half) & (F.size(missing) == 0)).alias("present"),
    )
