"""Gates, image statistics, record jobs, distance, sources, sinks and streams."""

import os
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import quality as qg
from tallyvane.sources import adapters as ad, catalogue as cg, sinks as sk
from tallyvane.storage import scratch_path, spread
from tallyvane.streaming import intake as st


def bmp(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    row = (w * 3 + 3) // 4 * 4
    body = b"".join(px[y].tobytes().ljust(row, b"\0") for y in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_image_statistics_and_corrupt_file(spark, tmp_path):
    flat = np.full((4, 4, 3), 100, dtype=np.uint8)
    red = np.zeros((4, 4, 3), dtype=np.uint8)
    red[..., 2] = 200
    (tmp_path / "flat.bmp").write_bytes(bmp(flat))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "red.bmp").write_bytes(bmp(red))
    (tmp_path / "bad.bmp").write_bytes(b"BMnothing")
    got = {r.file: r for r in qg.folder_stats(cg.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == {"flat.bmp", "red.bmp"}
    assert (got["flat.bmp"].sharpness, got["flat.bmp"].brightness, got["flat.bmp"].saturation) == (0.0, 100.0, 0.0)
    assert (got["red.bmp"].r_mean, got["red.bmp"].b_mean, got["red.bmp"].saturation) == (200.0, 0.0, 255.0)
    listing = cg.images_only(cg.list_files(spark, str(tmp_path)))
    assert sorted(r.image_id for r in listing.select("image_id").collect()) == ["bad", "flat", "red"]


def test_stage_job_never_raises(spark):
    def boom(b):
        if b.startswith(b"x"):
            raise RuntimeError("first\nsecond")
        return b + b"!"
    df = spark.createDataFrame([("1", b"ab"), ("2", b"xy")], "id string, content binary")
    got = {r.id: r for r in qg.run_stages(df, [("one", bytes.upper), ("two", lambda b: boom(b.lower()))]).collect()}
    assert got["1"].ok and got["1"].output == b"ab!" and len(got["1"].output_sha1) == 40
    assert not got["2"].ok and got["2"].failed_stage == "two" and got["2"].output is None
    lines = sk.quarantine_lines(qg.run_stages(df, [("two", boom)])).collect()
    assert [(r.id, r.error) for r in lines] == [("2", "RuntimeError: first")]


def test_frechet_distance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (60, 4)), rng.normal(0.5, 1.4, (50, 4))
    rows = [("a", [float(v) for v in x]) for x in a] + [("b", [float(v) for v in x]) for x in b]
    df = spark.createDataFrame(rows, "side string, f array<double>").repartition(5)
    values = np.linalg.eigvals(np.cov(a, rowvar=False) @ np.cov(b, rowvar=False))
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a, rowvar=False) + np.cov(b, rowvar=False)) - 2 * np.sqrt(np.clip(values.real, 0, None)).sum()
    assert qg.frechet_distance(df, "f", "side", "a", "b") == pytest.approx(want, rel=1e-6)
    assert qg.frechet_distance(df, "f", "side", "a", "a") == pytest.approx(0.0, abs=1e-8)


def test_grade_reasons_and_population_std(spark):
    real = spark.createDataFrame([(1.0,), (3.0,)], "m double")
    got = {r.m: (r.grade, r.fail_reasons) for r in qg.grade(spark.createDataFrame([(0.0,), (4.1,)], "m double"), real, ["m"]).collect()}
    assert got == {0.0: ("PASS", ""), 4.1: ("FAIL", "m=4.1 outside [0.0, 4.0]")}


@pytest.mark.parametrize("fid,rate,want", [(49.0, 0.9, "PASS"), (50.0, 0.9, "MARGINAL"), (10.0, 0.85, "MARGINAL"), (100.0, 1.0, "REVIEW"), (None, 1.0, "REVIEW")])
def test_verdict(spark, fid, rate, want):
    got = spark.range(1).select(qg.verdict(F.lit(fid).cast("double"), F.lit(rate)).alias("v")).first().v
    assert got == want


def test_constant_heat_map(spark):
    df = spark.createDataFrame([(1, [2.0] * 16)], "k int, c array<double>")
    r = qg.summarize_heat(df, "k", "c", 4).first()
    assert (r.peak_x, r.peak_y, r.area_pct) == (0, 0, 0.0)


def test_histogram_of_one_value(spark):
    got = qg.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 5).collect()
    assert {r.bin: r.n for r in got} == {0: 4, 1: 0, 2: 0, 3: 0, 4: 0}


# ---- sources ------------------------------------------------------------------

def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    head = "image,MEL,NV,BCC,AK,BKL,DF,VASC,SCC,UNK\n"
    write(root / "isic2019/ISIC_2019_Training_GroundTruth.csv", head + "A,1,0,0,0,0,0,0,0,0\nB,0,0,0,0,0,0,0,0,1\nC,0,0,0,0,0,0,0,0,0\nD,0,0,0,0,0,0,0,1,0\n")
    write(root / "isic2019/ISIC_2019_Training_Metadata.csv", "image,age_approx,anatom_site_general,lesion_id,sex\nA,45,head/neck,L1,female\nD,,,,\n")
    write(root / "ham10000/HAM10000_metadata.csv", "lesion_id,image_id,dx,dx_type,age,sex,localization\nH1,I1,nv,histo,50,male,back\nH2,I2,zzz,histo,50,male,back\n")
    write(root / "isic2020/ISIC_2020_Training_GroundTruth.csv", "image_name,patient_id,lesion_id,sex,age_approx,anatom_site_general_challenge,diagnosis,benign_malignant\nJ1,P1,,male,140,torso, Solar Lentigo ,benign\nJ2,,,male,40,,unknown,benign\n")
    write(root / "pad_ufes_20/metadata.csv", "img_id,patient_id,lesion_id,age,gender,region,fitspatrick,diagnostic\nK1.png,P9,7,61,FEMALE,ARM,3.0,ack\nK2.png,P9,8,61,FEMALE,ARM,9,NEV\n")
    return str(root)


def test_adapters_read_all_four_sources(spark, raw):
    rows, status = ad.load_all(spark, ["isic2019", "ham10000", "isic2020", "pad_ufes_20", "fitzpatrick17k"], raw, "/img")
    got = {r.image_id: r for r in rows.collect()}
    assert set(got) == {"A", "D", "I1", "J1", "K1", "K2"}
    assert dict(status)["fitzpatrick17k"] == "no adapter"
    assert (got["A"].class_idx, got["A"].lesion_id, got["A"].age) == (0, "L1", 45.0)
    assert (got["D"].lesion_id, got["D"].site, got["D"].sex, got["D"].age) == ("D", None, None, None)  # missing id falls back
    assert (got["J1"].class_name, got["J1"].age, got["J1"].lesion_id, got["J1"].patient_id) == ("BKL", None, "J1", "P1")
    assert (got["K1"].class_name, got["K1"].fitzpatrick, got["K1"].site, got["K1"].src_image_path) == ("AK", 3, "upper extremity", "/img/pad_ufes_20/images/K1.jpg")
    assert got["K2"].fitzpatrick is None
    bad = ad.quarantined(ad.read_source(spark, ad.ADAPTERS["isic2019"], raw), ad.ADAPTERS["isic2019"]).collect()
    assert [(r.image_id, r.reason) for r in bad] == [("C", "no_label")]


def test_missing_source_is_skipped(spark, raw, tmp_path):
    with pytest.raises(RuntimeError, match="no rows"):
        ad.load_all(spark, ["ham10000"], str(tmp_path))


def test_catalogue_verification(spark):
    entries = cg.catalogue(spark)
    counts = spark.createDataFrame([("ph2", 100), ("ham10000", 5), ("derm7pt", 0)], "dataset_key string, image_count long")
    files = spark.createDataFrame([("ph2", "PH2_dataset.txt"), ("ham10000", "HAM10000_metadata.csv")], "dataset_key string, file string")
    got = {r.dataset_key: r for r in cg.verify(entries, counts, files).collect()}
    assert got["ph2"].present and got["ph2"].issues == []
    assert not got["ham10000"].present and got["ham10000"].issues[0].startswith("image count low: 5")
    assert any("empty" in i for i in got["derm7pt"].issues) and any("missing" in i for i in got["isic2019"].issues)
    assert cg.verify(entries, counts, files, only_tier=3).count() == 1


def test_csv_keeps_null_apart_from_empty(spark):
    path = scratch_path(spark, "nulls")
    sk.write_table(spark.createDataFrame([(1, None), (2, ""), (3, "unknown")], "id int, s string").coalesce(1), path, fmt="csv")
    back = spark.read.schema("id int, s string").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    assert {r.id: r.s for r in back.collect()} == {1: None, 2: "", 3: "unknown"}


def test_corrupt_csv_line_is_kept_aside(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nbroken,4\n")
    rows = ad.read_csv(spark, str(tmp_path / "x.csv"), {"a": "int", "b": "int"}).cache()
    assert rows.filter("_corrupt_record is not null").count() == 1 and rows.filter("_corrupt_record is null").first().b == 2


def test_manifest_with_mixed_spellings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image,sex_male,age\na,True,1.5\nb,0,\nc,FALSE,x\n")
    got = {r.image: (r.sex_male, r.age, r.extra) for r in ad.read_manifest(spark, str(tmp_path / "m.csv"), ["sex_male", "age", "extra"]).collect()}
    assert got == {"a": (1.0, 1.5, 0.0), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}


def test_params_roundtrip_with_absent_assets(spark):
    path = scratch_path(spark, "params")
    blank = dict.fromkeys(["temperature", "class_temperature", "weight", "bias", "scales", "train_prior", "target_prior", "threshold"])
    sk.write_params(spark, {**blank, "temperature": 0.75, "weight": [[1.0, 0.0], [0.0, 1.0]]}, path)
    r = spark.range(1).select(sk.read_params(spark, path).alias("p")).first().p
    assert r.temperature == 0.75 and r.weight[1] == [0.0, 1.0] and r.scales is None


def test_cache_is_keyed_by_configuration(spark):
    calls = []
    def make():
        calls.append(1)
        return spark.range(3)
    key = uuid.uuid4().hex
    assert sk.cached_by_config(spark, "t", key, make).count() == 3
    assert sk.cached_by_config(spark, "t", key, make).count() == 3
    assert len(calls) == 1


def test_spread_only_touches_narrow_inputs(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide) is wide and spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() > 1


# ---- streams ------------------------------------------------------------------

def test_ingest_is_exactly_once(spark):
    src, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    rows = spark.range(10)
    rows.write.parquet(src)
    for extra in (0, 1):
        if extra:
            spark.range(10, 15).write.mode("append").parquet(src)
        st.ingest_directory(spark, src, rows.schema, out, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))


def test_upsert_keeps_the_newest_across_runs(spark):
    src, table, state = (scratch_path(spark, n) for n in ("in", "tbl", "state"))
    schema = "k int, t int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).coalesce(1).write.parquet(src)
    run = lambda: st.upsert_latest(spark.readStream.schema(schema).parquet(src), "k", ["t"], table, state)
    q = run(); q.awaitTermination()
    spark.createDataFrame([(1, 3, "c"), (2, 0, "old")], schema).coalesce(1).write.mode("append").parquet(src)
    q = run(); q.awaitTermination()
    assert sorted(map(tuple, st.read_latest(spark, table).collect())) == [(1, 3, "c"), (2, 1, "b")]
    assert st.versions(spark, table) == [0, 1]
    os.remove(f"{table}/v=1/_SUCCESS")
    spark.createDataFrame([(1, 9, "z")], schema).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="no complete version 1"):
        run().awaitTermination()


def test_heat_map_time_grows_with_the_cells(spark):
    import time

    took = {}
    for side in (96, 384):
        grid = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.lit(side * side)), lambda i: F.sin(i.cast("double"))).alias("a"))
        began = time.perf_counter()
        assert len(qg.summarize_heat(grid, "id", "a", side).collect()) == 2
        took[side] = time.perf_counter() - began
    assert took[384] < 30 * took[96] + 5
