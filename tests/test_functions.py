"""Column functions on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tallyvane.functions import clinical as cl, encode as en, normalize as nz, scores as sc, text as tx
from tallyvane.operators import joins as jn
from tallyvane.schema import META_FEATURES


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_softmax_is_stable_and_sums_to_one(spark):
    got = one(spark, p=sc.softmax(arr(1000, 999, -1000), 3), l=sc.log_softmax(arr(1000, 999, -1000), 3))
    assert sum(got.p) == pytest.approx(1.0)
    assert got.p[0] == pytest.approx(1 / (1 + math.exp(-1)))
    assert got.l[2] == pytest.approx(-2000 - math.log(1 + math.exp(-1)))


def test_wide_vectors_agree_with_unrolled(spark):
    z = F.array(*[F.lit(0.1 * i) for i in range(20)])
    got = one(spark, a=sc.softmax(z, 20), l=sc.logsumexp(z, 20))
    want = [math.exp(0.1 * i) for i in range(20)]
    assert got.a == pytest.approx([w / sum(want) for w in want])
    assert got.l == pytest.approx(math.log(sum(want)))


def test_argmax_takes_first_of_equal(spark):
    assert one(spark, i=sc.argmax(arr(0.2, 0.4, 0.4))).i == 1


def test_temperature_precedence(spark):
    z = arr(2, 4)
    none = F.lit(None).cast("array<double>")
    got = one(
        spark, c=sc.temperature(z, 2, per_class=[2.0, 4.0], scalar=0.5), s=sc.temperature(z, 2, per_class=none, scalar=F.lit(0.5)),
        i=sc.temperature(z, 2, per_class=none, scalar=F.lit(None).cast("double")))
    assert (got.c, got.s, got.i) == ([1.0, 1.0], [4.0, 8.0], [2.0, 4.0])


def test_dirichlet_identity_and_shape(spark):
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = one(spark, d=sc.dirichlet(arr(1, 2), eye, [0.0, 0.0], 2), l=sc.log_softmax(arr(1, 2), 2))
    assert got.d == pytest.approx(got.l)
    with pytest.raises(ValueError):
        sc.dirichlet(arr(1, 2), [[1.0]], [0.0], 2)
    bad = F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="shape mismatch"):
        one(spark, d=sc.dirichlet(arr(1, 2), bad, [0.0, 0.0], 2))


def test_prior_shift_guards_zero_rows(spark):
    got = one(spark, z=sc.shift_probs(arr(0, 0), [0.5, 0.5], [0.9, 0.1], 2), p=sc.shift_probs(arr(0.5, 0.5), [0.5, 0.5], [0.9, 0.1], 2),
              c=sc.shift_probs(arr(0.5, 0.5), arr(0.5, 0.5), arr(0.9, 0.1), 2))
    assert got.z == [0.0, 0.0] and got.p == pytest.approx([0.9, 0.1]) and got.c == pytest.approx([0.9, 0.1])


def test_override_without_threshold_is_off(spark):
    got = one(spark, off=sc.override_pred(F.lit(1), arr(0.9, 0.1), 0, None), on=sc.override_pred(F.lit(1), arr(0.9, 0.1), 0, 0.9))
    assert (got.off, got.on) == (1, 0)


def test_bin_edges_in_both_modes(spark):
    left = [one(spark, b=sc.bin_index(F.lit(v), 4, "left")).b for v in (0.0, 0.25, 0.5, 1.0)]
    right = [one(spark, b=sc.bin_index(F.lit(v), 4, "right")).b for v in (0.0, 0.25, 0.5, 1.0)]
    assert left == [0, 1, 2, 3] and right == [0, 0, 1, 3]


def test_top_k_breaks_ties_by_index(spark):
    got = one(spark, t=sc.top_k(arr(0.3, 0.4, 0.3), 3, ["a", "b", "c"])).t
    assert [x["class"] for x in got] == ["b", "a", "c"]


@pytest.mark.parametrize("raw,want", [(None, None), ("", None), (" Torso ", "anterior torso"), ("moon", "unknown"), ("PALMS/SOLES", "palms/soles"), (" ", "unknown")])
def test_site(spark, raw, want):
    assert one(spark, s=nz.norm_site(F.lit(raw).cast("string"))).s == want


@pytest.mark.parametrize("raw,want", [("0", None), ("130", None), ("45.5", 45.5), ("x", None), (None, None), ("NaN", None)])
def test_age(spark, raw, want):
    assert one(spark, a=nz.norm_age(F.lit(raw).cast("string"))).a == want


def test_missing_and_unknown_differ_in_the_mask(spark):
    none = F.lit(None).cast("string")
    def both(site):
        a = (F.lit(None).cast("double"), none, site, F.lit(None).cast("int"))
        r = one(spark, v=en.meta_vector(*a), m=en.meta_mask(*a))
        return sum(r.v), sum(r.m), r.v[META_FEATURES.index("site_unknown")]
    assert both(none) == (0.0, 0.0, 0.0)
    assert both(F.lit("moon")) == (1.0, 9.0, 1.0)


def test_onehot_without_label_is_null(spark):
    assert one(spark, i=nz.onehot_index([F.lit(0.0), F.lit(0.0)])).i is None


def test_unknown_mode_fails(spark):
    with pytest.raises(Exception, match="Unsupported inference mode"):
        one(spark, m=nz.normalize_mode(F.lit("nope")))


def test_feature_titles(spark):
    names = {"site_head/neck": "Site: Head/Neck", "age_approx": "Age Approx", "sex_female": "Sex Female", "site_upper extremity": "Site: Upper Extremity"}
    for raw, want in names.items():
        assert one(spark, t=tx.feature_title(F.lit(raw))).t == want


@pytest.mark.parametrize("raw,want", [("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T7:08", "2024-03-05 07:08:00"), (" 2024-03-05 07:08:09.5Z", "2024-03-05 07:08:09"), ("", None), ("soon", None), ("2024-02-31", None)])
def test_dates(spark, raw, want):
    got = one(spark, d=tx.parse_date(F.lit(raw))).d
    assert (str(got) if got else None) == want


def test_alignment_and_zone(spark):
    zone = lambda x, y: one(spark, z=cl.zone_family(cl.region(F.lit(x), F.lit(y)))).z
    assert [zone(0.5, 0.5), zone(0.0, 0.0), zone(1.0, 0.5), zone(0.5, 1.0)] == ["central", "upper", "right", "lower"]
    al = lambda a, b: one(spark, v=cl.evidence_alignment(F.lit(a).cast("string"), F.lit(b).cast("string"))).v
    assert [al("left", "left"), al("left", "right"), al("central", "right"), al(None, "left")] == ["aligned", "discordant", "partially_aligned", "partially_aligned"]


def test_intake_errors(spark):
    err = lambda js: one(spark, e=jn.intake_errors(F.lit(js).cast("string"))).e
    assert err('{"ageYears": 4, "sex": "male", "anatomicalSite": "back"}') == []
    assert err("{") == ["400 metadata must be valid JSON"] and err(None) == ["400 metadata must be valid JSON"]
    assert len(err("{}")) == 3


def test_review_array_orders_undated_last(spark):
    rows = [(1, None, "Reviewed", 0.9), (2, "2024-01-01", "Reviewed", 0.5), (3, "2024-01-02", "Reviewed", 0.5), (4, "2024-01-02", "In review", 0.1), (5, "2024-01-02", "Reviewed", 0.5)]
    df = spark.createDataFrame([(rows,)], "e array<struct<id:int,date:string,status:string,confidence:double>>")
    assert [e.id for e in df.select(jn.review_array(F.col("e")).alias("e")).first().e] == [4, 3, 5, 2, 1]


def test_required_columns_fail_at_plan_time(spark):
    with pytest.raises(ValueError, match="missing required"):
        jn.require_columns(spark.range(1), ["id", "gone"])
