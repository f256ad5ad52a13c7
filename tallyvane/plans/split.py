"""Split, sampling and balancing queries (SPL*, SET4, AGG2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.operators import quality as qg, split as sp
from tallyvane.plans.curate import SYNTH, gate_sides, synth_parts
from tallyvane.plans.fixtures import CONTENT, content, groups, predictions, table
from tallyvane.operators.dedup import content_dedup
from tallyvane.plans.registry import query, r, rounded, rq


SEED = 42
NAMES = ["train", "val"]


def _h(key: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || {key})"


@query("spl1_stratified_split", f"""WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}) AS rn,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM k""")
def spl1(spark, sf):
    rows = groups(spark, sf).select("o_orderkey", "o_orderpriority")
    return sp.stratified_split(rows, "o_orderpriority", "o_orderkey", [0.8], NAMES, SEED)


@query("spl1_three_way", f"""WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}) AS rn,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= round(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= round(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def spl1_three(spark, sf):
    rows = groups(spark, sf).select("o_orderkey", "o_orderpriority")
    return sp.stratified_split(rows, "o_orderpriority", "o_orderkey", [0.8, 0.1], ["train", "val", "test"], SEED).select("o_orderkey", "split")


_GROUP = f"""g AS (SELECT DISTINCT o_custkey FROM orders), gr AS (SELECT o_custkey, row_number() OVER (ORDER BY {_h('o_custkey')}) AS rn, count(*) OVER () AS n FROM g),
t1 AS (SELECT *, CAST(ceil(n * (0.15::DOUBLE / 1.0)) AS BIGINT) AS a FROM gr), t2 AS (SELECT *, a + CAST(ceil((n - a) * (0.05::DOUBLE / (1.0::DOUBLE - 0.15))) AS BIGINT) AS b FROM t1),
t3 AS (SELECT *, b + CAST(ceil((n - b) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2))) AS BIGINT) AS c FROM t2),
gs AS (SELECT o_custkey, CASE WHEN rn <= a THEN 'test' WHEN rn <= b THEN 'val_calibrate' WHEN rn <= c THEN 'val_select' ELSE 'train' END AS split FROM t3)"""


def grouped(spark, sf):
    return sp.group_split(groups(spark, sf), "o_custkey", SEED)


@query("spl2_group_split", "WITH " + _GROUP + " SELECT o_orderkey, orders.o_custkey, split FROM orders JOIN gs USING (o_custkey)")
def spl2(spark, sf):
    return grouped(spark, sf).select("o_orderkey", "o_custkey", "split")


_FOLD = f"""cc AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2), dc AS (SELECT o_custkey, min(o_orderpriority) AS cls FROM (SELECT *, max(c) OVER (PARTITION BY o_custkey) AS m FROM cc) WHERE c = m GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {_h('o_custkey')}) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM dc), hm AS (SELECT o_custkey, CAST(((rn - 1) * 5) // n AS INTEGER) AS home FROM rk),
fd AS (SELECT o_custkey, home, CAST(f.fold AS INTEGER) AS fold FROM hm, (SELECT unnest(range(5)) AS fold) f),
rs AS (SELECT o_custkey, fold, row_number() OVER (PARTITION BY fold ORDER BY md5('42:' || fold || '|' || o_custkey)) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM fd WHERE fold <> home),
rc AS (SELECT *, CAST(ceil(n * (0.05::DOUBLE / 0.85)) AS BIGINT) AS a FROM rs), rd AS (SELECT *, a + CAST(ceil((n - a) * (0.1::DOUBLE / 0.8)) AS BIGINT) AS b FROM rc),
fs AS (SELECT o_custkey, fold, 'test' AS split FROM fd WHERE fold = home UNION ALL SELECT o_custkey, fold, CASE WHEN rn <= a THEN 'val_calibrate' WHEN rn <= b THEN 'val_select' ELSE 'train' END FROM rd)"""


@query("spl3_group_kfold", "WITH " + _FOLD + " SELECT o_custkey, fold, split, 1::BIGINT AS n_splits FROM fs")
def spl3(spark, sf):
    rows = sp.group_kfold(groups(spark, sf), "o_custkey", "o_orderpriority", 5, SEED)
    return rows.groupBy("o_custkey", "fold").agg(F.max("split").alias("split"), F.count_distinct("split").alias("n_splits"))


@query("spl3_fold_sizes", "WITH " + _FOLD + " SELECT fold, split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN fs USING (o_custkey) GROUP BY 1, 2")
def spl3_sizes(spark, sf):
    rows = sp.group_kfold(groups(spark, sf), "o_custkey", "o_orderpriority", 5, SEED)
    return rows.groupBy("fold", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"))


@query("spl4_split_run_manifest", "WITH " + CONTENT + """, kd AS (SELECT doc_id, dataset, row_number() OVER (PARTITION BY sha1 ORDER BY priority, doc_id) AS k FROM ct), d AS (SELECT doc_id, dataset, doc_id // 4 AS lesion FROM kd WHERE k = 1),
g AS (SELECT DISTINCT lesion FROM d), gr AS (SELECT lesion, row_number() OVER (ORDER BY md5('42:' || lesion)) AS rn, count(*) OVER () AS n FROM g),
t1 AS (SELECT *, CAST(ceil(n * 0.15::DOUBLE) AS BIGINT) AS a FROM gr), t2 AS (SELECT *, a + CAST(ceil((n - a) * (0.05::DOUBLE / (1.0::DOUBLE - 0.15))) AS BIGINT) AS b FROM t1), t3 AS (SELECT *, b + CAST(ceil((n - b) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2))) AS BIGINT) AS c FROM t2),
gs AS (SELECT lesion, CASE WHEN rn <= a THEN 'test' WHEN rn <= b THEN 'val_calibrate' WHEN rn <= c THEN 'val_select' ELSE 'train' END AS split FROM t3),
s AS (SELECT split, count(*) AS n_rows, count(DISTINCT lesion) AS n_groups FROM d JOIN gs USING (lesion) GROUP BY 1)
SELECT sha1('{"mode":"single","seed":"42"}') AS run_id, split, n_rows, n_groups, """ + rq("n_rows / sum(n_rows) OVER ()") + " AS achieved FROM s")
def spl4(spark, sf):
    rows = content_dedup(content(spark, sf), "sha1", "priority", "doc_id").select("doc_id", "dataset", F.floor(F.col("doc_id") / 4).alias("lesion"))
    cut = sp.require_no_leak(sp.group_split(rows, "lesion", SEED), "lesion")
    shares = {"test": 0.15, "val_calibrate": 0.05, "val_select": 0.10, "train": 0.70}
    return rounded(sp.split_manifest(cut, "lesion", {"mode": "single", "seed": SEED}, shares), "achieved")


@query("set4_leak_check", "SELECT o_custkey, count(DISTINCT o_orderkey % 2) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) > 1")
def set4(spark, sf):
    rows = groups(spark, sf).withColumn("split", (F.col("o_orderkey") % 2).cast("string"))
    return sp.leaking_groups(rows, "o_custkey")


@query("set4_gate_passes", "WITH " + _GROUP + " SELECT split, count(*) AS n FROM orders JOIN gs USING (o_custkey) GROUP BY 1")
def set4_gate(spark, sf):
    return sp.require_no_leak(grouped(spark, sf), "o_custkey").groupBy("split").agg(F.count("*").alias("n"))


@query("agg2_class_balance", "WITH " + _GROUP + f""", sc AS (SELECT split, o_orderpriority, count(*) AS n FROM orders JOIN gs USING (o_custkey) GROUP BY 1, 2),
q AS (SELECT split, o_orderpriority, n, n / sum(n) OVER (PARTITION BY split) AS share, sum(n) OVER (PARTITION BY o_orderpriority) / sum(n) OVER () AS target FROM sc)
SELECT split, o_orderpriority, n, {rq('share')} AS share, {rq('target')} AS target, abs(share - target) > 0.02 AS drifts FROM q""")
def agg2(spark, sf):
    return rounded(sp.class_balance(grouped(spark, sf), "o_orderpriority"), "share", "target")


@query("spl5_stratified_folds", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, CAST(((rn - 1) * 5) // n AS INTEGER) AS fold FROM k""")
def spl5(spark, sf):
    rows = groups(spark, sf).select("o_orderkey", "o_orderpriority")
    return sp.stratified_folds(rows, "o_orderpriority", "o_orderkey", 5, SEED).select("o_orderkey", "fold")


@query("spl6_tune_check_resplit", f"""WITH k AS (SELECT vec_id AS row_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT row_id, CASE WHEN rn <= round(n * 0.8::DOUBLE) THEN 'tune' ELSE 'check' END AS split FROM k""")
def spl6(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return sp.stratified_split(rows, "label", "row_id", [0.8], ["tune", "check"], 7).select("row_id", "split")


@query("spl7_balanced_poisson", """WITH c AS (SELECT o_orderpriority AS cls, count(*)::DOUBLE AS n FROM orders GROUP BY 1), r AS (SELECT cls, (1.0 / n) * sum(n) OVER () / count(*) OVER () AS lam FROM c),
k AS (SELECT range AS k FROM range(60)), d AS (SELECT cls, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY cls ORDER BY k) AS cdf FROM r, k),
u AS (SELECT o_orderkey, o_orderpriority AS cls, ('0x' || substr(md5('42:' || o_orderkey), 1, 13))::BIGINT / pow(2, 52) AS u FROM orders),
p AS (SELECT u.o_orderkey, u.cls, count(*) FILTER (WHERE u >= cdf) AS copies FROM u JOIN d USING (cls) GROUP BY 1, 2)
SELECT cls AS o_orderpriority, count(*) AS n_rows, sum(copies)::BIGINT AS n_drawn FROM p GROUP BY 1""")
def spl7(spark, sf):
    rows = sp.poisson_balanced(groups(spark, sf), "o_orderpriority", "o_orderkey", SEED, power=1.0)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"), F.sum("copies").alias("n_drawn"))


@query("spl7_balanced_exact", """WITH c AS (SELECT o_orderpriority AS cls, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT cls, n, sum(pow(n::DOUBLE, 0.5)) OVER (ORDER BY cls) / sum(pow(n::DOUBLE, 0.5)) OVER () AS hi FROM c),
d AS (SELECT id, ('0x' || substr(md5('42:class:' || id), 1, 13))::BIGINT / pow(2, 52) AS u, ('0x' || substr(md5('42:row:' || id), 1, 13))::BIGINT / pow(2, 52) AS v FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS id)),
p AS (SELECT id, v, arg_min(cls, hi) AS cls, arg_min(n, hi) AS n FROM d, e WHERE u < hi GROUP BY 1, 2), w AS (SELECT id, cls, CAST(floor(v * n) AS BIGINT) + 1 AS rank FROM p),
k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey)) AS rn FROM orders)
SELECT id AS draw, o_orderpriority, o_orderkey FROM w JOIN k ON k.o_orderpriority = w.cls AND k.rn = w.rank""")
def spl7_exact(spark, sf):
    return sp.weighted_with_replacement(groups(spark, sf), "o_orderpriority", "o_orderkey", SEED).select("draw", "o_orderpriority", "o_orderkey")


@query("spl8_sample_without_replacement", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 50")
def spl8(spark, sf):
    return sp.sample_without_replacement(groups(spark, sf), "o_orderkey", 50, SEED).select("o_orderkey", "o_orderpriority")


@query("spl9_trim_to_target", f"""WITH real AS (SELECT o_orderpriority AS cls, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}) AS rn FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, o_orderpriority, rn <= greatest(0, 1500 - coalesce(n, 0)) AS kept FROM k LEFT JOIN real ON cls = o_orderpriority""")
def spl9(spark, sf):
    o = table(spark, sf, "orders")
    real, synth = o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority")
    return sp.trim_to_target(real, synth, "o_orderpriority", "o_orderkey", 1500, SEED)


@query("spl9_shortfall", """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS r, count(*) FILTER (WHERE o_orderstatus <> 'F') AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, r AS n_real, s AS n_synth, greatest(0, 2500 - r) AS needed, greatest(0, greatest(0, 2500 - r) - s) AS missing, greatest(0, s - greatest(0, 2500 - r)) AS excess FROM c""")
def spl9_shortfall(spark, sf):
    o = table(spark, sf, "orders")
    return sp.shortfall(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "o_orderpriority", 2500)


@query("spl10_append_synthetic", "WITH " + SYNTH + """, real AS (SELECT * FROM sy WHERE NOT starts_with(image, 'SYNTH_')), md AS (SELECT class, median(p_size) AS ms, median(p_retailprice) AS mp, median(big::INTEGER) AS mb FROM real GROUP BY 1)
SELECT class, image, p_size::DOUBLE AS p_size, p_retailprice, big FROM real UNION ALL SELECT sy.class, image, round(coalesce(ms, 0), 1), round(coalesce(mp, 0), 1), coalesce(mb, 0) > 0.5 FROM sy LEFT JOIN md USING (class) WHERE starts_with(image, 'SYNTH_')""")
def spl10(spark, sf):
    rows = synth_parts(spark, sf).withColumn("p_size", F.col("p_size").cast("double"))
    real, synth = rows.filter(~F.col("image").startswith("SYNTH_")), rows.filter(F.col("image").startswith("SYNTH_")).select("class", "image")
    medians = qg.class_medians(real, "class", ["p_size", "p_retailprice"], ["big"])
    return sp.append_synthetic(real, synth, "class", medians, ["p_size", "p_retailprice"], ["big"])


_U = lambda tag: f"(('0x' || substr(md5('42:{tag}:' || image), 1, 13))::BIGINT / pow(2, 52))"


@query("spl11_metadata_jitter", "WITH " + SYNTH + f""", c AS (SELECT image, CASE p_partkey % 4 WHEN 0 THEN 'AK' WHEN 1 THEN 'SCC' WHEN 2 THEN 'DF' ELSE 'VASC' END AS cls FROM sy),
u AS (SELECT *, sqrt(-2 * ln(greatest({_U('age1')}, pow(2, -52)))) * cos(6.283185307179586::DOUBLE * {_U('age2')}) AS z, CAST(floor({_U('site')} * 3) AS INTEGER) AS si FROM c),
m AS (SELECT *, CASE cls WHEN 'AK' THEN 70 + 10 * z WHEN 'SCC' THEN 65 + 12 * z WHEN 'DF' THEN 45 + 12 * z ELSE 50 + 15 * z END AS raw,
 CASE cls WHEN 'AK' THEN (['head/neck','upper extremity','trunk'])[si + 1] WHEN 'SCC' THEN (['head/neck','upper extremity','lower extremity'])[si + 1] WHEN 'DF' THEN (['lower extremity','trunk','upper extremity'])[si + 1] ELSE (['trunk','lower extremity','head/neck'])[si + 1] END AS place FROM u)
SELECT image, cls, round_even(least(greatest(raw, 20.0), 90.0), 0) AS age_jit, CASE WHEN {_U('sex')} < 0.5 THEN 'female' ELSE 'male' END AS sex_jit,
 CASE WHEN place = 'trunk' THEN CASE WHEN {_U('side')} < 0.5 THEN 'anterior torso' ELSE 'posterior torso' END ELSE place END AS site_jit FROM m""")
def spl11(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("AK", "SCC", "DF", "VASC")])
    rows = synth_parts(spark, sf).select("image", F.get(codes, (F.col("p_partkey") % 4).cast("int")).alias("cls"))
    return sp.jitter_metadata(rows, "cls", "image", SEED)
