"""Queries: sources, sinks, cleaning, joins of rows, hashing, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG, FAMILIES, RAW_LABELS
from ..operators import clean as C
from ..operators import split as S
from ..sources import files
from ..sources.views import FEATURES, LINE, ORDER, cte, view
from .registry import query

NUM = ["quantity", "price", "discount", "duration"]
# Shared pieces of oracle SQL.
TRIMMED = "trim(coalesce(label, 'nan'))"
RELABEL = f"CASE WHEN lower({TRIMMED}) LIKE '%- attempted' THEN 'Benign' ELSE {TRIMMED} END"
_known = " ".join(f"WHEN lower(trim(L)) IN ({', '.join(repr(r) for r in raws)}) THEN '{fam}'" for fam, raws in RAW_LABELS.items())


def family_sql(label: str) -> str:
    low = f"lower(trim({label}))"
    brute = f"({low} LIKE '%brute force%' OR {low} LIKE '%bruteforce%' OR {low} LIKE '%patator%')"
    return f"""CASE {_known.replace('trim(L)', f'trim({label})')}
  WHEN {low} LIKE '%infiltration%' THEN 'Infiltration' WHEN {low} LIKE '%portscan%' OR {low} LIKE '%port scan%' THEN 'PortScan'
  WHEN {low} LIKE 'ddos%' OR {low} LIKE 'dddos%' THEN 'DDoS' WHEN {low} LIKE 'dos%' THEN 'DoS' WHEN {low} LIKE '%web attack%' THEN 'WebAttack'
  WHEN {brute} AND ({low} LIKE '%web%' OR {low} LIKE '%xss%' OR {low} LIKE '%sql%') THEN 'WebAttack' WHEN {brute} THEN 'BruteForce'
  WHEN {low} LIKE '%botnet%' OR {low} = 'bot' THEN 'Botnet' END"""


NAN = " OR ".join(f"({c} IS NULL OR isnan({c}))" for c in NUM)
INF = " OR ".join(f"coalesce(isinf({c}), false)" for c in NUM)
DEDUP = f"""{cte('dirty')}, r AS (SELECT id, okey, lnum, pkey, skey, cohort, {RELABEL} AS label, quantity, price, discount, duration FROM dirty),
c AS (SELECT * FROM r WHERE NOT ({NAN}) AND NOT ({INF})),
d AS (SELECT DISTINCT * FROM c), f AS (SELECT *, {family_sql('label')} AS family FROM d), m AS (SELECT * FROM f WHERE family IS NOT NULL),
k AS (SELECT * FROM m WHERE family IN (SELECT family FROM m GROUP BY family HAVING count(*) >= 100))"""
DIRTY_COLS = ["okey", "lnum", "pkey", "skey", "cohort", "label", *NUM]
LONGKEYS = ", ".join(ORDER)


def _deduped(spark, d):
    return C.dedup_first(C.clean(view(spark, d, "dirty"), NUM), DIRTY_COLS, ["id"])


def _kept(spark, d):
    return C.family_floor(C.with_family(_deduped(spark, d)))


@query("SRC-01")
def src_01(spark, d):
    """Files of a folder, largest first."""
    return files.list_files(spark, d)


@query("SRC-02", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_02(spark, d):
    """A CSV scan with a given schema, over a written copy."""
    path = files.write_csv(spark.read.parquet(f"{d}/nation.parquet"))
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SRC-03", "SELECT * FROM (VALUES ('n_nationkey,n_name,n_regionkey', CAST(1 AS BIGINT)), ('r_regionkey,r_name', 1)) t(header, n_files)")
def src_03(spark, d):
    """Files grouped by header."""
    a = files.write_csv(spark.read.parquet(f"{d}/nation.parquet"))
    b = files.write_csv(spark.read.parquet(f"{d}/region.parquet"))
    return files.header_groups(spark, [a, b])


@query("SRC-04", "SELECT count(*) AS n_rows FROM lineitem")
def src_04(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*").alias("n_rows"))


@query("SRC-05", "SELECT l_quantity FROM lineitem")
def src_05(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity")


@query("SRC-06", "SELECT l_quantity, l_tax, l_returnflag FROM lineitem")
def src_06(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_tax", "l_returnflag")


@query("SRC-07", f"WITH {cte('line')} SELECT okey, CAST(lnum AS DOUBLE) AS v FROM line WHERE cohort = 'A' AND quantity > 10 UNION ALL SELECT okey, price AS v FROM line WHERE cohort = 'B' AND quantity > 10")
def src_07(spark, d):
    """Shards stacked with widening of types, then filtered."""
    v = view(spark, d, "line")
    a = v.where("cohort = 'A'").select("okey", F.col("lnum").alias("v"), "quantity")
    b = v.where("cohort = 'B'").select("okey", F.col("price").alias("v"), "quantity")
    return files.stack_shards([a, b]).where("quantity > 10").select("okey", "v")


@query("SRC-08", "SELECT r_regionkey, r_name FROM region")
def src_08(spark, d):
    """A JSON artifact, or an empty table where it is absent."""
    there = files.write_json(spark.read.parquet(f"{d}/region.parquet"))
    found = files.read_artifact(spark, there, "r_regionkey int, r_name string")
    return found.unionByName(files.read_artifact(spark, there + "-absent", "r_regionkey int, r_name string"))


@query("SRC-09", "SELECT 'rows' AS item, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def src_09(spark, d):
    """Counts parsed back from a text report."""
    o = spark.read.parquet(f"{d}/orders.parquet").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    path = files.write_text(o.select(F.explode(F.array(F.format_string("rows: %d", "n"), F.format_string("open: %d", "o"))).alias("value")))
    return files.parse_report(spark, path)


@query("SNK-01", "SELECT o_orderkey, o_orderstatus FROM orders")
def snk_01(spark, d):
    return spark.read.parquet(files.write_parquet(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")))


@query("SNK-02", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def snk_02(spark, d):
    return spark.read.parquet(files.write_parquet(spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")))


@query("SNK-03", f"WITH {cte('line')}, e AS (SELECT *, CASE family WHEN 'Benign' THEN 0 WHEN 'Botnet' THEN 1 ELSE 4 END AS code FROM line), g AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {LONGKEYS}) - 1 AS g FROM e) SELECT CASE WHEN (g + (code * 131 + 42) % 1000) % 1000 < 200 THEN 'test' ELSE 'train' END AS split, code::TINYINT AS label_multiclass, count(*) AS count FROM g GROUP BY 1, 2")
def snk_03(spark, d):
    """Train and test written by split, features as float and codes as byte."""
    df = S.systematic_split(C.encode(view(spark, d, "line")), "label_multiclass", ORDER)
    out = df.select(*(F.col(f).cast("float") for f in FEATURES), F.col("label_binary").cast("byte"), F.col("label_multiclass").cast("byte"), "split")
    return spark.read.parquet(files.write_parquet(out, "split")).groupBy("split", "label_multiclass").count()


@query("SNK-04", "SELECT r_regionkey, r_name FROM region")
def snk_04(spark, d):
    return files.read_csv(spark, files.write_csv(spark.read.parquet(f"{d}/region.parquet")), "r_regionkey int, r_name string")


@query("SNK-05", "SELECT r_regionkey, r_name FROM region")
def snk_05(spark, d):
    return spark.read.schema("r_regionkey int, r_name string").json(files.write_json(spark.read.parquet(f"{d}/region.parquet")))


@query("SNK-06", f"WITH {cte('feat')} SELECT feature, sep_a AS axis2_a, sep_b AS axis2_b, cal AS c2st_calibrated FROM feat")
def snk_06(spark, d):
    """Nested verdicts as flat columns."""
    nested = view(spark, d, "feat").select("feature", F.struct(F.col("sep_a").alias("a"), F.col("sep_b").alias("b")).alias("axis2"), F.struct(F.col("cal").alias("calibrated")).alias("c2st"))
    return files.flatten(nested)


@query("SNK-07", f"""WITH {cte('feat')} SELECT 'importance' AS listing, feature, row_number() OVER (ORDER BY imp_a DESC NULLS LAST, feature) AS place FROM feat
UNION ALL SELECT 'most_shifted', feature, row_number() OVER (ORDER BY cal DESC NULLS LAST, feature) FROM feat
UNION ALL SELECT 'least_shifted', feature, row_number() OVER (ORDER BY cal NULLS LAST, feature) FROM feat
UNION ALL SELECT 'most_stable', feature, row_number() OVER (ORDER BY stab DESC NULLS LAST, feature) FROM feat
UNION ALL SELECT 'least_stable', feature, row_number() OVER (ORDER BY stab NULLS LAST, feature) FROM feat
UNION ALL SELECT 'permutation', feature, row_number() OVER (ORDER BY perm_a DESC NULLS LAST, feature) FROM feat""")
def snk_07(spark, d):
    from ..operators.cross import ranked_listings

    return ranked_listings(view(spark, d, "feat"))


@query("SNK-08")
def snk_08(spark, d):
    """A model saved and loaded, used for scores."""
    from ..operators.models import saved_and_loaded

    return saved_and_loaded(view(spark, d, "line"), FEATURES)


@query("SNK-09")
def snk_09(spark, d):
    """A text report of the row funnel."""
    lines = agg_01(spark, d).select(F.format_string("%s: %d of family %s", "stage", "n", "family").alias("value"))
    return spark.read.text(files.write_text(lines))


@query("REL-01", "SELECT o_orderkey AS \"order key\", o_orderstatus AS label FROM orders")
def rel_01(spark, d):
    raw = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS ` order key`", "o_orderstatus AS `label `", "1 AS `Attempted Category`")
    return C.normalise_columns(raw)


@query("REL-02", f"WITH {cte('dirty')} SELECT {RELABEL} AS label, count(*) AS n FROM dirty GROUP BY 1")
def rel_02(spark, d):
    return view(spark, d, "dirty").groupBy(C.relabel_attempted(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


@query("REL-03", f"WITH {cte('dirty')} SELECT CASE WHEN lower(trim(label)) = 'benign' THEN 'Benign' ELSE trim(label) END AS label, count(*) AS n FROM dirty GROUP BY 1")
def rel_03(spark, d):
    return view(spark, d, "dirty").groupBy(C.standard_label(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


@query("REL-04", f"WITH {cte('dirty')} SELECT label, {family_sql('label')} AS family, count(*) AS n FROM dirty GROUP BY 1, 2 HAVING family IS NOT NULL")
def rel_04(spark, d):
    return C.with_family(view(spark, d, "dirty")).groupBy("label", "family").agg(F.count("*").alias("n"))


@query("REL-05", f"WITH {cte('dirty')}, r AS (SELECT {RELABEL} AS label, quantity, price, discount, duration FROM dirty) SELECT label, count(*) FILTER (WHERE {NAN}) AS n_dropped, count(*) FILTER (WHERE NOT ({NAN})) AS n_kept FROM r GROUP BY 1")
def rel_05(spark, d):
    r = view(spark, d, "dirty").withColumn("label", C.relabel_attempted(F.col("label")))
    return r.groupBy("label").agg(F.count_if(C.is_missing(NUM)).alias("n_dropped"), F.count_if(~C.is_missing(NUM)).alias("n_kept"))


@query("REL-06", f"WITH {cte('dirty')}, r AS (SELECT {RELABEL} AS label, quantity, price, discount, duration FROM dirty) SELECT label, count(*) AS n_inf, count(*) FILTER (WHERE duration = 0) AS n_zero_duration FROM r WHERE NOT ({NAN}) AND ({INF}) GROUP BY 1")
def rel_06(spark, d):
    r = view(spark, d, "dirty").withColumn("label", C.relabel_attempted(F.col("label"))).where(~C.is_missing(NUM) & C.is_infinite(NUM))
    return r.groupBy("label").agg(F.count("*").alias("n_inf"), F.count_if(F.col("duration") == 0).alias("n_zero_duration"))


@query("REL-07", f"WITH {cte('dirty')} SELECT cohort, CASE WHEN ({NAN}) AND ({INF}) THEN 'both' WHEN {NAN} THEN 'nan_only' WHEN {INF} THEN 'inf_only' ELSE 'clean' END AS quality, count(*) AS n FROM dirty GROUP BY 1, 2")
def rel_07(spark, d):
    return view(spark, d, "dirty").groupBy("cohort", C.quality_flag(NUM).alias("quality")).agg(F.count("*").alias("n"))


@query("REL-08", f"WITH {DEDUP} SELECT cohort, family, count(*) AS n FROM k GROUP BY 1, 2")
def rel_08(spark, d):
    return _kept(spark, d).groupBy("cohort", "family").agg(F.count("*").alias("n"))


@query("REL-09", f"WITH {cte('dirty')} SELECT okey, lnum, quantity, price FROM dirty WHERE NOT isnan(quantity) AND NOT isinf(price) AND quantity IS NOT NULL AND price IS NOT NULL")
def rel_09(spark, d):
    text = view(spark, d, "dirty").withColumns({c: F.col(c).cast("string") for c in ("quantity", "price")})
    v = text.withColumns({c: F.col(c).try_cast("double") for c in ("quantity", "price")})
    return v.where(C.finite("quantity") & C.finite("price")).select("okey", "lnum", "quantity", "price")


@query("REL-10", "SELECT * FROM (VALUES ('quantity', 0), ('price', 1)) t(feature, place)")
def rel_10(spark, d):
    names = C.ml_features(["id", "Label", "quantity", "price", "Dst Port", "tax"], ["tax"])
    return spark.createDataFrame([(f, i) for i, f in enumerate(names)], "feature string, place int")


@query("REL-11", f"WITH {cte('line')} SELECT family, CASE family WHEN 'Benign' THEN 0 ELSE 1 END AS label_binary, CASE family WHEN 'Benign' THEN 0 WHEN 'Botnet' THEN 1 ELSE 4 END AS label_multiclass, count(*) AS n FROM line GROUP BY 1, 2, 3")
def rel_11(spark, d):
    return C.encode(view(spark, d, "line")).groupBy("family", "label_binary", "label_multiclass").agg(F.count("*").alias("n"))


@query("REL-12", f"WITH {cte('line')} SELECT cohort, round(sum(quantity), 4) AS total FROM line GROUP BY 1")
def rel_12(spark, d):
    return C.assert_finite(view(spark, d, "line"), FEATURES).groupBy("cohort").agg(F.round(F.sum("quantity"), 4).alias("total"))


SPLIT = f"""{cte('line')}, e AS (SELECT *, CASE family WHEN 'Benign' THEN 0 WHEN 'Botnet' THEN 1 ELSE 4 END AS code FROM line),
g AS (SELECT *, row_number() OVER (PARTITION BY cohort, code ORDER BY {LONGKEYS}) - 1 AS g FROM e),
s AS (SELECT *, CASE WHEN (g + (code * 131 + 42) % 1000) % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM g)"""
SCALER = f"{SPLIT}, sc AS (SELECT cohort, avg(quantity) AS mq, CASE WHEN stddev_pop(quantity) = 0 THEN 1 ELSE stddev_pop(quantity) END AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM s WHERE split = 'train' GROUP BY cohort)"


def _split(spark, d):
    e = C.encode(view(spark, d, "line")).withColumnRenamed("label_multiclass", "code")
    g = S.running_index(e, ["cohort", "code"], ORDER)
    phase = (F.col("code") * CONFIG.split_phase + CONFIG.seed) % CONFIG.split_modulus
    return g.withColumn("split", F.when((F.col("g") + phase) % CONFIG.split_modulus < CONFIG.split_test, "test").otherwise("train"))


@query("REL-13", f"WITH {SCALER} SELECT s.cohort, split, round(avg((quantity - mq) / sq), 6) + 0.0 AS mean_z, round(stddev_pop((quantity - mq) / sq), 6) AS sd_z FROM s JOIN sc ON s.cohort = sc.cohort GROUP BY 1, 2")
def rel_13(spark, d):
    s = _split(spark, d)
    params = s.where("split = 'train'").groupBy("cohort").agg(F.avg("quantity").alias("m"), F.stddev_pop("quantity").alias("sd"))
    z = s.join(params, "cohort").withColumn("z", (F.col("quantity") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return z.groupBy("cohort", "split").agg((F.round(F.avg("z"), 6) + 0.0).alias("mean_z"), F.round(F.stddev_pop("z"), 6).alias("sd_z"))


@query("REL-14", f"WITH {SCALER}, p AS (SELECT max(CASE cohort WHEN 'A' THEN mq END) AS ma, max(CASE cohort WHEN 'A' THEN sq END) AS sa, max(CASE cohort WHEN 'B' THEN mq END) AS mb, max(CASE cohort WHEN 'B' THEN sq END) AS sb FROM sc) SELECT okey, lnum, pkey, round((((quantity - mb) / sb) * sb + mb - ma) / sa, 6) + 0.0 AS z FROM s, p WHERE cohort = 'B' AND split = 'test'")
def rel_14(spark, d):
    s = _split(spark, d)
    p = {r["cohort"]: r for r in s.where("split = 'train'").groupBy("cohort").agg(F.avg("quantity").alias("m"), F.stddev_pop("quantity").alias("s")).collect()}
    lit = lambda c, k: F.lit(p[c][k])
    z = (F.col("quantity") - lit("B", "m")) / lit("B", "s")
    out = S.rebase(z, lit("B", "m"), lit("B", "s"), lit("A", "m"), lit("A", "s"))
    return s.where("cohort = 'B' and split = 'test'").select("okey", "lnum", "pkey", (F.round(out, 6) + 0.0).alias("z"))


@query("REL-15", f"WITH {cte('drift')} SELECT okey, lnum, pkey, round(sign(code) * ln(1 + abs(code)), 6) + 0.0 AS symlog, round(log10(price), 6) AS log10_price, round(asinh(code), 6) AS arcsinh FROM drift")
def rel_15(spark, d):
    from ..functions.scales import to_scale

    v = view(spark, d, "drift")
    return v.select("okey", "lnum", "pkey", (F.round(to_scale(F.col("code"), "symlog"), 6) + 0.0).alias("symlog"), F.round(to_scale(F.col("price"), "log"), 6).alias("log10_price"), F.round(to_scale(F.col("code"), "arcsinh"), 6).alias("arcsinh"))


@query("REL-25", f"""SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS file_name,
CASE WHEN p_partkey * 100000 < 1024 THEN concat(p_partkey * 100000, ' B') WHEN p_partkey * 100000 < 1048576 THEN concat(p_partkey * 100000 // 1024, ' KB') ELSE concat(p_partkey * 100000 // 1048576, ' MB') END AS size FROM part""")
def rel_25(spark, d):
    from ..functions.scales import human_size, safe_name

    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", safe_name(F.col("p_type")).alias("file_name"), human_size(F.col("p_partkey") * 100000).alias("size"))


@query("JN-04", f"WITH {SPLIT}, t AS (SELECT DISTINCT CAST(quantity AS FLOAT) AS q, CAST(discount AS FLOAT) AS x, CAST(tax AS FLOAT) AS t FROM s WHERE cohort = 'A' AND split = 'train') SELECT count(*) AS n_test, count(t.q) AS n_overlap FROM s LEFT JOIN t ON CAST(quantity AS FLOAT) = t.q AND CAST(discount AS FLOAT) = t.x AND CAST(tax AS FLOAT) = t.t WHERE cohort = 'A' AND split = 'test'")
def jn_04(spark, d):
    from ..operators.overlap import flag_overlap

    s = _split(spark, d).where("cohort = 'A'")
    return flag_overlap(s.where("split = 'test'"), s.where("split = 'train'"), ["quantity", "discount", "tax"]).agg(F.count("*").alias("n_test"), F.count_if("overlap").alias("n_overlap"))


@query("JN-05", f"WITH {SPLIT} SELECT okey, lnum, pkey FROM s x WHERE cohort = 'B' AND split = 'test' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.cohort = 'B' AND t.split = 'train' AND t.quantity = x.quantity AND t.discount = x.discount AND t.tax = x.tax AND t.line = x.line)")
def jn_05(spark, d):
    from ..operators.overlap import overlap_free

    s = _split(spark, d).where("cohort = 'B'")
    return overlap_free(s.where("split = 'test'"), s.where("split = 'train'"), ["quantity", "discount", "tax", "line"]).select("okey", "lnum", "pkey")


@query("JN-07", f"WITH {DEDUP} SELECT cohort, count(*) AS n FROM d GROUP BY 1")
def jn_07(spark, d):
    return _deduped(spark, d).groupBy("cohort").agg(F.count("*").alias("n"))


@query("DED-01")
def ded_01(spark, d):
    """Row hashes over all columns but the id, after relabelling."""
    return C.row_hash(C.clean(view(spark, d, "dirty"), NUM), DIRTY_COLS).select("id", "row_hash")


@query("DED-02", f"WITH {DEDUP} SELECT okey, lnum, pkey, skey, cohort, label FROM d")
def ded_02(spark, d):
    return _deduped(spark, d).select("okey", "lnum", "pkey", "skey", "cohort", "label")


@query("DED-03", f"WITH {cte('line')} SELECT count(*) AS n_rows, count(DISTINCT (CAST(quantity AS FLOAT), CAST(discount AS FLOAT), CAST(tax AS FLOAT), CAST(line AS FLOAT))) AS n_distinct FROM line")
def ded_03(spark, d):
    cols = [F.col(c).cast("float").alias(c) for c in ("quantity", "discount", "tax", "line")]
    hashed = C.row_hash(view(spark, d, "line").select(*cols), ["quantity", "discount", "tax", "line"])
    return hashed.agg(F.count("*").alias("n_rows"), F.countDistinct("row_hash", "quantity", "discount", "tax", "line").alias("n_distinct"))


MD5 = "CAST(('0x' || substr(md5(concat(CAST({k} AS VARCHAR), ':42')), 1, 8)) AS BIGINT) / 4294967296.0"


@query("SMP-01", f"SELECT o_orderkey FROM orders WHERE {MD5.format(k='o_orderkey')} < 0.25")
def smp_01(spark, d):
    return S.bernoulli(spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey"), 0.25).select("o_orderkey")


@query("SMP-02", "SELECT * FROM (VALUES (1000, 1000), (6500000, 6500000), (63000000, 6000000)) t(n_rows, n_sample)")
def smp_02(spark, d):
    return spark.createDataFrame([(n, S.spearman_rows(n)) for n in (1000, 6_500_000, 63_000_000)], "n_rows int, n_sample int")


@query("SMP-03", f"WITH {SPLIT} SELECT okey, lnum, pkey, skey, cohort, split FROM s")
def smp_03(spark, d):
    return _split(spark, d).select("okey", "lnum", "pkey", "skey", "cohort", "split")


@query("SMP-04", f"WITH {cte('line')}, g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {LONGKEYS}) - 1 AS g, count(*) OVER (PARTITION BY family) AS n FROM line), f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY g) AS r FROM g WHERE g % greatest(1, n // 300) = 0) SELECT okey, lnum, pkey, skey, family FROM f WHERE r <= 300")
def smp_04(spark, d):
    return S.stride_cap(view(spark, d, "line"), "family", ORDER, 300).select("okey", "lnum", "pkey", "skey", "family")


KEY = "concat_ws('-', okey, lnum, pkey, skey)"
RCAP = "WITH {v}, h AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat({key}, ':42'))) AS r FROM {n}) SELECT okey, lnum, pkey, skey, {by} FROM h WHERE r <= {cap}"


@query("SMP-05", RCAP.format(v=cte("line"), by="family", key=KEY, n="line", cap=500))
def smp_05(spark, d):
    return S.random_cap(view(spark, d, "line"), ["family"], F.expr(KEY), 500).select("okey", "lnum", "pkey", "skey", "family")


@query("SMP-06", RCAP.format(v=cte("line"), by="cohort", key=KEY, n="line", cap=1000))
def smp_06(spark, d):
    return S.random_cap(view(spark, d, "line"), ["cohort"], F.expr(KEY), 1000).select("okey", "lnum", "pkey", "skey", "cohort")


@query("SMP-07", f"WITH {SPLIT} SELECT cohort, family, split, count(*) AS n FROM s GROUP BY 1, 2, 3")
def smp_07(spark, d):
    return _split(spark, d).groupBy("cohort", "family", "split").agg(F.count("*").alias("n"))


@query("SMP-09")
def smp_09(spark, d):
    """A seed for each feature name."""
    return view(spark, d, "feat").select("feature", S.feature_seed(F.col("feature")).alias("seed"))


@query("AGG-01", f"""WITH {DEDUP}, x AS (SELECT 'raw' AS stage, cohort, coalesce({family_sql('label')}, 'unmapped') AS family FROM dirty
UNION ALL SELECT 'clean', cohort, coalesce({family_sql('label')}, 'unmapped') FROM c UNION ALL SELECT 'dedup', cohort, coalesce({family_sql('label')}, 'unmapped') FROM d
UNION ALL SELECT 'final', cohort, family FROM k) SELECT stage, coalesce(cohort, 'ALL') AS cohort, coalesce(family, 'ALL') AS family, count(*) AS n FROM x GROUP BY GROUPING SETS ((stage, cohort, family), (stage, cohort), (stage))""")
def agg_01(spark, d):
    """The row funnel: families and totals after each stage."""
    raw = view(spark, d, "dirty")
    fam = F.coalesce(C.family(F.col("label")), F.lit("unmapped")).alias("family")
    stages = [
        raw.select(F.lit("raw").alias("stage"), "cohort", fam), C.clean(raw, NUM).select(F.lit("clean"), "cohort", fam),
        _deduped(spark, d).select(F.lit("dedup"), "cohort", fam), _kept(spark, d).select(F.lit("final"), "cohort", "family"),
    ]
    x = stages[0]
    for s in stages[1:]:
        x = x.union(s)
    return x.groupingSets([["stage", "cohort", "family"], ["stage", "cohort"], ["stage"]], "stage", "cohort", "family").agg(F.count("*").alias("n")).select("stage", F.coalesce("cohort", F.lit("ALL")).alias("cohort"), F.coalesce("family", F.lit("ALL")).alias("family"), "n")


@query("AGG-02", f"WITH {SPLIT} SELECT cohort, split, code, count(*) AS n FROM s GROUP BY 1, 2, 3")
def agg_02(spark, d):
    return _split(spark, d).groupBy("cohort", "split", "code").agg(F.count("*").alias("n"))


@query("AGG-03", f"WITH {SPLIT} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale FROM s WHERE split = 'train' AND cohort = 'A'" for f in FEATURES))
def agg_03(spark, d):
    return S.scaler(_split(spark, d).where("split = 'train' and cohort = 'A'"), FEATURES).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("AGG-04", f"WITH {SPLIT}, z AS (" + " UNION ALL ".join(f"SELECT avg(z) AS m, stddev_pop(z) AS sd FROM (SELECT ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z FROM s WHERE split = 'train' AND cohort = 'A')" for f in FEATURES) + ") SELECT round(max(abs(m)), 4) AS max_abs_mean, round(min(sd), 4) AS min_sd, round(max(sd), 4) AS max_sd FROM z")
def agg_04(spark, d):
    """Moments of the scaled training rows."""
    train = _split(spark, d).where("split = 'train' and cohort = 'A'")
    z = S.scale(train, FEATURES, S.scaler(train, FEATURES))
    m = S.scaler(z, FEATURES)
    return m.agg(F.round(F.max(F.abs("mean")), 4).alias("max_abs_mean"), F.round(F.min("scale"), 4).alias("min_sd"), F.round(F.max("scale"), 4).alias("max_sd"))


@query("AGG-08", f"WITH {SPLIT}, p AS (SELECT cohort, avg(CAST(y AS DOUBLE)) AS p FROM s WHERE split = 'train' GROUP BY 1) SELECT round(max(CASE cohort WHEN 'A' THEN p END), 6) AS p_a, round(max(CASE cohort WHEN 'B' THEN p END), 6) AS p_b, CASE WHEN max(p) - min(p) > 0.10 THEN 'LARGE' WHEN max(p) - min(p) > 0.05 THEN 'MODERATE' ELSE 'SMALL' END AS severity FROM p")
def agg_08(spark, d):
    from ..operators.cross import prior_shift

    return prior_shift(_split(spark, d).where("split = 'train'"))


@query("SET-01", f"WITH {cte('line')} SELECT CAST(lnum AS DOUBLE) AS v FROM line WHERE cohort = 'A' UNION ALL SELECT tax FROM line WHERE cohort = 'B'")
def set_01(spark, d):
    v = view(spark, d, "line")
    return files.stack_shards([v.where("cohort = 'A'").select(F.col("lnum").alias("v")), v.where("cohort = 'B'").select(F.col("tax").alias("v"))])


@query("SET-02", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_02(spark, d):
    from ..operators.overlap import set_sides

    v = spark.read.parquet(f"{d}/lineitem.parquet")
    return set_sides(v.where("l_returnflag = 'A'").select("l_partkey"), v.where("l_returnflag = 'R'").select("l_partkey"))


@query("SET-03", f"WITH {cte('dirty')} SELECT DISTINCT label FROM dirty")
def set_03(spark, d):
    return view(spark, d, "dirty").select("label").distinct()


@query("WIN-01", f"WITH {cte('line')} SELECT okey, lnum, pkey, skey, row_number() OVER (PARTITION BY family ORDER BY {LONGKEYS}) - 1 AS g FROM line")
def win_01(spark, d):
    return S.running_index(view(spark, d, "line"), ["family"], ORDER).select("okey", "lnum", "pkey", "skey", "g")
