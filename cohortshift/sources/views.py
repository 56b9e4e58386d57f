"""Cohort views over the provided tables. The expressions are ones that Spark and other SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINE = {
    "okey": "l_orderkey", "lnum": "CAST(l_linenumber AS BIGINT)", "pkey": "l_partkey", "skey": "l_suppkey",
    "cohort": "CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'A' ELSE 'B' END",
    "family": "CASE l_returnflag WHEN 'N' THEN 'Benign' WHEN 'A' THEN 'DoS' ELSE 'Botnet' END",
    "y": "CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END",
    "quantity": "CAST(l_quantity AS DOUBLE)", "price": "CAST(l_extendedprice AS DOUBLE)", "discount": "CAST(l_discount AS DOUBLE)",
    "tax": "CAST(l_tax AS DOUBLE)", "line": "CAST(l_linenumber AS DOUBLE)", "unit": "CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)",
}
FEATURES = ["quantity", "price", "discount", "tax", "line", "unit"]
ORDER = ["okey", "lnum", "pkey", "skey", "quantity", "price"]
DIRTY = {
    "id": "l_orderkey * 10 + l_linenumber",
    "okey": "l_orderkey", "lnum": "CAST(l_linenumber AS BIGINT)", "pkey": "l_partkey", "skey": "l_suppkey",
    "cohort": LINE["cohort"],
    "label": "CASE WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_orderkey % 59 = 0 THEN 'Heartbleed' WHEN l_orderkey % 53 = 0 THEN 'DoS Hulk - Attempted'"
    " WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN ' BENIGN ' WHEN l_returnflag = 'N' THEN 'Benign' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'DoS new variant'"
    " WHEN l_returnflag = 'A' THEN 'DoS Hulk' WHEN l_linenumber = 3 THEN 'Web Attack - XSS' WHEN l_linenumber = 4 THEN 'SSH-Patator' WHEN l_orderkey % 577 = 0 THEN 'PortScan' ELSE 'Bot' END",
    "quantity": "CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END",
    "price": "CASE WHEN l_orderkey % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END",
    "discount": "CAST(l_discount AS DOUBLE)",
    "duration": "CASE WHEN l_orderkey % 7 = 0 THEN 0e0 ELSE CAST(l_tax AS DOUBLE) END",
}
#: Planted effects in cohort B: location (quantity), scale (price), flip by label (discount), none (tax), zero-heavy with a moved tail (zero), sentinel (code).
DRIFT = {
    **{k: LINE[k] for k in ("okey", "lnum", "pkey", "skey", "cohort", "family", "y")},
    "quantity": f"CAST(l_quantity AS DOUBLE) + CASE WHEN {LINE['cohort']} = 'B' THEN 10 ELSE 0 END",
    "price": f"CAST(l_extendedprice AS DOUBLE) * CASE WHEN {LINE['cohort']} = 'B' THEN 2 ELSE 1 END",
    "discount": f"CAST(l_discount AS DOUBLE) + (CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) * (CASE WHEN {LINE['cohort']} = 'B' THEN -1 ELSE 1 END)",
    "tax": "CAST(l_tax AS DOUBLE)",
    "zero": f"CASE WHEN l_linenumber <= 2 THEN 0e0 ELSE CAST(l_quantity AS DOUBLE) * (CASE WHEN {LINE['cohort']} = 'B' THEN 3 ELSE 1 END) END",
    "code": "CASE WHEN l_orderkey % 9 = 0 THEN -1e0 ELSE CAST(l_linenumber AS DOUBLE) END",
}
DRIFT_FEATURES = ["quantity", "price", "discount", "tax", "zero", "code"]


def _mod(a: int, m: int) -> str:
    return f"CAST((p_partkey * {a}) % {m} AS DOUBLE) / {m}"


#: One row for each part, read as a feature with its importances, drift and separation in both cohorts.
FEATURE_TABLE = {
    "k": "p_partkey", "feature": "concat('f', p_partkey)",
    "imp_a": f"CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE {_mod(37, 101)} END", "imp_b": f"CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE {_mod(41, 103)} END",
    "perm_a": _mod(43, 107), "perm_b": _mod(47, 109),
    "cal": f"CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {_mod(53, 97)} * 1.2e0 - 0.3e0 END", "raw": f"0.5e0 + {_mod(53, 97)} / 2", "null_floor": f"0.5e0 + {_mod(59, 83)} / 10",
    "stab": f"{_mod(71, 89)} * 1.6e0 - 0.6e0",
    "sep_a": f"0.5e0 + {_mod(29, 79)} / 2", "sep_b": f"0.5e0 + {_mod(31, 73)} / 2", "mi_a": f"{_mod(61, 71)} * 0.3e0", "mi_b": f"{_mod(67, 67 + 2)} * 0.3e0",
    "dir_a": "CAST(p_partkey % 3 AS INT) - 1", "dir_b": "CAST((p_partkey * 5 + p_size) % 3 AS INT) - 1",
    "levels_a": "p_size", "levels_b": "CAST((p_size * 7) % 60 AS INT)", "modes_a": "CAST(p_partkey % 3 AS INT) + 1", "modes_b": "CAST(p_size % 2 AS INT) + 1",
    "benign": f"0.5e0 + {_mod(11, 59)} / 2", "attack": f"0.5e0 + {_mod(13, 61)} / 2", "dos": f"0.5e0 + {_mod(17, 53)} / 2",
    "family": "CASE p_size % 4 WHEN 0 THEN 'DoS' WHEN 1 THEN 'Botnet' WHEN 2 THEN 'DDoS' ELSE 'PortScan' END",
    "grp": "p_brand", "wins": "CAST(p_partkey % 2 AS INT)",
}
#: Scores of lineitems as a rule-based binary model, and a three-class prediction.
SCORED = {
    **{k: LINE[k] for k in ("okey", "lnum", "pkey", "skey", "cohort", "y", "family")},
    "score": "CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 100 AS DOUBLE) / 200 + CASE WHEN l_returnflag = 'N' THEN 0e0 ELSE 0.5e0 END * CAST(l_quantity AS DOUBLE) / 50",
    "truth": "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END", "pred": "CASE WHEN l_partkey % 5 < 3 THEN CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END ELSE CAST(l_suppkey % 3 AS INT) END",
}
#: One row for each order, read as an ablation run.
ABLATION = {
    "run": "o_orderkey", "policy": "CASE o_orderkey % 3 WHEN 0 THEN 'top_importance' WHEN 1 THEN 'axis1_stable' ELSE 'axis2_stable' END",
    "direction": "CASE WHEN o_custkey % 2 = 0 THEN 'A_to_B' ELSE 'B_to_A' END", "kk": "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE 50 END",
    "seed": "42 + CAST(o_orderkey % 7 AS INT)", "f1": "CAST((o_orderkey * 31 + o_custkey * 17) % 997 AS DOUBLE) / 997",
}
#: Columns with planted redundancy: two linear copies, one monotone copy, one that is redundant in cohort A only.
REDUNDANT = {
    **{k: LINE[k] for k in ("okey", "lnum", "pkey", "skey", "cohort", "family", "y")},
    "quantity": LINE["quantity"], "twice": "CAST(l_quantity AS DOUBLE) * 2 + CAST(l_tax AS DOUBLE)", "mono": "exp(CAST(l_quantity AS DOUBLE) / 4)",
    "price": LINE["price"], "cents": "CAST(l_extendedprice AS DOUBLE) * 100 + CAST(l_discount AS DOUBLE)",
    "local": f"CASE WHEN {LINE['cohort']} = 'A' THEN CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) * 7 + CAST(l_tax AS DOUBLE) END", "tax": LINE["tax"],
}
REDUNDANT_FEATURES = ["cents", "local", "mono", "price", "quantity", "tax", "twice"]

SOURCES = {"red": ("lineitem", REDUNDANT), "line": ("lineitem", LINE), "dirty": ("lineitem", DIRTY), "drift": ("lineitem", DRIFT), "feat": ("part", FEATURE_TABLE), "scored": ("lineitem", SCORED), "abl": ("orders", ABLATION)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = SOURCES[name]
    out = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
    return out.unionByName(out.where("okey % 31 = 0")) if name == "dirty" else out


def cte(name: str) -> str:
    """The same view as a common table expression."""
    table, columns = SOURCES[name]
    body = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"
    return f"{name} AS ({body} UNION ALL SELECT * FROM ({body}) t WHERE okey % 31 = 0)" if name == "dirty" else f"{name} AS ({body})"


def long_view(spark: SparkSession, sf_dir: str, name: str = "drift", features: list[str] | None = None) -> DataFrame:
    """(cohort, family, y, feature, value): the wide view unpivoted once."""
    features = features or (DRIFT_FEATURES if name == "drift" else FEATURES)
    pairs = ", ".join(f"'{f}', {f}" for f in features)
    return view(spark, sf_dir, name).selectExpr("okey", "lnum", "pkey", "skey", "cohort", "family", "y", f"stack({len(features)}, {pairs}) AS (feature, value)")


def long_cte(name: str = "drift", features: list[str] | None = None) -> str:
    features = features or (DRIFT_FEATURES if name == "drift" else FEATURES)
    parts = " UNION ALL ".join(f"SELECT okey, lnum, pkey, skey, cohort, family, y, '{f}' AS feature, {f} AS value FROM {name}" for f in features)
    return f"{cte(name)}, long AS ({parts})"
