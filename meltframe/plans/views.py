"""Alloy views over the driver's tables, so that every query works on whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltframe.functions import columns as C
from meltframe.functions import text as T
from meltframe.operators import composition as comp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, elem_idx, amount) per order line: order = alloy, part bucket = element, quantity = amount.

    Lines of one order that fall in the same bucket are left to add up in whatever aggregation follows.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        (F.col("l_partkey") % 32).cast("int").alias("elem_idx"),
        F.col("l_quantity").cast("bigint").alias("amount"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.to_wide(raw_amounts(spark, sf_dir))


def composition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.to_long(wide(spark, sf_dir)).withColumn("amount", F.col("amount").cast("bigint"))


# The processing notes every record points to with phrase_id, with the class expected for each.
PHRASES_SQL = """
 (0,'Arc melting',1),(1,'arc melting+annealed at 1473K',3),(2,'laser cladding 3 mm/s',5),
 (3,'milled for 5h',4),(4,'Vacuum arc melting',1),(5,'cast + cold rolled + annealed',6),
 (6,'cryo-rolled',7),(7,'SPS sintering',4),(8,'SLM',5),(9,'artificial aging',3),
 (10,'age hardened',2),(11,'precipitation hardening',2),(12,'homogenized 1200 °C',3),
 (13,'powder laser deposition',4),(14,'HIP',6),(15,'missing',1),(16,'0',1),(17,'',1),
 (18,CAST(NULL AS STRING),1),(19,'unknown route',1),(20,'Controlled cooling',6),
 (21,'plasma spray + heat treatment',5),(22,'suction cast',1),(23,'remelted twice',3)
"""

# One record per order, with zeros, negatives and NULLs; the same text runs in DuckDB.
RECORD_SQL = {
    "row_id": "o_orderkey",
    "domain": "CASE WHEN o_orderstatus = 'F' THEN 'corrosion' ELSE 'mechanical' END",
    "electrolyte": """CASE WHEN o_orderstatus <> 'F' THEN NULL
       WHEN o_custkey % 10 = 0 THEN 'NaCl' WHEN o_custkey % 10 = 1 THEN 'H2SO4'
       WHEN o_custkey % 10 = 2 THEN 'Seawater' WHEN o_custkey % 10 = 3 THEN 'HNO3'
       WHEN o_custkey % 10 = 4 THEN 'NaOH' WHEN o_custkey % 10 = 5 THEN 'HCl'
       WHEN o_custkey % 10 = 6 THEN 'KOH' WHEN o_custkey % 10 = 7 THEN 'PBS'
       WHEN o_custkey % 10 = 8 THEN 'Hanks' ELSE NULL END""",
    "concentration_m": """CASE WHEN o_orderstatus <> 'F' OR o_custkey % 10 = 9 THEN NULL
       ELSE CAST(o_custkey % 120 + 1 AS DOUBLE) / 20 END""",
    "phrase_id": "CAST(o_orderkey % 24 AS INT)",
    "hardness": """CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(FLOOR(o_totalprice / 100) AS DOUBLE) END""",
    "yield_mpa": """CASE WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 0 THEN NULL
       WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(FLOOR(o_totalprice / 80) AS DOUBLE) END""",
    "tensile_mpa": """CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 THEN NULL
       ELSE CAST(FLOOR(o_totalprice / 70) AS DOUBLE) END""",
    "elongation_pct": """CASE WHEN o_orderstatus = 'F' OR o_orderkey % 6 = 0 THEN NULL
       ELSE CAST(o_custkey % 120 AS DOUBLE) END""",
    "ecorr_mv": """CASE WHEN o_orderstatus <> 'F' THEN NULL
       ELSE CAST(FLOOR(o_totalprice / 100) AS DOUBLE) - 2500 END""",
    "epit_mv": """CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 8 = 0 THEN NULL
       ELSE CAST(FLOOR(o_totalprice / 90) AS DOUBLE) - 1500 END""",
    "icorr": """CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE)
       WHEN o_orderkey % 11 = 0 THEN CAST(-1 AS DOUBLE)
       ELSE CAST(FLOOR(o_totalprice) AS DOUBLE) / 10000 END""",
    "fcc": "CAST(o_orderkey % 2 AS INT)",
    "bcc": "CAST(o_custkey % 2 AS INT)",
    "hcp": "CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
    "im": "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END",
}


def alloy_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{sql} AS {name}" for name, sql in RECORD_SQL.items()])


def phrases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {PHRASES_SQL} AS p(phrase_id, phrase, expected_class)")


def noted_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their processing note (24 notes, broadcast)."""
    return alloy_record(spark, sf_dir).join(F.broadcast(phrases(spark)), "phrase_id", "left")


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record + composition + parameters + flags: all model inputs and targets of one alloy in one row.

    Entropy and omega are rounded as they are stored, so their last bits do not depend on the math library.
    """
    amounts = comp.with_params(wide(spark, sf_dir))
    amounts = amounts.withColumns({n: F.round(n, 6) for n in ("entropy", "omega")})
    computed = [c for c in amounts.columns if c != "row_id"]
    # the few columns of an order are moved to its amounts; the many of a record are derived where they meet
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    met = orders.join(amounts, F.col("o_orderkey") == F.col("row_id"), "left").drop("row_id")
    record = met.selectExpr(*[f"{sql} AS {name}" for name, sql in RECORD_SQL.items()], *computed)
    record = record.join(F.broadcast(phrases(spark)), "phrase_id", "left").withColumn("process_class", T.process_class(F.col("phrase")))
    record = C.prepare_targets(C.add_test_environment(record.withColumns(C.process_flags())))
    # a record without composition keeps its row: no amounts, parameters of an empty alloy
    rest = [c for c in record.columns if c not in {"row_id", *computed}]
    return record.select("row_id", *rest, *computed).na.fill(0.0, subset=computed)


def objective_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_retailprice AS o1", "CAST(-p_size AS BIGINT) AS o2", "(p_partkey * 7919) % 1000 AS o3"
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey % 5 AS fold",
        "CASE l_returnflag WHEN 'A' THEN 'Hardness (HVN)' WHEN 'N' THEN 'Elongation (%)' ELSE 'icorr (log10)' END AS property",
        "CAST(FLOOR(l_extendedprice) AS BIGINT) AS truth", "CAST(l_quantity AS BIGINT) * 2000 AS guess",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate vectors: 39 whole non-negative entries, 32 element amounts then 7 process scores.

    The 64 entries of a vector fold onto the 39: entry 40 adds to the first, 64 to the twenty-fifth.
    """
    whole = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000000).cast("bigint"))
    folded = F.zip_with(F.slice(whole, 1, 39), F.slice(whole, 40, 39), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), folded.alias("raw"))


def candidates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.wide_from_array(candidates(spark, sf_dir), "raw")
