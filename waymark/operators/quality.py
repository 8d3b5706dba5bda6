"""Data-quality validators: each yields rows (code, severity, uid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZERO_M, TELEPORT_M = 0.01, 2000.0


def issues(rows: DataFrame, code: str, severity: str, uid: str | Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.col(uid) if isinstance(uid, str) else uid).cast("long").alias("uid"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its keys."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn > 1").drop("rn")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return issues(repeats(edges, ["src", "dst"], ["edge_id"]), "STRUCT_DUP_EDGE", "Warning", "edge_id")


def self_loops(edges: DataFrame) -> DataFrame:
    return issues(edges.where("src = dst"), "STRUCT_SELF_LOOP", "Error", "edge_id")


def broken_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose start or end is no node."""
    known = nodes.select("uid")
    return together(
        issues(edges.join(known, edges.src == known.uid, "left_anti"), "REF_BROKEN_START", "Error", "edge_id"),
        issues(edges.join(known, edges.dst == known.uid, "left_anti"), "REF_BROKEN_END", "Error", "edge_id"),
    )


def geometry_issues(rows: DataFrame, uid: str, length: str) -> DataFrame:
    """Lengths that are no number, nought or too long."""
    m = F.col(length)
    code = F.when(m.isNull() | F.isnan(m), "GEOM_NAN").when(m < ZERO_M, "GEOM_ZERO_LENGTH").when(m > TELEPORT_M, "GEOM_TELEPORT")
    return rows.select(code.alias("code"), F.when(code == "GEOM_NAN", "Error").otherwise("Warning").alias("severity"), F.col(uid).cast("long").alias("uid")).where("code is not null")


def dead_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Start nodes of roads that no edge leads to."""
    entered = edges.select("dst").distinct()
    starts = edges.where("kind = 0").select("src").distinct()
    return issues(starts.join(entered, starts.src == entered.dst, "left_anti"), "CONN_ONEWAY_DEAD_END", "Info", "src")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


def isolated_transit(edges: DataFrame) -> DataFrame:
    """Ends of transit edges that no road or junction touches."""
    def ends(e: DataFrame) -> DataFrame:
        return e.select(F.col("src").alias("uid")).union(e.select("dst")).distinct()

    return ends(edges.where("kind in (2, 3)")).join(ends(edges.where("kind in (0, 1)")), "uid", "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, copies counted."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
