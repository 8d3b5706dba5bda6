"""Profiles that inherit from one another: arrays override their parent's element by element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint


def inherited(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values (name, at, value) with what each profile inherits, and profiles without an end to their line (name, issue).

    `profiles` are (name, parent or null, values: array). A chain that comes back to itself is a Cycle, one to a name
    that is not there Missing; neither has values. Each round doubles the distance that a profile looks up, with what
    lies on the way laid one over the other, so no profile has more rows than its values. A round in which no line
    comes to its end is the last: what then remains goes round.
    """
    lines = checkpoint(profiles.select("name", F.col("parent").alias("over")))
    known = lines.select(F.col("name").alias("over"), F.lit(True).alias("known"))
    lines = checkpoint(lines.join(known, "over", "left").select("name", F.when(F.col("known"), F.col("over")).alias("over"), F.when(F.col("over").isNull(), "well").when(F.col("known").isNull(), "Missing").alias("end")))
    ended, going = lines.where("end is not null").select("name", "end"), lines.where("end is null").select("name", "over")
    jumps = []
    while True:
        jumps.append(going)
        up = going.select(F.col("name").alias("over"), F.col("over").alias("far")).join(ended.select(F.col("name").alias("over"), "end"), "over", "full")
        step = checkpoint(going.join(up, "over").select("name", F.col("far").alias("over"), "end"))
        found = step.where("end is not null").select("name", "end")
        if found.isEmpty():
            break
        ended, going = checkpoint(ended.unionByName(found)), step.where("end is null").select("name", "over")
    well = checkpoint(ended.where("end = 'well'").select("name"))
    values = profiles.join(well, "name", "left_semi").select("name", F.posexplode("values").alias("at", "value")).withColumn("own", F.lit(True))
    for jump in jumps[:-1]:
        above = values.select(F.col("name").alias("over"), "at", F.col("value").alias("high"))
        held = jump.join(well, "name", "left_semi").join(above, "over").select("name", "at", "high")
        both = values.join(held, ["name", "at"], "full").select("name", "at", F.when(F.col("own"), F.col("value")).otherwise(F.col("high")).alias("value"))
        values = checkpoint(both.withColumn("own", F.lit(True)))
    turned = profiles.select("name").join(ended, "name", "left_anti").select("name", F.lit("Cycle").alias("issue"))
    return values.drop("own"), ended.where("end = 'Missing'").select("name", F.col("end").alias("issue")).unionByName(turned)
