"""New codes for chosen names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CODE = r"^b_(\d+)mp$"


def highest(brands: DataFrame) -> DataFrame:
    """The greatest number of a code ``b_<number>mp``, exact to 38 digits; null if there is none."""
    return brands.agg(F.max(F.regexp_extract(F.when(F.col("code").rlike(CODE), F.col("code")), CODE, 1).cast("decimal(38,0)")).alias("highest"))


def allocate(chosen: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, brand, code): codes count on from the greatest in the catalogue, in the order of ids.

    Numbers above the greatest are free by definition, but for one: a code that differs in leading zeros holds another
    number.  So no anti join with the catalogue is left to do; the window runs over the chosen names alone.
    """
    top = highest(brands).first()["highest"]
    if top is None:
        raise ValueError("The catalogue has no code of the form b_<number>mp; nothing was written.")
    n = F.row_number().over(Window.orderBy("id"))
    rows = chosen.withColumn("code", F.concat(F.lit("b_"), (F.lit(top).cast("decimal(38,0)") + n).cast("decimal(38,0)").cast("string"), F.lit("mp")))
    return rows.select("id", "brand", "code")
