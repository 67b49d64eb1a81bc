"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, and over how many tasks each is to be spread.

    One pass with a sketch of bounded size, which has every such key; its counts are estimates, good enough to choose
    a number of tasks. There can be at most ``1 / share`` keys, whatever the data: the result may be broadcast.
    """
    most = int(1 / max(share, 1e-5))
    # a sketch of t items is wrong by less than 4 / t of all rows
    tracked = min(1_000_000, 20 * most)
    held = F.col(key).isNotNull()
    sketch = rows.filter(held).agg(F.count("*").alias("_total"), F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(tracked)).alias("_top"))
    top = sketch.select("_total", F.explode("_top").alias("_t")).select("_total", F.col("_t.item").alias(key), F.col("_t.count").alias("_n"))
    hot = top.filter(F.col("_n") > F.col("_total") * F.lit(share))
    return hot.select(key, F.ceil(F.col("_n") / (F.col("_total") * F.lit(share))).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", salts: int | None = None, share: float = HOT_SHARE) -> DataFrame:
    """Join a possibly skewed ``left`` with ``right``.

    Left rows of a hot key are spread by a hash of the whole row over so many tasks that each gets about
    ``share`` of all rows, and the right rows of that key are repeated once per task; all other keys are
    joined as they are. All hot keys together are spread over ``2 / share`` tasks at most; ``salts`` sets
    the number for each instead. A hash gives the same salt when a task is retried, which a random
    number does not.

    Neither side is broadcast, however small its files are: sizes are those of compressed columns, and repeated rows
    that take a few MB there have filled the driver.
    """
    hot = hot_keys(left, on, share)
    hot = F.broadcast(hot if salts is None else hot.withColumn("_salts", F.lit(salts)))
    # maps and variants have no hash
    hashed = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("_salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = left.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return spread.join(repeated.hint("merge"), [on, "_salt"], how).drop("_salt")
