"""Hash embeddings of texts and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the 32-bit FNV-1a hash.
OFFSET, PRIME, WORD = 2166136261, 16777619, 4294967295


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a hash of an ASCII token, in 64-bit arithmetic."""
    chars = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(chars, F.lit(OFFSET).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * PRIME).bitwiseAND(F.lit(WORD)))


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = 128) -> DataFrame:
    """(key, bucket, weight): normalised sparse embedding; each token adds 1 to one bucket and 0.5 to another. Texts without tokens have no rows."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"\W+"), lambda t: t != "")
    each = df.where(F.col(text).isNotNull()).select(key, F.explode(tokens).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("n")).withColumn("h", fnv1a(F.col("t")))
    second = F.shiftright("h", 16).bitwiseXOR(F.col("h").bitwiseAND(F.lit(65535))) % dimensions
    parts = F.array(F.struct((F.col("h") % dimensions).alias("bucket"), F.col("n").cast("double").alias("w")), F.struct(second.alias("bucket"), (F.col("n") * 0.5).alias("w")))
    sums = each.select(key, F.explode(parts).alias("p")).groupBy(key, F.col("p.bucket").alias("bucket")).agg(F.sum("p.w").alias("w"))
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norm, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """The left rows with the right side's ``values`` as of their time: from the right row of the same key with the greatest time before theirs. One sort per key and
    no pairs: both sides are put in one order and the last right row is carried on. Right rows at the same time count the greatest."""
    held = F.struct(at, *values)
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_r"), F.lit(0).alias("_side"))
    b = right.groupBy(*keys, at).agg(F.max(held).alias("_r")).withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_c", F.last("_r", True).over(w)).where("_side = 0")
    return carried.select(*cols, *(F.col(f"_c.{v}").alias(f"{v}_as_of") for v in values))
