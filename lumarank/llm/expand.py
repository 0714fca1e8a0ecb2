"""Members of classes of equal values: joins of classes with their members that no hot class
brings into one task. A class of more than CLASS_BLOCK members is spread over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumarank.runtime import cut

#: Members of a class that one task joins, about; larger classes are spread over blocks of so many.
CLASS_BLOCK = 5000
#: Rows up to which the table of large classes is broadcast; beyond, it is joined by sorting.
BROADCAST_ROWS = 100_000


class Blocks:
    """The classes of ``members`` with more than ``size`` of them, and the number of their blocks."""

    def __init__(self, members: DataFrame, key: str, size: int = CLASS_BLOCK, classes: DataFrame | None = None):
        self.key, self.members = key, members
        #: ``(key, copies)`` of all classes
        self.classes = cut(members.groupBy(key).agg(F.count("*").alias("copies"))) if classes is None else classes
        large = self.classes.filter(F.col("copies") > size).select(F.col(key).alias("__large"), F.ceil(F.col("copies") / size).cast("int").alias("__blocks"))
        found = large.count()
        self.large = None if not found else F.broadcast(large) if found <= BROADCAST_ROWS else large.hint("merge")

    def _joined(self, df: DataFrame, key: str) -> DataFrame:
        if self.large is None:
            return df.withColumn("__blocks", F.lit(1))
        return df.join(self.large, F.col(key) == F.col("__large"), "left").drop("__large").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))

    def placed(self, item: str) -> DataFrame:
        """Every member with the block of its class it belongs to."""
        return self._joined(self.members, self.key).withColumn("block", F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int")).drop("__blocks")

    def repeated(self, df: DataFrame, key: str) -> DataFrame:
        """Every row of ``df`` once per block of the class in its column ``key``."""
        return self._joined(df, key).withColumn("block", F.explode(F.expr("sequence(0, __blocks - 1)"))).drop("__blocks")


def expand_pairs(pairs: DataFrame, left: Blocks, right: Blocks, item: str) -> DataFrame:
    """``(a, b, p, q)``: for each pair ``(a, b)`` of classes every member p of a in ``left`` with every q of b in ``right``."""
    p = left.placed(item).select(F.col(left.key).alias("a"), "block", F.col(item).alias("p"))
    q = right.placed(item).select(F.col(right.key).alias("b"), "block", F.col(item).alias("q"))
    half = left.repeated(pairs.select("a", "b"), "a").join(p.hint("merge"), ["a", "block"]).select("a", "b", "p")
    return right.repeated(half, "b").join(q.hint("merge"), ["b", "block"]).select("a", "b", "p", "q")
