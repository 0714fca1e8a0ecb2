"""Session and plan helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lumarank", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LUMARANK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).parent
    bundle = Path(tempfile.mkdtemp(prefix="lumarank-")) / "lumarank.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(bundle))  # the driver hands it out; it is no shared folder


def table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``root/name.parquet``, pruned to ``columns``."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; set one of this machine only where none
    is set and no other machine takes part."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lumarank-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint: computed once, survives lost executors."""
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition before a CPU-bound stage, only where the scan has fewer splits than twice the cores.

    At scale the scan has far more splits than cores and the plan stays shuffle-free.
    """
    spark = df.sparkSession
    want = 2 * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def half_up(x: Column, digits: int = 2) -> Column:
    """The rounding of scores: to the nearest by the exact binary value, exact ties to even.

    Scores have two places and are rounded at every layer, so what looks like a tie matters:
    the error of ``x * 100`` is computed exactly (both halves of a split x times 100 are exact)
    and decides where the product lands on .5. Values of more places are ``reported``.
    """
    if digits != 2:
        return reported(x, digits)
    # binds x once: repeated in the formula, nested scores would outgrow generated code
    return F.transform(F.array(x), two_places)[0]


def two_places(v: Column) -> Column:
    """The formula of ``half_up`` to two places, for a column that has a name; it reads ``v`` many times."""
    p = v * 100.0
    high = v * 134217729.0 - (v * 134217729.0 - v)
    error = (high * 100.0 - p) + (v - high) * 100.0
    low, part = F.floor(p), p - F.floor(p)
    up = F.when(part != 0.5, part > 0.5).when(error != 0, error > 0).otherwise(low % 2 != 0)
    return F.when(p.isNotNull(), (low + F.when(up, 1).otherwise(0)) / 100.0)


def _two_places_text(v: str) -> str:
    """``two_places`` of a named column as an expression's text, which is built by one call."""
    p = f"({v} * 100D)"
    high = f"({v} * 134217729D - ({v} * 134217729D - {v}))"
    error = f"(({high} * 100D - {p}) + ({v} - {high}) * 100D)"
    part = f"({p} - floor({p}))"
    up = f"CASE WHEN {part} <> 0.5D THEN {part} > 0.5D WHEN {error} <> 0D THEN {error} > 0D ELSE floor({p}) % 2 <> 0 END"
    return f"CASE WHEN {p} IS NOT NULL THEN (floor({p}) + CASE WHEN {up} THEN 1 ELSE 0 END) / 100D END"


def rounded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns rounded to two places as ``half_up`` does, in generated code.

    A projection gives each value a name and the next one rounds it; the optimizer keeps the two
    apart, as the formula reads the value many times.
    """
    named = df.withColumns({f"__raw_{name}": x.cast("double") for name, x in columns.items()})
    return named.withColumns({name: F.expr(_two_places_text(f"`__raw_{name}`")) for name in columns}).drop(*[f"__raw_{name}" for name in columns])


def reported(x: Column, digits: int = 2) -> Column:
    """Half up, for results that depend on the order of a sum: what misses a tie by less than 1e-7 is one."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5000001)) / F.lit(scale)


def strip_blanks(x: Column) -> Column:
    """``x`` without outer white space of any kind."""
    return F.regexp_replace(x, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` (nulls lowest, ties by ``keep``).

    A single aggregation with map-side combine; repeated rows collapse before the shuffle.
    """
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    top = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(packed).alias("__top"))
    return top.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"__top.k{i}").alias(c) for i, c in enumerate(keep)])
