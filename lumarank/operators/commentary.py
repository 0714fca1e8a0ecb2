"""Commentary from scores: weak dimensions, scenes, prompts and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumarank.operators.ranking import positions
from lumarank.constants import DIM_LABELS_EN, DIM_LABELS_ZH
from lumarank.functions import text as X


def dim_names(dims: Column, language: str = "zh") -> Column:
    """Labels of an array of dimensions, joined as a list in prose."""
    labels = F.transform(dims, lambda d: X.label_of(d, DIM_LABELS_EN if language == "en" else DIM_LABELS_ZH))
    if language != "en":
        return F.when(F.size(dims) == 0, "整体完成度").otherwise(F.array_join(labels, "和"))
    n = F.size(labels)
    most = F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(labels, n)
    return F.when(n == 0, "overall quality").when(n == 1, last).when(n == 2, F.concat(labels[0], F.lit(" and "), labels[1])).otherwise(F.concat(most, F.lit(", and "), last))


def dominant(df: DataFrame, group: Sequence[str], value: str, order: str, limit: int) -> DataFrame:
    """``(group..., value, k)``: the most frequent values of each group, ties to the first appearance."""
    text = F.trim(F.col(value))
    counts = df.filter(F.coalesce(text, F.lit("")) != "").groupBy(*group, text.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    k = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return counts.withColumn("k", k).filter(F.col("k") <= limit).drop("first")


def group_prompt(df: DataFrame, group: Sequence[str], order: str, line: Column, limit: int = 50) -> DataFrame:
    """``(group..., lines, prompt)``: one line per photo in order; at most ``limit`` lines a prompt, the further photos in further prompts.

    A group of any size is cut into prompts by its order before lines are gathered.
    """
    rows = positions(df, group, [F.asc(order)], "__at").withColumn("__at", F.col("__at") - 1)
    rows = rows.withColumn("part", F.floor(F.col("__at") / limit).cast("int")).withColumn("__line", line)
    out = rows.groupBy(*group, "part").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("__at", "__line"))).alias("x"))
    return out.withColumn("prompt", F.array_join(F.transform("x", lambda e: e["__line"]), "\n")).drop("x")


def hint(weakest: Column, hints: dict[str, Sequence[str]], key: Column) -> Column:
    """A hint for the weakest dimension; one of its wordings by the photo's key."""
    out = None
    for dim, wordings in hints.items():
        text = X.variant(list(wordings), key)
        out = F.when(weakest == dim, text) if out is None else out.when(weakest == dim, text)
    return F.coalesce(out, F.lit("")) if out is not None else F.lit("")


def needs_refinement(text: Column, weak_labels: Column, language: str = "zh", least: int = 24) -> Column:
    """Whether a post hint is empty, in the wrong language, too short, or about exposure where that isn't weak."""
    body = X.without_prefix(text, X.POST_PREFIX[language])
    word, fine = ("曝光", ["曝光", "光线"]) if language == "zh" else ("exposure", ["Exposure", "Lighting"])
    off = F.lower(body).contains(word) & ~F.arrays_overlap(weak_labels, F.array(*[F.lit(x) for x in fine]))
    foreign = X.any_of(body, [X.ISSUES_PREFIX[language], X.SHOOTING_PREFIX[language]])
    return (body == "") | X.language_mismatch(body, language) | (F.length(body) < least) | foreign | off
