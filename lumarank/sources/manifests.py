"""Small driver-side sources and sinks: YAML labels and manifests, JSON and Markdown reports, JSONL attempts."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML sources are optional
    yaml = None

LABEL_SCHEMA = "path string, target string, raw_score double, human_score double, human_rating double, split string"


def _yaml(path: str) -> Any:
    if yaml is None:
        raise RuntimeError("YAML files need the yaml package")
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def _number(value: Any, low: float, high: float, name: str) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low} to {high}, not {value!r}")
    return float(value)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a YAML file (a person's work, thousands at most), checked; one error names them all."""
    rows, wrong = [], []
    for i, item in enumerate(_yaml(path).get("labels", [])):
        try:
            if not item.get("path"):
                raise ValueError("path is missing")
            split = item.get("split")
            if split not in (None, "train", "holdout"):
                raise ValueError(f"split {split!r}")
            rows.append((str(item["path"]), str(item.get("target", "overall")).strip().lower(), _number(item.get("raw_score"), 1, 10, "raw_score"), _number(item.get("human_score"), 1, 10, "human_score"), _number(item.get("human_rating"), 1, 5, "human_rating"), split))
        except ValueError as e:
            wrong.append(f"label {i}: {e}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return spark.createDataFrame(rows, LABEL_SCHEMA)


#: Labels that one YAML file, which the driver writes, may hold.
MAX_LABELS = 200_000


def write_labels(labels: DataFrame, path: str, split: str | None = None) -> int:
    """Exports labels, of one split if given, by target and path; returns how many."""
    rows = labels.filter(F.col("split") == split) if split else labels
    if (n := rows.count()) > MAX_LABELS:
        raise ValueError(f"{n} labels are too many for one YAML file (at most {MAX_LABELS}); write a table instead")
    items = [r.asDict() for r in rows.orderBy("target", "path").toLocalIterator()]
    if yaml is None:
        raise RuntimeError("YAML files need the yaml package")
    Path(path).write_text(yaml.safe_dump({"labels": [{k: v for k, v in i.items() if v is not None} for i in items]}, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return len(items)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Items, preferences per group and pairwise preferences of a benchmark manifest.

    Items are unique; preferences name items that exist, in the group they are preferred in.
    """
    doc = _yaml(path)
    items = doc.get("items", [])
    ids = [i.get("id") for i in items]
    group = {i.get("id"): i.get("group") for i in items}
    wrong = [f"item {i!r} repeated" for i in {x for x in ids if ids.count(x) > 1}]
    preferred = doc.get("preferred_by_group", {})
    wrong += [f"preferred {i!r} isn't in group {g!r}" for g, i in preferred.items() if group.get(i) != g]
    pairs = [(p["preferred"], p["other"]) for p in doc.get("pairwise_preferences", [])]
    wrong += [f"pair {a!r}, {b!r} names an unknown item" for a, b in pairs if a not in group or b not in group]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))
    fields = ("id", "path", "group", "scene", "face_present", "non_photo", "reject")
    schema = "id string, path string, group string, scene string, face_present boolean, non_photo boolean, reject boolean"
    return {
        "items": spark.createDataFrame([tuple(i.get(f) for f in fields) for i in items], schema),
        "preferred": spark.createDataFrame(list(preferred.items()), "group string, item_id string"),
        "pairs": spark.createDataFrame(pairs, "preferred string, other string"),
    }


def write_report(metrics: DataFrame, folder: str, title: str, most: int = 10_000) -> None:
    """A small aggregate as report.json and report.md; an error beyond ``most`` rows."""
    rows = [r.asDict(recursive=True) for r in metrics.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "report.json").write_text(json.dumps({"title": title, "rows": rows}, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in rows]
    Path(folder, "report.md").write_text("\n".join(lines) + "\n", encoding="utf-8")


def write_attempts(attempts: DataFrame, path: str) -> None:
    """Attempts as JSON lines, one folder per run."""
    attempts.write.mode("append").partitionBy("run_id").json(path)


def read_attempts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def best_of_both(old: DataFrame, new: DataFrame, key: str, better: list) -> DataFrame:
    """Per key the better row of an earlier and a new result; the earlier one stays on ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = F.struct(*[b.alias(f"o{i}") for i, b in enumerate(better)], (-F.col("__new")).alias("age"))
    row = F.struct(*[F.col(c) for c in both.columns if c != "__new"])
    return both.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")
