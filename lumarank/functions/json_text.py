"""Tolerant JSON and free-text parsing of model output."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumarank.constants import SCENES, VISION_DIMS
from lumarank.functions.scoring import clamp

# Keys that are dropped or masked at any depth.
VECTOR_KEYS = ("_embedding_vector", "embedding_vector", "vector")
SECRET_WORDS = ("password", "secret", "token", "api_key", "apikey", "authorization", "credential")
MASK = "[REDACTED]"


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else ``{}``."""
    return F.when(F.json_object_keys(text).isNotNull(), text).otherwise("{}")


def json_list(text: Column) -> Column:
    """The text if it is a JSON array, else ``[]``."""
    return F.when(F.json_array_length(text).isNotNull(), text).otherwise("[]")


def has_exactly(text: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON object has these keys and no other."""
    own = F.json_object_keys(text)
    return F.coalesce(F.array_sort(own) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def missing_keys(text: Column, keys: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in keys]), F.json_object_keys(text))


def extra_keys(text: Column, keys: tuple[str, ...]) -> Column:
    return F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in keys]))


def full_score_valid(text: Column, dims: tuple[str, ...] = VISION_DIMS) -> Column:
    """Whether a JSON object has all dimensions as numbers and at most ``overall`` besides."""
    numeric = F.lit(True)
    for d in dims:
        numeric = numeric & F.get_json_object(text, f"$.{d}").try_cast("double").isNotNull()
    return F.coalesce((F.size(missing_keys(text, dims)) == 0) & (F.size(extra_keys(text, (*dims, "overall"))) == 0) & numeric, F.lit(False))


def _pruned(value: Any, keys: tuple[str, ...]) -> Any:
    if isinstance(value, dict):
        return {k: _pruned(v, keys) for k, v in value.items() if k not in keys}
    return [_pruned(v, keys) for v in value] if isinstance(value, list) else value


def _masked(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: MASK if any(w in k.lower() for w in SECRET_WORDS) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


def _rewritten(text: str | None, change) -> str | None:
    try:
        return json.dumps(change(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def without_vectors(text: pd.Series) -> pd.Series:
    """JSON without the vector keys at any depth; null for broken JSON."""
    return text.map(lambda x: _rewritten(x, lambda v: _pruned(v, VECTOR_KEYS)))


@F.pandas_udf(T.StringType())
def without_secrets(text: pd.Series) -> pd.Series:
    """JSON with credential-like keys masked at any depth; null for broken JSON."""
    return text.map(lambda x: _rewritten(x, _masked))


def last_object(text: str | None) -> dict | None:
    """The last balanced JSON object in a text that parses, after repairing ``<n>`` and trailing commas."""
    if not text:
        return None
    text = re.sub(r",\s*([}\]])", r"\1", re.sub(r"<(\d+(?:\.\d+)?)>", r"\1", text))
    spans, depth, start, quoted, i = [], 0, 0, False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"  # the escaped character isn't looked at
            quoted = c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                spans.append(text[start : i + 1])
        i += 1
    for span in reversed(spans):
        try:
            found = json.loads(span)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def last_json_object(text: pd.Series) -> pd.Series:
    """The last JSON object of a free text, as JSON; null if there is none."""
    return text.map(lambda x: None if (d := last_object(x)) is None else json.dumps(d, ensure_ascii=False, separators=(",", ":")))


# Words that name a score, and words between such a name and its number in a sentence.
SCORE_WORDS = ("overall", "score", "rating")
LINKING_WORDS = ("is", "was", "be", "looks like", "estimated at", "likely", "around", "approximately", "about", "maybe", "roughly")
#: Characters of a sentence between the name and the linking word, at most.
SENTENCE_REACH = 120


def _leading_number(token: str) -> float | None:
    """The number that a token is, or begins with before a mark such as / or %."""
    digits = token[1:] if token.startswith("-") else token
    end = 0
    while end < len(digits) and (digits[end].isdecimal() or (digits[end] == "." and 0 < end < len(digits) - 1 and digits[end + 1].isdecimal() and "." not in digits[:end])):
        end += 1
    if not end or digits[end : end + 1].isalpha():
        return None
    return float(digits[:end]) * (-1 if token.startswith("-") else 1)


def score_in(text: str | None) -> float | None:
    """A 0-10 score in a text: of its JSON, else behind a name and a sign, else told in a sentence, else the bare number.

    A sentence tells a score if one of the LINKING_WORDS stands right before the number, within
    SENTENCE_REACH of the name, and no "scale of" comes between. Numbers between 0 and 1 are shares.
    """
    if not text:
        return None
    doc = last_object(text) or {}
    value = next((float(doc[k]) for k in SCORE_WORDS if isinstance(doc.get(k), (int, float)) and not isinstance(doc.get(k), bool)), None)
    # tokens with the place where they begin; signs are tokens of their own
    tokens = [(m.start(), m.group().strip("`\"'*_,;()[]{}").rstrip(".!?")) for m in re.finditer(r"[:=]|[^\s:=]+", text.lower())]
    tokens = [(at, t) for at, t in tokens if t]
    words = [t for _, t in tokens]
    names = [i for i, t in enumerate(words) if t in SCORE_WORDS]
    if value is None:
        value = next((v for i in names if words[i + 1 : i + 2] in ([":"], ["="]) and i + 2 < len(words) and (v := _leading_number(words[i + 2])) is not None), None)
    for i in names if value is None else ():
        for j in range(i + 1, len(words)):
            if tokens[j][0] - tokens[i][0] > SENTENCE_REACH + len(words[i]) or words[j : j + 2] == ["scale", "of"]:
                break
            if (words[j - 1] in LINKING_WORDS or " ".join(words[j - 2 : j]) in LINKING_WORDS) and (v := _leading_number(words[j])) is not None:
                value = v
                break
        break  # the first name decides
    if value is None and len(words) == 1 and words[0] == text.strip():
        value = _leading_number(words[0]) if words[0].lstrip("-").replace(".", "", 1).isdecimal() else None
    if value is None or value != value:
        return None
    return min(10.0, max(0.0, value * 10 if 0 < value < 1 else value))


@F.pandas_udf(T.DoubleType())
def labelled_score(text: pd.Series) -> pd.Series:
    """``score_in`` of every text."""
    return text.map(score_in).astype(float)


_VISION = T.StructType([*[T.StructField(d, T.DoubleType()) for d in VISION_DIMS], T.StructField("scene", T.StringType()), T.StructField("scene_raw", T.StringType()), T.StructField("ok", T.BooleanType())])


def parse_vision(text: str | None) -> dict[str, Any]:
    """Seven dimensions and the scene of a model answer: a JSON array, an object, or labelled numbers in prose."""
    out: dict[str, Any] = {d: None for d in VISION_DIMS} | {"scene": None, "scene_raw": None, "ok": False}
    if not text:
        return out
    found: Any = last_object(text)
    if found is None:
        try:
            found = json.loads(text[text.index("[") : text.rindex("]") + 1])
        except ValueError:
            found = {}
    if isinstance(found, list):
        found = dict(zip(VISION_DIMS, found))
    for d in VISION_DIMS:
        value = found.get(d)
        if value is None and (m := re.search(rf"(?i)\b{d}\b\W{{0,3}}[:=]?\s*(-?\d+(?:\.\d+)?)", text)):
            value = m.group(1)
        try:
            out[d] = min(10.0, max(0.0, float(value)))
        except (TypeError, ValueError):
            pass
    scene = str(found.get("scene") or "").strip().lower()
    out |= {"scene": scene if scene in SCENES else "other", "scene_raw": found.get("scene_raw") if isinstance(found.get("scene_raw"), str) else None}
    return out | {"ok": all(out[d] is not None for d in VISION_DIMS)}


@F.pandas_udf(_VISION)
def vision_answer(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_vision(x) for x in text], columns=[f.name for f in _VISION.fields])


def tolerant_map(text: Column) -> Column:
    """JSON object of numbers as a map; empty for broken or mistyped JSON."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.create_map().cast("map<string,double>"))


def path_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
