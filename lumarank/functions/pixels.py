"""Image kernels on binary pixel columns, as Arrow-batched UDFs over numpy.

An image is a struct ``height int, width int, pixels binary`` of row-major 8-bit luminance,
or RGB where said. Kernels reduce an image to a few numbers in one pass; all score arithmetic
on those numbers stays in Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SHADOW, HIGHLIGHT = 0.04, 0.98


def as_gray(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)


def as_rgb(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3)


def to_eight_bit(pixels: np.ndarray) -> np.ndarray:
    """Any integer or float matrix scaled by its type's (else its own) maximum."""
    top = np.iinfo(pixels.dtype).max if np.issubdtype(pixels.dtype, np.integer) else float(pixels.max()) or 1.0
    return np.clip(pixels.astype(np.float64) / top * 255.0, 0, 255).astype(np.uint8)


def luminance_stats(gray: np.ndarray) -> tuple[float, float, float, float, float]:
    """Shares of clipped shadows and highlights and the 5th, 50th and 95th percentile in 0-1."""
    luma = gray.astype(np.float32) / 255.0
    p5, p50, p95 = np.percentile(luma, [5, 50, 95])
    return float((luma <= SHADOW).mean()), float((luma >= HIGHLIGHT).mean()), float(p5), float(p50), float(p95)


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the 3x3 Laplacian with mirrored borders; 0 for images thinner than two."""
    if min(gray.shape) < 2:
        return 0.0
    g = np.pad(gray.astype(np.float64), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area mean of a matrix on a smaller grid, by interpolated cumulative sums."""

    def along(m: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum(m, axis=0)])
        edges = np.linspace(0, m.shape[0], n + 1)
        low = np.floor(edges).astype(int).clip(0, m.shape[0] - 1)
        at = total[low] + (edges - low)[:, None] * (total[low + 1] - total[low])
        return np.diff(at, axis=0) / (m.shape[0] / n)

    return along(along(gray.astype(np.float64), height).T, width).T


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: low frequencies of a 32x32 cosine transform above their median."""
    c = _cosines(32)[:8]
    low = (c @ resized(gray, 32, 32) @ c.T).ravel()
    value = 0
    for bit in low > np.median(low):
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >> 63 else value


def heuristic_stats(rgb: np.ndarray) -> tuple[float, ...]:
    """Brightness, contrast, saturation, shares of very bright and dark pixels, mean gradient; all in 0-1."""
    x = rgb.astype(np.float64) / 255.0
    gray = x.mean(axis=2)
    gy, gx = np.gradient(gray) if min(gray.shape) > 1 else (np.zeros_like(gray),) * 2
    return tuple(float(v) for v in (gray.mean(), gray.std(), (x.max(axis=2) - x.min(axis=2)).mean(), (gray > 0.97).mean(), (gray < 0.03).mean(), np.hypot(gx, gy).mean()))


def saliency_box(gray: np.ndarray) -> list[float]:
    """Unit box around the centroid of the spectral residual of a 64x64 reduction."""
    small = resized(gray, 64, 64)
    f = np.fft.fft2(small)
    log = np.log1p(np.abs(f))
    pad = np.pad(log, 1, mode="edge")
    local = sum(pad[i : i + 64, j : j + 64] for i in range(3) for j in range(3)) / 9.0
    s = np.abs(np.fft.ifft2(np.exp(log - local + 1j * np.angle(f)))) ** 2
    weight = s / s.sum() if s.sum() > 0 else np.full_like(s, 1 / s.size)
    grid = (np.arange(64) + 0.5) / 64
    cy, cx = float((weight.sum(axis=1) * grid).sum()), float((weight.sum(axis=0) * grid).sum())
    return [max(0.0, cx - 0.2), max(0.0, cy - 0.2), min(1.0, cx + 0.2), min(1.0, cy + 0.2)]


def crop(gray: np.ndarray, box: list[float], longest: int = 512) -> np.ndarray:
    """The pixels of a unit box, reduced to ``longest`` on the longer edge."""
    h, w = gray.shape
    y0, y1 = int(box[1] * h), max(int(box[1] * h) + 1, int(np.ceil(box[3] * h)))
    x0, x1 = int(box[0] * w), max(int(box[0] * w) + 1, int(np.ceil(box[2] * w)))
    part = gray[y0:y1, x0:x1]
    ratio = longest / max(part.shape)
    return part if ratio >= 1 else np.round(resized(part, max(1, round(part.shape[0] * ratio)), max(1, round(part.shape[1] * ratio)))).astype(np.uint8)


def _struct(names: str, kind: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, kind or T.DoubleType()) for n in names.split()])


def image_udf(kernel: Callable, names: str, rgb: bool = False):
    """A vectorised UDF of (height, width, pixels) returning a struct of doubles; nulls for unreadable images."""
    fields = _struct(names)
    width = len(fields.fields)
    read = as_rgb if rgb else as_gray

    @pandas_udf(fields)
    def run(height: pd.Series, wide: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        rows = []
        for h, w, p in zip(height, wide, pixels):
            try:
                got = kernel(read(int(h), int(w), p))
                rows.append(got if isinstance(got, tuple) else (got,))
            except (TypeError, ValueError):
                rows.append((None,) * width)
        return pd.DataFrame(rows, columns=fields.names, dtype="float64")

    return run


luminance = image_udf(luminance_stats, "shadow highlight p5 p50 p95")
sharpness = image_udf(laplacian_variance, "variance")
heuristics = image_udf(heuristic_stats, "brightness contrast saturation bright_share dark_share edges", rgb=True)


@pandas_udf(T.LongType())
def image_hash(height: pd.Series, wide: pd.Series, pixels: pd.Series) -> pd.Series:
    """Perceptual hash; null for unreadable images."""
    out = []
    for h, w, p in zip(height, wide, pixels):
        try:
            out.append(perceptual_hash(as_gray(int(h), int(w), p)))
        except (TypeError, ValueError):
            out.append(None)
    return pd.Series(out, dtype="Int64")


@pandas_udf(T.StructType([T.StructField("subject", T.DoubleType()), T.StructField("whole", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("source", T.StringType())]))
def subject_variances(height: pd.Series, wide: pd.Series, pixels: pd.Series, box: pd.Series) -> pd.DataFrame:
    """Laplacian variances of the subject's box and the whole image; the salient box where none is given."""
    rows = []
    for h, w, p, b in zip(height, wide, pixels, box):
        try:
            gray = as_gray(int(h), int(w), p)
            own = list(b) if b is not None and len(b) == 4 else saliency_box(gray)
            rows.append((laplacian_variance(crop(gray, own)), laplacian_variance(gray), own, "given" if b is not None and len(b) == 4 else "saliency"))
        except (TypeError, ValueError):
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["subject", "whole", "box", "source"])
