"""File listings, raster decoding, capture times and hashes as DataFrames."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = ("JPG", "JPEG", "PNG")
IMAGE = "path string, height int, width int, pixels binary, error string"


def any_case_glob(extensions: Sequence[str]) -> str:
    """A glob of files with one of the extensions in any letter case."""
    one = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    return "*.{" + ",".join(one(e) for e in extensions) + "}"


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str], limit: int | None = None) -> DataFrame:
    """``(path, file_size, mtime)`` of all files below a folder, by path; the first ``limit`` of them if given.

    Contents aren't read: the reader prunes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case_glob(extensions)).load(root)
    files = files.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime")).orderBy("path")
    return files.limit(limit) if limit else files


def decode_jvm(spark: SparkSession, root: str, extensions: Sequence[str] = RASTER) -> DataFrame:
    """``(path, height, width, channels, pixels)`` of raster images by the JVM's decoder; unreadable ones are left out."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case_glob(extensions)).load(root)
    return images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def gray_pixels(images: DataFrame) -> DataFrame:
    """Adds ``gray``: 8-bit luminance of BGR or gray pixel columns."""
    import numpy as np
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def gray(channels: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(c: int, p: bytes) -> bytes | None:
            if p is None:
                return None
            a = np.frombuffer(p, dtype=np.uint8).reshape(-1, c)
            return bytes(p) if c == 1 else np.round(a[:, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8).tobytes()

        return pd.Series([one(int(c), p) for c, p in zip(channels, pixels)])

    return images.withColumn("gray", gray("channels", "pixels"))


def decode(files: DataFrame, decoder: Callable[[str, bytes], tuple[int, int, bytes]]) -> DataFrame:
    """``(path, height, width, pixels, error)`` of ``(path, content)`` by any decoder (camera raw formats plug in here).

    A file that can't be decoded gives a row with its error instead of failing the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *decoder(path, bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels", "error"]).astype({"height": "Int32", "width": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGE)


def decode_netpbm(path: str, content: bytes) -> tuple[int, int, bytes]:
    """Binary 8-bit PGM: the decoder that needs no library."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
    if not m:
        raise ValueError("no 8-bit PGM")
    width, height = int(m[1]), int(m[2])
    pixels = content[m.end() : m.end() + width * height]
    if len(pixels) != width * height:
        raise ValueError("truncated")
    return height, width, pixels


def embedded_jpeg(content: bytes) -> bytes | None:
    """The largest JPEG inside a camera raw file: its preview, which needs no demosaicing."""
    best, at = b"", content.find(b"\xff\xd8\xff")
    while at >= 0:
        end = content.find(b"\xff\xd9", at)
        if end < 0:
            break
        if end + 2 - at > len(best):
            best = content[at : end + 2]
        at = content.find(b"\xff\xd8\xff", at + 3)
    return best or None


def routed(files: DataFrame, raster: Callable[[str, bytes], tuple[int, int, bytes]], raw: Callable[[str, bytes], tuple[int, int, bytes]], raster_extensions: Sequence[str] = RASTER) -> DataFrame:
    """Decodes ``(path, content)`` by the raster or the raw decoder, as the extension says."""
    is_raster = F.upper(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*raster_extensions)
    return decode(files.filter(is_raster), raster).unionByName(decode(files.filter(~is_raster), raw))


def outdated(sources: DataFrame, derived: DataFrame, key: str = "path") -> DataFrame:
    """Sources whose derived file (a thumbnail) is missing or older."""
    made = derived.select(F.col(key), F.col("mtime").alias("__made"))
    return sources.join(made, key, "left").filter(F.col("__made").isNull() | (F.col("__made") < F.col("mtime"))).drop("__made")


def exif_time(content: bytes) -> str | None:
    """The original capture time text of a JPEG's or TIFF's EXIF block, if any."""
    start = content.find(b"Exif\x00\x00")
    data = content[start + 6 :] if start >= 0 else content
    if data[:4] not in (b"II*\x00", b"MM\x00*"):
        return None
    order = "<" if data[:2] == b"II" else ">"

    def entries(at: int) -> Iterator[tuple[int, int, int, bytes]]:
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            yield tag, kind, count, data[at + 10 + 12 * i : at + 14 + 12 * i]

    try:
        (first,) = struct.unpack_from(order + "I", data, 4)
        found: dict[int, str] = {}
        offsets = [first]
        for at in offsets:
            for tag, kind, count, value in entries(at):
                (where,) = struct.unpack(order + "I", value)
                if tag == 0x8769 and len(offsets) < 4:
                    offsets.append(where)
                elif tag in (0x9003, 0x0132) and kind == 2:
                    found[tag] = data[where : where + count].split(b"\x00")[0].decode("ascii", "ignore")
        return found.get(0x9003) or found.get(0x0132)
    except struct.error:
        return None


def capture_times(files: DataFrame) -> DataFrame:
    """``(path, captured_at)`` of ``(path, content)``; null where there is no valid time."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else exif_time(bytes(c)))

    return files.select("path", F.try_to_timestamp(read("content"), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz").alias("captured_at"))


def missing_only(files: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """Files without a cached value: the ones that a costly reader still has to open."""
    return files.join(cache.select(key), key, "left_anti")


def listing_from_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A stated list of paths, each once, in its order."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(paths))], "path string, position int")


