"""XMP sidecars: written from DataFrames, read back as DataFrames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lumarank.functions.text import xml_escape
from lumarank.runtime import cut

MACHINE_PREFIX = "pj:"
TOOL = "lumarank"


def _bag(name: str, tags: Column) -> Column:
    items = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<rdf:li>"), xml_escape(t), F.lit("</rdf:li>"))), "")
    return F.when(F.size(tags) > 0, F.concat(F.lit(f"<{name}><rdf:Bag>"), items, F.lit(f"</rdf:Bag></{name}>"))).otherwise("")


def sidecar_text(rating: Column, subjects: Column, identifiers: Column, instructions: Column, description: Column, hierarchical: Column | None = None) -> Column:
    """The sidecar document of a photo, built in the JVM."""
    hierarchical = F.array().cast("array<string>") if hierarchical is None else hierarchical
    return F.concat(
        F.lit(f'<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{TOOL}"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" '),
        F.lit('xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/"><xmp:Rating>'),
        rating.cast("string"), F.lit("</xmp:Rating>"), _bag("dc:subject", subjects), _bag("xmp:Identifier", identifiers), _bag("lr:hierarchicalSubject", hierarchical),
        F.lit("<photoshop:Instructions>"), xml_escape(instructions), F.lit('</photoshop:Instructions><dc:description><rdf:Alt><rdf:li xml:lang="x-default">'),
        xml_escape(description), F.lit("</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )


def write_sidecars(rows: DataFrame) -> int:
    """Writes ``(sidecar_path, content)`` and returns how many; every file appears whole or not at all.

    A task that is repeated writes the same content again. Paths are on storage that all
    executors mount, as the photos themselves are.
    """

    written = rows.sparkSession.sparkContext.accumulator(0)

    def put(part: Iterable[Row]) -> None:
        here = 0
        for row in part:
            temporary = f"{row.sidecar_path}.{uuid.uuid4().hex}.tmp"
            try:
                os.makedirs(os.path.dirname(row.sidecar_path), exist_ok=True)
                with open(temporary, "w", encoding="utf-8") as f:
                    f.write(row.content)
                os.replace(temporary, row.sidecar_path)
                here += 1
            finally:
                if os.path.exists(temporary):
                    os.unlink(temporary)
        written.add(here)

    rows.select("sidecar_path", "content").foreachPartition(put)
    return written.value


def sidecar_paths(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``sidecar_path``: an existing one (lower case first, then upper), else the lower-case one."""
    stem = F.regexp_replace("file_path", "\\.[^./]+$", "")
    have = existing.select(F.col("path").alias("p"))
    lower = have.select(F.col("p").alias("lower"))
    upper = have.select(F.col("p").alias("upper"))
    rows = photos.withColumn("__stem", stem)
    rows = rows.join(lower, F.concat("__stem", F.lit(".xmp")) == F.col("lower"), "left").join(upper, F.concat("__stem", F.lit(".XMP")) == F.col("upper"), "left")
    return rows.withColumn("sidecar_path", F.coalesce("lower", "upper", F.concat("__stem", F.lit(".xmp")))).drop("lower", "upper", "__stem")


def local_path(uri: Column) -> Column:
    """A file's address as the path that names it elsewhere: without ``file:`` and escapes; other schemes stay."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, "^file:/+", "/"), "\\+", "%2B"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``(path, rating, subjects, identifiers, hierarchical, instructions, description)`` of all sidecars below a folder.

    Machine tags are left out of the subjects; identifiers and hierarchical subjects are whole.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][pP]").text(root)
    # xpath knows no namespaces: prefixes, attributes and processing instructions go first
    doc = F.regexp_replace(F.regexp_replace("value", "(</?)[A-Za-z]+:", "$1"), "\\s[A-Za-z]+(:[A-Za-z]+)?=\"[^\"]*\"", "")
    doc = F.regexp_replace(doc, "<\\?[^>]*\\?>", "")
    text = lambda path: F.xpath(F.col("doc"), F.lit(path))
    rows = files.select(local_path(F.input_file_name()).alias("path"), doc.alias("doc"))
    return rows.select(
        "path",
        F.xpath_string("doc", F.lit("//Rating")).try_cast("int").alias("rating"),
        F.filter(text("//subject//li/text()"), lambda t: ~t.startswith(MACHINE_PREFIX)).alias("subjects"),
        text("//Identifier//li/text()").alias("identifiers"),
        text("//hierarchicalSubject//li/text()").alias("hierarchical"),
        F.xpath_string("doc", F.lit("//Instructions")).alias("instructions"),
        F.xpath_string("doc", F.lit("//description//li")).alias("description"),
    )


def cleared_where_recorded(current: Column, recorded: Column) -> Column:
    """Null where the sidecar still holds what was recorded, else the current value."""
    return F.when(current.cast("string").eqNullSafe(recorded.cast("string")), F.lit(None)).otherwise(current)


def rewrite_sidecars(results: DataFrame, existing: DataFrame) -> int:
    """Writes the sidecar of every finished result again and returns how many.

    ``results``: ``(file_path, status, star_rating, tags array<string>, line, description)``.
    ``existing``: ``path`` and, as read_sidecars gives them, subjects, identifiers and hierarchical
    subjects. What people tagged stays: of each list the tags without the machine prefix are kept in
    their order; the machine's tags follow among the identifiers, never among the subjects. A photo
    without a sidecar gets a new one.
    """
    empty = F.array().cast("array<string>")
    names = ("subjects", "identifiers", "hierarchical")
    own = existing.select("path", *[F.col(n) if n in existing.columns else empty.alias(n) for n in names]).dropDuplicates(["path"])
    kept = {n: F.filter(F.coalesce(F.col(n), empty), lambda t: ~t.startswith(MACHINE_PREFIX)) for n in names}
    rows = sidecar_paths(results.filter(F.col("status") == "done"), own.select("path"))
    rows = rows.select("sidecar_path", "star_rating", "tags", "line", "description").join(own.withColumnRenamed("path", "sidecar_path"), "sidecar_path", "left")
    identifiers = F.array_distinct(F.concat(kept["identifiers"], F.coalesce("tags", empty)))
    text = sidecar_text(F.coalesce("star_rating", F.lit(0)), kept["subjects"], identifiers, F.coalesce("line", F.lit("")), F.coalesce("description", F.lit("")), kept["hierarchical"])
    return write_sidecars(cut(rows.select("sidecar_path", text.alias("content"))))  # all is read before anything is replaced
