"""Whole text files, binary manifests and CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions read as images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")
#: Column that holds a CSV line as it is where a value in it could not be read.
CORRUPT = "_corrupt"


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def read_whole_texts(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """One row per file: ``path, n_bytes, text``.

    Every file is read whole. One that is too large for a value fails the job; it is never taken for
    a missing one.
    """
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(
        _plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("n_bytes"),
        F.col("value").alias("text"),
    )


def relative_ref(path: Column, base: str) -> Column:
    """Part of the path below ``base``, the form in which tasks refer to files."""
    return F.split_part(path, F.lit(base.rstrip("/") + "/"), F.lit(-1))


def mime_type(path: Column, kind: str = "image") -> Column:
    """``kind/<extension>`` in lower case, with ``jpg`` spelled ``jpeg``."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.concat(F.lit(f"{kind}/"), F.when(extension == "jpg", F.lit("jpeg")).otherwise(extension))


def _any_case(extensions: Sequence[str]) -> str:
    """A glob for file names that end in one of the extensions, in either case."""
    return "{" + ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name) for name in extensions) + "}"


def binary_manifest(spark: SparkSession, path: str, *, kind: str = "image", extensions: Sequence[str] = ()) -> DataFrame:
    """One row per file: ``path, n_bytes, mime, base64``. Only files with one of ``extensions`` are opened, if given.

    Every file is read whole; one above Spark's bound for binary files fails the job.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", _any_case(extensions)) if extensions else reader).load(path)
    named = [F.col("path"), F.col("length").alias("n_bytes"), mime_type(F.col("path"), kind).alias("mime")]
    return files.select(*named, F.base64("content").alias("base64"))


def read_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Task inputs below ``folder``: ``ref, text, n_bytes``, images as data URLs.

    ``n_bytes`` is the size of the file itself, which is what sending an image is counted as. Either kind
    of file is opened once: images are listed by their names, and for texts the test of the path prunes files
    before they are read.
    """
    is_image = F.rlike(F.lower("path"), F.lit(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$"))
    texts = read_whole_texts(spark, folder).where(~is_image)
    images = binary_manifest(spark, folder, extensions=IMAGE_EXTENSIONS)
    url = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.col("base64"))
    loaded = texts.unionByName(images.select(_plain_path(F.col("path")).alias("path"), "n_bytes", url.alias("text")))
    return loaded.select(relative_ref(F.col("path"), folder).alias("ref"), "text", "n_bytes")


def field_count(line: Column) -> Column:
    """Number of comma-separated fields of a CSV line; commas between quotes separate nothing.

    A doubled quote ends one quoted run and begins the next, so runs need no alternative in the pattern,
    which would take a stack frame per character of a long field.
    """
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_layouts(
    spark: SparkSession, paths: Sequence[str], layouts: Mapping[str, str], *, options: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV lines of several layouts, in any mix within a file: ``path, line, layout, reason, record_<layout>``.

    ``layouts`` maps names to schemas (``name TYPE, ...``) with different numbers of fields. A line goes to
    the layout that has as many fields, whatever header its file begins with, and is parsed by that
    layout's schema. Lines that are some layout's header, and empty ones, are left out. ``reason`` says why
    a line is no record of any layout (number of fields, a value that is not of its type), else it is NULL;
    see :func:`records` and :func:`quarantine`. A record is one line.
    """
    lines = spark.read.text(list(paths), lineSep="\n", recursiveFileLookup=True).select(
        _plain_path(F.col("_metadata.file_path")).alias("path"), F.rtrim("value", F.lit("\r")).alias("line")
    )
    headers = [",".join(field.split()[0] for field in schema.split(", ")) for schema in layouts.values()]
    held = lines.where((F.col("line") != "") & ~F.col("line").isin(*headers))
    sized = held.withColumn("_fields", field_count(F.col("line")))
    layout = F.lit(None).cast("string")
    parsed = {}
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', **(options or {})}
    for name, schema in layouts.items():
        fits = F.col("_fields") == len(schema.split(", "))
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        parsed[f"record_{name}"] = F.when(fits, F.from_csv("line", f"{schema}, {CORRUPT} STRING", how))
    read = sized.withColumn("layout", layout).withColumns(parsed)
    unreadable = F.coalesce(*[F.col(f"{record}.{CORRUPT}") for record in parsed]).isNotNull()
    reason = F.when(F.col("layout").isNull(), F.concat(F.col("_fields").cast("string"), F.lit(" fields"))).when(
        unreadable, F.lit("unreadable value")
    )
    return read.withColumn("reason", reason).drop("_fields")


def records(read: DataFrame, layout: str) -> DataFrame:
    """The readable records of one layout."""
    found = read.where((F.col("layout") == layout) & F.col("reason").isNull()).select(f"record_{layout}.*")
    return found.drop(CORRUPT)


def quarantine(read: DataFrame) -> DataFrame:
    """The lines that are no record, whole, each with its file and the reason."""
    return read.where(F.col("reason").isNotNull()).select("path", "layout", "reason", "line")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; rows that do not fit go to ``_corrupt``, not lost."""
    return spark.read.csv(
        path,
        schema=f"{schema}, {CORRUPT} STRING",
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        enforceSchema=False,
    )
