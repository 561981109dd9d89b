"""Readers: fixed schemas, bad lines set aside, nothing inferred."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions.ids import case_no_norm

#: The named references of HTML 4, and apos; a non-breaking space is a blank here.
NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A unit's queues with the panel fields of each case."""
    return spark.read.schema(schemas.CASES).parquet(path)


def read_case_list(spark: SparkSession, csv: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of a CSV with one case number a line under a header.

    case_no comes in its digits-only form. Lines without digits, or with more columns, go to
    rejects (line) whole.
    """
    reader = spark.read.schema(schemas.CASE_LIST).option("header", True).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", "rejected").csv(csv)
    rows = rows.withColumn("norm", case_no_norm(F.col("case_no")))
    good = F.col("rejected").isNull() & (F.length("norm") > 0)
    good = F.coalesce(good, F.lit(False))
    return (
        rows.filter(good).select(F.col("norm").alias("case_no")).distinct(),
        rows.filter(~good).select(F.coalesce("rejected", "case_no").alias("line")),
    )


#: A character reference: a number in either base, or one of the names of Latin letters and signs.
REFERENCE = "&(#[0-9]+|#[xX][0-9a-fA-F]+|" + "|".join(sorted(NAMES)) + ");"


def decoded(text: Column) -> Column:
    """text with its character references decoded, each once: what one of them gives is no part of another.

    Numbers that no character has give U+FFFD; names that are not known stay as they are.
    """
    names = F.create_map(*[F.lit(x) for name, char in NAMES.items() for x in (name, char)])

    def char(ref):
        hexa = F.lower(F.substring(ref, 2, 1)) == "x"
        digits = F.ltrim(F.when(hexa, F.substr(ref, F.lit(3))).otherwise(F.substr(ref, F.lit(2))), F.lit("0"))
        code = F.when(F.length(digits) < 8, F.conv(digits, 16, 10)).cast("long")
        code = F.when(hexa, code).otherwise(F.when(F.length(digits) < 8, digits).try_cast("long"))
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        told = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")), "UTF-32")
        return F.when(F.startswith(ref, F.lit("#")), told).otherwise(F.element_at(names, ref))

    refs = F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    rest = F.split(text, REFERENCE, -1)
    return F.array_join(F.zip_with(rest, F.transform(refs, char), lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")


def html_to_text(html: Column) -> Column:
    """Text of a piece that is HTML: scripts, styles, comments and tags out, references decoded, blanks squeezed."""
    out = F.coalesce(html, F.lit(""))
    for part in (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, part, " ")
    return F.trim(F.regexp_replace(decoded(out), r"[ \t\n\r\f]+", " "))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of pages of HTML."""
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def read_plain(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of whole .txt and .md files; empty files give no row."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.filter(F.lower("path").rlike(r"\.(txt|md)$"))
