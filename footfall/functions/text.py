"""Text rules as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Full-width forms and their plain counterparts.
WIDE, PLAIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " "


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _plain(text: Column) -> Column:
    """A text of plain and full-width signs alone, whose canonical form the JVM can make."""
    return text.rlike(r"^[\x00-\x7F\uFF01-\uFF5E\u3000]*$")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\u00A0\u3000()（）,，.。·]+", "")


def canonical(text: Column) -> Column:
    """compatibility form, case folded, without white space, brackets, commas, stops and middle dots.

    As a column it sends every row through Python where a text may need it; `canonicalised` sends these texts alone.
    """
    easy = _plain(text)
    return _stripped(F.when(easy, F.lower(F.translate(text, WIDE, PLAIN))).otherwise(_folded(F.when(~easy, text))))


def canonicalised(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the `canonical` form of a column: rows of plain texts stay in the JVM, only the others go through Python."""
    easy = F.coalesce(_plain(F.col(text)), F.lit(True))
    there = rows.filter(easy).withColumn(name, _stripped(F.lower(F.translate(F.col(text), WIDE, PLAIN))))
    return there.unionByName(rows.filter(~easy).withColumn(name, _stripped(_folded(F.col(text)))))


def numbered_gate(text: Column) -> Column:
    """a name that ends in the number of a gate."""
    return text.rlike(r"\d+号门")


def tags(text: Column) -> Column:
    """distinct trimmed parts between semicolons, commas, bars and arrows."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[;；,，|>]"), lambda t: F.trim(t)), lambda t: t != ""))


def escape_formula(text: Column) -> Column:
    """A cell that a spreadsheet would run gets an apostrophe in front."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def redact(text: Column) -> Column:
    """P5: addresses and key-like values are blanked."""
    out = F.regexp_replace(text, r"(?i)\b(ak|sn|key|token|password|secret)=[^&\s]+", "$1=***")
    return F.regexp_replace(out, r"(?i)\bhttps?://[^\s\"'<>]+", "<url>")


def width_metres(text: Column) -> Column:
    """A width given as a number, with or without ``m``, above 0 and up to 1000; else null."""
    width = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*m?\s*$", 1).try_cast("double")
    return F.when((width > 0) & (width <= 1000), width)


def yes(text: Column) -> Column:
    """Does a tag say yes in any form but no?"""
    return F.coalesce(~F.lower(text).isin("no", "0", "false", "none", ""), F.lit(False))


def path_points(path: Column) -> Column:
    """the points of ``lng,lat;lng,lat``, consecutive repeats left out."""
    parts = F.filter(F.split(path, ";"), lambda p: p != "")
    kept = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (p != F.get(parts, i - 1)), p)), lambda p: p.isNotNull())
    return F.transform(kept, lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("lng"), F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("lat")))


def upstream_reason(http: Column, status: Column, result_type: Column | None = None) -> Column:
    """the reason behind an answer, by its HTTP status, then by the status in it; null for success."""
    kind = F.coalesce(result_type, F.lit("poi_type")) if result_type is not None else F.lit("poi_type")
    return (
        F.when(http == 429, "rate_limit")
        .when(http.isin(401, 403), "permission")
        .when(http >= 500, "upstream_error")
        .when(F.coalesce(http, F.lit(0)) != 200, "http_error")
        .when(status.isNull(), "invalid_response")
        .when(status.isin(401, 402), "rate_limit")
        .when(status.isin(4, 302), "quota")
        .when(status.isin(3, 5) | status.between(200, 299), "permission")
        .when(status == 2, "parameter_error")
        .when(status == 1, "upstream_error")
        .when(status != 0, "source_error")
        .when(kind != "poi_type", "non_poi_response")
    )


def percent_text(share: Column) -> Column:
    """one decimal and a percent sign; a dash for unknown."""
    return F.when(share.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", F.round(share * 100, 1)), F.lit("%")))


def area_text(square_metres: Column) -> Column:
    """whole square metres up to a hectare, else hectares with one decimal; a dash for unknown."""
    hectares = F.concat(F.format_string("%.1f", F.round(square_metres / 10_000, 1)), F.lit(" ha"))
    return F.when(square_metres.isNull(), "—").when(square_metres < 10_000, F.concat(F.format_string("%.0f", F.round(square_metres)), F.lit(" m²"))).otherwise(hectares)
