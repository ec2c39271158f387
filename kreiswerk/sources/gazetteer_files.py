"""Gazetteer files: line formats of places, postal codes and the GeoNames dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PLACES_HEADER = "name;aliases;admin1;population;lat;lon"
POSTAL_HEADER = "plz;name;admin1;lat;lon"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of one file with a BIGINT that orders them as in the file.

    The number is the start of the block a line was read from, then the running row number inside
    the task; blocks start at least 4 KiB apart and a task reads fewer than 2^33 lines.
    """
    block = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 12), 33)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return spark.read.text(path).select(F.col("value").alias("line"), (block + row).alias("line_no"))


def parse_places(lines: DataFrame) -> DataFrame:
    """``line, line_no`` to places; quotes are kept. Lines that are none are left to ``unread_places``."""
    f = F.split("line", ";", 6)
    aliases = F.filter(F.split(f[1], r"\|"), lambda a: a != "")
    return (
        lines.filter((F.size(f) == 6) & (F.col("line") != PLACES_HEADER) & _numbers(f[3], f[4], f[5]))
        .select(
            f[0].alias("name"),
            aliases.alias("aliases"),
            f[2].alias("admin1"),
            f[3].try_cast("bigint").alias("population"),
            f[4].try_cast("double").alias("lat"),
            f[5].try_cast("double").alias("lon"),
            "line_no",
        )
    )


def unread_places(lines: DataFrame) -> DataFrame:
    """Lines with fewer than six fields or with a number that cannot be read."""
    f = F.split("line", ";", 6)
    return lines.filter((F.col("line") != PLACES_HEADER) & ~((F.size(f) == 6) & _numbers(f[3], f[4], f[5])))


def unread_postal(lines: DataFrame) -> DataFrame:
    """Lines with fewer than five fields or with a number that cannot be read."""
    f = F.split("line", ";", 5)
    return lines.filter((F.col("line") != POSTAL_HEADER) & ~((F.size(f) == 5) & _numbers(f[3], f[4])))


def _numbers(*fields: Column) -> Column:
    readable = [field.try_cast("double").isNotNull() for field in fields]
    return F.coalesce(reduce(lambda a, b: a & b, readable), F.lit(False))


def parse_postal(lines: DataFrame) -> DataFrame:
    """``line, line_no`` to postal rows; repeated codes are kept, see ``postal_lookup``."""
    f = F.split("line", ";", 5)
    return lines.filter((F.size(f) == 5) & (F.col("line") != POSTAL_HEADER) & _numbers(f[3], f[4])).select(
        f[0].alias("plz"),
        f[1].alias("name"),
        f[2].alias("admin1"),
        f[3].try_cast("double").alias("lat"),
        f[4].try_cast("double").alias("lon"),
        "line_no",
    )


def parse_geonames(lines: DataFrame) -> DataFrame:
    """Main dump: populated places only."""
    f = F.split("line", "\t")
    return lines.filter((F.size(f) >= 15) & (f[6] == "P")).select(
        f[0].cast("bigint").alias("geonameid"),
        f[1].alias("name"),
        f[2].alias("ascii_name"),
        f[3].alias("alternate_names"),
        f[4].alias("lat"),
        f[5].alias("lon"),
        f[10].alias("admin1_code"),
        F.coalesce(F.nullif(f[14], F.lit("")).cast("bigint"), F.lit(0)).alias("population"),
        "line_no",
    )


def parse_alternate_names(lines: DataFrame) -> DataFrame:
    """Alternate names: non-empty German ones."""
    f = F.split("line", "\t")
    return lines.filter((F.size(f) >= 5) & (f[2] == "de") & (f[3] != "")).select(
        f[1].cast("bigint").alias("geonameid"),
        f[3].alias("name"),
        (f[4] == "1").alias("preferred"),
        "line_no",
    )


def parse_geonames_postal(lines: DataFrame) -> DataFrame:
    """Postal dump."""
    f = F.split("line", "\t")
    return lines.filter((F.size(f) >= 11) & (f[1] != "")).select(
        f[1].alias("plz"),
        f[2].alias("name"),
        f[4].alias("admin1_code"),
        f[9].alias("lat"),
        f[10].alias("lon"),
        "line_no",
    )


def write_gazetteer(places: DataFrame, postal: DataFrame, places_path: str, postal_path: str) -> None:
    """Semicolon files: places by falling population and name, postal rows by code.

    The rows are range-partitioned and sorted inside each part, so part files read in name order
    give the global order without passing through one task.
    """
    out = places.withColumn("aliases", F.array_join("aliases", "|"))
    _write(
        out.orderBy(F.desc("population"), "name", "admin1").select("name", "aliases", "admin1", "population", "lat", "lon"),
        places_path,
    )
    _write(postal.orderBy("plz").select("plz", "name", "admin1", "lat", "lon"), postal_path)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", ";").option("header", True).option("quote", "").csv(path)
