"""File selection, language detection and file statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.functions.text import matches, round1
from reviewlake.operators.topk import top_per_group
from reviewlake.packs import languages as lang
from reviewlake.packs.own import extensions_of


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name, '' without one.

    Leading dots do not start a suffix: ``.bashrc`` has none.
    """
    suffix = F.regexp_extract(F.ltrim(file_name(path), F.lit(".")), r"(\.[^.]*)$", 1)
    return F.lower(suffix)


def _extension_map(own=()) -> Column:
    return F.create_map(*[F.lit(x) for kv in (lang.EXTENSIONS | extensions_of(own)).items() for x in kv])


def language_of_extension(ext: Column, own=()) -> Column:
    """Language of an extension given with or without dot, in any case."""
    dotted = F.lower(F.when(F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext)))
    return F.try_element_at(_extension_map(own), dotted)


def language_of_header(content: Column) -> Column:
    """C or C++ for a ``.h`` file, from its marks."""
    marks = "|".join(re.escape(m) for m in lang.CPP_HEADER_MARKS)
    return F.when(content.rlike(marks), "C++").otherwise("C")


def language_of_content(content: Column) -> Column:
    """First content heuristic that matches, else null."""
    return F.coalesce(*[F.when(matches(content, p, flags), F.lit(name)) for flags, p, name in lang.CONTENT_HINTS])


def detect_language(path: Column, content: Column, own=()) -> Column:
    ext = extension(path)
    return (F.when(ext == ".h", language_of_header(content))
            .otherwise(F.coalesce(F.try_element_at(_extension_map(own), ext), language_of_content(content))))


def pack_language(path: Column, own=()) -> Column:
    """Language whose pack reviews the file (``.h`` is always reviewed as C)."""
    ext = extension(path)
    without = [e for e in lang.UNREVIEWED_EXTENSIONS if e not in extensions_of(own)]
    return F.when(~ext.isin(without), F.try_element_at(_extension_map(own), ext))


def has_pack(path: Column, own=()) -> Column:
    return pack_language(path, own).isNotNull()


def in_walked_dir(relative_path: Column) -> Column:
    """No directory of the path is excluded or hidden."""
    parts = F.split(relative_path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = lambda d: d.isin(list(lang.EXCLUDED_DIRS)) | F.startswith(d, F.lit("."))
    return ~F.exists(dirs, skipped)


def wanted_name(path: Column) -> Column:
    """File name matches none of the excluded globs (one anchored regex)."""
    globs = "|".join(".*".join(map(re.escape, g.split("*"))) for g in lang.EXCLUDED_GLOBS)
    return ~file_name(path).rlike(f"(?s)^(?:{globs})$")


def supported(path: Column, own=()) -> Column:
    return extension(path).isin([*lang.EXTENSIONS, *extensions_of(own)])


def size_in_bounds(size: Column, max_bytes: int | None = None) -> Column:
    """Not empty and, if the caller sets a limit, not beyond it."""
    return size > 0 if max_bytes is None else (size > 0) & (size <= max_bytes)


def select_files(files: DataFrame, max_bytes: int | None = None, own=()) -> DataFrame:
    """Keep reviewable files: walked directory, wanted name, supported, sized."""
    return files.where(in_walked_dir(F.col("relative_path")) & wanted_name(F.col("relative_path"))
                       & supported(F.col("relative_path"), own) & size_in_bounds(F.col("size"), max_bytes))


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` files per project by path.

    The paths are ranked without the contents; those meet again by project and
    path, so a project with most of the files is no hot key.
    """
    chosen = top_per_group(files.select("project_id", "path"), ["project_id"], [F.col("path")], limit, rank="_rank")
    return files.join(chosen.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")


def list_files(files: DataFrame, limit: int = lang.FILE_LISTING_ROWS) -> DataFrame:
    """Per project: number of files and the first ``limit`` of them."""
    totals = files.groupBy("project_id").agg(F.count("*").alias("total_files"))
    listed = top_per_group(files, ["project_id"], [F.col("path")], limit, rank="position")
    return listed.join(totals, "project_id")


def language_stats(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, total size and share per language, most frequent first.

    Counts are aggregated first; the share uses per-project totals of at most one
    row per language.
    """
    from pyspark.sql import Window

    by = by or []
    counts = files.groupBy(*by, F.coalesce("language", F.lit("Unknown")).alias("language")).agg(
        F.count("*").alias("count"), F.sum("size").alias("total_size"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("percentage", round1(F.col("count") / total * 100)).orderBy(
        *by, F.desc("count"), "language")


def catalogue(spark: SparkSession) -> DataFrame:
    """Supported extensions and their languages."""
    return spark.createDataFrame(list(lang.EXTENSIONS.items()), "extension string, language string")


def readable_size(size: Column) -> Column:
    """Size with unit; every step divides as integers, as in ``1536 -> 1.0 KB``."""
    whole = lambda k: F.floor(size / 1024 ** k)
    shown = lambda k, unit: F.concat(whole(k).cast("string"), F.lit(f".0 {unit}"))
    return (F.when(size < 1024, shown(0, "B")).when(whole(1) < 1024, shown(1, "KB"))
            .when(whole(2) < 1024, shown(2, "MB")).when(whole(3) < 1024, shown(3, "GB"))
            .otherwise(shown(4, "TB")))
