"""File selection and language detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import long, paths, programs, table
from oracle.base import corpus, round1, text
from reviewlake.functions.text import unify_newlines
from reviewlake.operators import files
from reviewlake.packs import languages as lang
from reviewlake.session import shared_folder
from reviewlake.sources.files import decode, read_files
from reviewlake.sources.tables import PATH_SHAPES
from reviewlake.sources.tree import write_tree

FILE_LIMIT = 20
LISTED = 7

_shapes = ", ".join(f"({i}, {text(d)}, {text(n)}, {text(s)})" for i, (d, n, s) in enumerate(PATH_SHAPES))
_exts = ", ".join(f"({text(k)}, {text(v)})" for k, v in lang.EXTENSIONS.items())
PATHS = (
    f"shapes(ix, dir, name, suffix) AS (VALUES {_shapes}), exts(extension, language) AS (VALUES {_exts}), "
    "named AS (SELECT d.doc_id, d.source AS project_id, s.dir, "
    "CASE WHEN s.name = 'package-lock' THEN s.name ELSE "
    "regexp_extract(s.name, '^([a-z]+)', 1) || d.doc_id || regexp_replace(s.name, '^[a-z]+', '') END || s.suffix AS filename, "
    "CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars END AS size "
    f"FROM documents d JOIN shapes s ON d.doc_id % {len(PATH_SHAPES)} = s.ix), "
    "located AS (SELECT *, CASE WHEN dir = '' THEN filename ELSE dir || '/' || filename END AS relative_path, "
    "lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) AS extension FROM named), "
    "placed AS (SELECT l.*, e.language, '/data/' || project_id || '/' || relative_path AS path "
    "FROM located l LEFT JOIN exts e USING (extension))")
_dirs = ", ".join(map(text, lang.EXCLUDED_DIRS))
WALKED = (f"NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(dir, '/')) AS d) "
          f"WHERE d IN ({_dirs}) OR starts_with(d, '.'))")
GLOBS = ("NOT (filename LIKE '%.min.js' OR filename LIKE '%.min.css' OR filename LIKE '%.map' OR filename LIKE '%.lock' "
         "OR filename IN ('package-lock.json', 'yarn.lock') OR filename LIKE '%.generated.%')")
SIZED = "size > 0"
SELECTED = f"{WALKED} AND {GLOBS} AND language IS NOT NULL AND {SIZED}"


def _paths(select: str) -> str:
    return f"WITH {PATHS} {select}"


def directory_scan(spark, folder):
    """Write every document as a file of its own, byte for byte, some in excluded places; then scan the directory."""
    root = shared_folder(spark, "scan")
    text = F.when(F.col("size") > 0, F.col("text"))  # the others are empty files
    write_tree(paths(spark, folder).select(F.concat_ws("/", F.coalesce("project_id", F.lit("none")), "relative_path").alias("relative_path"), text.alias("content")), root)
    found = read_files(spark, root, F.substring_index("relative_path", "/", 1))
    return found.select("project_id", "filename", "language", "detected_language", *long("size"), F.md5("content").alias("content_md5"))


def prune_dirs(spark, folder):
    return paths(spark, folder).where(files.in_walked_dir(F.col("relative_path"))).select("doc_id", "relative_path")


def drop_globs(spark, folder):
    return paths(spark, folder).where(files.wanted_name(F.col("relative_path"))).select("doc_id", "relative_path")


def keep_supported(spark, folder):
    ext = files.extension(F.col("relative_path"))
    return paths(spark, folder).where(files.supported(F.col("relative_path"))).select("doc_id", ext.alias("extension"))


def size_bounds(spark, folder):
    return paths(spark, folder).where(files.size_in_bounds(F.col("size"))).select("doc_id", "size")


def select_files(spark, folder):
    return files.select_files(paths(spark, folder)).select(
        "doc_id", "project_id", "relative_path", files.pack_language(F.col("path")).alias("language"), "size")


def file_cap(spark, folder):
    return files.first_files(paths(spark, folder), FILE_LIMIT).select("project_id", "path")


def decode_text(spark, folder):
    odd = F.pmod("doc_id", F.lit(2)) == 1
    narrow = F.regexp_replace("text", r"[^\x00-\xff]", "?")
    raw = F.when(odd, F.encode(narrow, "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, folder, "documents").select("doc_id", F.md5(decode(raw)).alias("content_md5"))


def detect_by_extension(spark, folder):
    return paths(spark, folder).select(
        "doc_id", F.coalesce(files.language_of_extension(files.extension(F.col("path"))), F.lit("")).alias("language"))


def detect_header(spark, folder):
    return programs(spark, folder).select("path", files.language_of_header(F.col("content")).alias("language"))


def detect_by_content(spark, folder):
    return programs(spark, folder).select(
        "path", F.coalesce(files.language_of_content(F.col("content")), F.lit("")).alias("language"))


def language_stats(spark, folder):
    chosen = files.select_files(paths(spark, folder)).withColumn("language", files.pack_language(F.col("path")))
    return files.language_stats(chosen)


def project_language_stats(spark, folder):
    chosen = files.select_files(paths(spark, folder)).withColumn("language", files.pack_language(F.col("path")))
    return files.language_stats(chosen, ["project_id"])


def file_listing(spark, folder):
    chosen = files.select_files(paths(spark, folder)).select("project_id", "path", "size")
    return files.list_files(chosen, LISTED).select("project_id", "path", *long("position", "total_files"))


def extension_catalogue(spark, folder):
    """Languages met in the file records, by extension with and without dot, any case."""
    ext = files.extension(F.col("path"))
    bare = F.upper(F.ltrim(ext, F.lit(".")))
    return paths(spark, folder).select(ext.alias("extension"), bare.alias("bare")).distinct().select(
        "extension", F.coalesce(files.language_of_extension(F.col("extension")), F.lit("")).alias("language"),
        F.coalesce(files.language_of_extension(F.col("bare")), F.lit("")).alias("language_of_bare"))


def readable_sizes(spark, folder):
    """Sizes of the documents, scaled up so that every unit occurs."""
    scaled = F.col("n_chars") * F.expr("CAST(power(1024, doc_id % 4) AS BIGINT)")
    return table(spark, folder, "documents").select("doc_id", files.readable_size(scaled).alias("shown"))


_marks = " OR ".join(f"contains(content, {text(m)})" for m in lang.CPP_HEADER_MARKS)
_hints = " ".join(f"WHEN regexp_matches(content, {text(f'(?{fl})' + p)}) THEN {text(n)}"
                  for fl, p, n in lang.CONTENT_HINTS)

_stats = ("count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size, "
          + round1("CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER ({}) AS DOUBLE) * 100") + " AS percentage")

ENTRIES = {
    "scan_directory": (directory_scan, _paths(
        "SELECT coalesce(project_id, 'none') AS project_id, filename, CASE WHEN extension <> '.fish' THEN language END AS language, "
        f"CASE WHEN extension = '.h' THEN CASE WHEN {_marks} THEN 'C++' ELSE 'C' END ELSE language END AS detected_language, "
        "CAST(strlen(text) AS BIGINT) AS size, md5(content) AS content_md5 FROM (SELECT p.*, d.text, regexp_replace(d.text, '\\r\\n?', chr(10), 'g') AS content "
        f"FROM placed p JOIN documents d USING (doc_id)) WHERE {SELECTED} AND strlen(text) > 0")),
    "scan_prune_dirs": (prune_dirs, _paths(f"SELECT doc_id, relative_path FROM placed WHERE {WALKED}")),
    "scan_drop_globs": (drop_globs, _paths(f"SELECT doc_id, relative_path FROM placed WHERE {GLOBS}")),
    "scan_supported_extensions": (keep_supported, _paths("SELECT doc_id, extension FROM placed WHERE language IS NOT NULL")),
    "scan_size_bounds": (size_bounds, _paths(f"SELECT doc_id, size FROM placed WHERE {SIZED}")),
    "scan_select_files": (select_files, _paths(
        "SELECT doc_id, project_id, relative_path, CASE WHEN extension <> '.fish' THEN language END AS language, size "
        f"FROM placed WHERE {SELECTED}")),
    "scan_file_cap": (file_cap, _paths(
        f"SELECT project_id, path FROM placed QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY path) <= {FILE_LIMIT}")),
    "scan_decode_text": (decode_text,
        "SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 2 = 1 THEN regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g') "
        "ELSE text END, '\\r\\n?', chr(10), 'g')) AS content_md5 FROM documents"),
    "detect_by_extension": (detect_by_extension, _paths("SELECT doc_id, coalesce(language, '') AS language FROM placed")),
    "detect_header_language": (detect_header, corpus(
        f"SELECT path, CASE WHEN {_marks} THEN 'C++' ELSE 'C' END AS language FROM files")),
    "detect_by_content": (detect_by_content, corpus(f"SELECT path, CASE {_hints} ELSE '' END AS language FROM files")),
    "language_stats": (language_stats, _paths(
        "SELECT language, " + _stats.replace("{}", "") + " FROM (SELECT CASE WHEN extension = '.fish' THEN 'Unknown' ELSE language END "
        f"AS language, size FROM placed WHERE {SELECTED}) GROUP BY language")),
    "language_stats_by_project": (project_language_stats, _paths(
        "SELECT project_id, language, " + _stats.replace("{}", "PARTITION BY project_id") + " FROM (SELECT project_id, CASE WHEN extension = '.fish' "
        f"THEN 'Unknown' ELSE language END AS language, size FROM placed WHERE {SELECTED}) GROUP BY project_id, language")),
    "project_file_listing": (file_listing, _paths(
        "SELECT project_id, path, position, total_files FROM (SELECT project_id, path, "
        "row_number() OVER (PARTITION BY project_id ORDER BY path) AS position, "
        f"count(*) OVER (PARTITION BY project_id) AS total_files FROM placed WHERE {SELECTED}) WHERE position <= {LISTED}")),
    "extension_catalogue": (extension_catalogue, _paths(
        "SELECT DISTINCT extension, coalesce(language, '') AS language, coalesce(language, '') AS language_of_bare FROM placed")),
    "readable_file_size": (readable_sizes,
        "SELECT doc_id, CASE WHEN s < 1024 THEN s || '.0 B' WHEN s // 1024 < 1024 THEN (s // 1024) || '.0 KB' "
        "WHEN s // 1048576 < 1024 THEN (s // 1048576) || '.0 MB' WHEN s // 1073741824 < 1024 THEN (s // 1073741824) || '.0 GB' "
        "ELSE (s // 1099511627776) || '.0 TB' END AS shown FROM (SELECT doc_id, n_chars * CAST(power(1024, doc_id % 4) AS BIGINT) AS s FROM documents)"),
}
