"""Source files as rows: discovery, reading, lines (sources 1 to 4, 10 and 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.language import known_extensions
from sieveline.functions.text import extension

# Folders that discovery skips, by mode; the upload form's endings and size.
SKIPPED = {
    "full": ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target", ".git", ".svn", ".hg", "vendor"],
    "hidden": ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target", "vendor"],
    "plain": ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target"],
}
UPLOAD_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".cs", ".php", ".rb"]
UPLOAD_BYTES = 10 * 1024 * 1024


def _escaped(name: str) -> str:
    return name.replace(".", r"\.")


def in_skipped_folder(path: Column, mode: str = "full") -> Column:
    """Does a path run through a skipped folder? full: 11 names; hidden and plain: fewer names, and all dot folders."""
    names = "|".join(map(_escaped, SKIPPED[mode]))
    dots = "" if mode == "full" else r"|\.[^/.][^/]*"
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(rf"(?:^|/)(?:{names}{dots})/")


def discover(files: DataFrame, path: str = "path", mode: str = "full", extensions: list[str] | None = None) -> DataFrame:
    """The files a scan reads: known endings, outside skipped folders (sources 1 to 3). A filter on the path alone, so it
    reaches the scan of the listing and no content is read for what is left out."""
    return files.filter(extension(F.col(path)).isin(extensions or known_extensions()) & ~in_skipped_folder(F.col(path), mode))


def read_folder(spark: SparkSession, folder: str, mode: str = "full") -> DataFrame:
    """(path, content, size) of a folder tree; a single file with an unknown ending gives no row.

    Spark's listing itself leaves out files and folders whose names begin with '.' or '_'.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return discover(files, "path", mode).select("path", text_of(F.col("content")).alias("content"), F.col("length").alias("size"))


def text_of(content: Column) -> Column:
    """Bytes as text, invalid UTF-8 dropped instead of failing the query (source 4)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def lines(files: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """One row per line, 1-based; a final line end opens an empty last line, carriage returns stay."""
    return files.select(*keep, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def uploads(files: DataFrame, name: str = "filename", size: str = "size") -> DataFrame:
    """What the upload form takes: its endings, up to 10 MB (source 10)."""
    return files.filter(extension(F.col(name)).isin(UPLOAD_EXTENSIONS) & (F.col(size) <= UPLOAD_BYTES))


def first_of_name(files: DataFrame, name: str, by: list[str], within: list[str] | None = None) -> DataFrame:
    """The first file of each name (source 11): one min over a struct, combined before the shuffle, no window."""
    rest = [c for c in files.columns if c not in {name, *by, *(within or [])}]
    keys = [*(within or []), name]
    first = files.groupBy(*keys).agg(F.min(F.struct(*by, *rest)).alias("f"))
    return first.select(*keys, "f.*").select(*files.columns)

