"""Audit of files before a release: names that must not be there, and lines with secrets or home paths.

Lines are told by JVM expressions over a table of lines; files are read by Spark's
binary source, one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules for lines, and names that must not be there (fixed values).
RULES = {
    "absolute-user-home-path": r"(?i)(/Users/[A-Za-z0-9._-]+|/home/[A-Za-z0-9._-]+|C:\\Users\\[A-Za-z0-9._-]+)",
    "secret-assignment": r"""(?i)\b(api[_-]?key|secret|token|password|bearer)\b\s*[:=]\s*['"][^'"\s]{12,}['"]""",
}
DENIED = ("data/*", "obsidian-vault/*", "exports/*", "*.db", "*.sqlite", "*.sqlite3", "*.sqlite3-*", "*.db-*", "*.bak", "*.twz")
ALLOWED = ("data/.gitkeep",)
#: Line ends of text files: the usual ones, form feed and vertical tab, file to record separators, next line, and U+2028 and U+2029.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SNIPPET = 160


def glob(pattern: str) -> str:
    """A whole-string pattern for a file name pattern with * and ?; both cross slashes."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" else "\\" + c) for c in pattern) + "$"


def violations(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, rule, snippet) of ``lines`` (keys, line number ``line``, ``text``) that break a rule;
    the snippet is the start of the line without blanks at its ends."""
    said = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, SNIPPET)
    broken = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in RULES.items()]), lambda r: r.isNotNull())
    return lines.select(*keys, "line", F.explode(broken).alias("rule"), said.alias("snippet"))


def split_lines(text: Column, ends: str = "\n") -> Column:
    """(line, text) from 1; the pattern tells where lines end, and a last empty one is none."""
    found = F.split(text, ends)
    found = F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    return F.transform(found, lambda x, i: F.struct((i + 1).cast("bigint").alias("line"), x.alias("text")))


def audit_files(spark: SparkSession, folder: str, denied: tuple[str, ...] = DENIED, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(path, line, rule, snippet) of the files below ``folder``.

    A file with a denied name is told as such (no line, empty snippet), and its lines
    aren't. Files with a zero byte among their first 4,096 are binary and have no lines;
    bytes that are no UTF-8 count as replacement characters."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    path = F.substring("path", len(root) + 1, 1 << 30)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(path.alias("path"), "content")
    banned = F.lit(False)
    for p in denied:
        banned = banned | F.col("path").rlike(glob(p))
    files = files.where(~F.col("path").isin(*allowed)).withColumn("banned", banned)
    names = files.where("banned").select("path", F.lit(None).cast("bigint").alias("line"), F.lit("tracked-runtime-artifact").alias("rule"), F.lit("").alias("snippet"))
    binary = F.contains(F.substring("content", 1, 4096), F.lit(b"\0"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.where(~F.col("banned") & ~binary).select("path", F.inline(split_lines(text, LINE_ENDS)))
    return violations(rows, "path").unionByName(names)
