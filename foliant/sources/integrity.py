"""Files as content: validation, hashes, lock files, protocol ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = "%PDF-"


def scan_pdfs(spark: SparkSession, path: str, max_bytes: int = 1 << 30, max_pages: int = 10_000) -> DataFrame:
    """path, length, page_count, error of PDF files; error is that of the first
    check that fails (header, size, pages), null if none does. Pages are the page
    objects of the file's plain part; null if the tree is compressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    body = F.decode("content", "ISO-8859-1")
    pages = F.nullif(F.regexp_count(body, F.lit(r"/Type\s*/Page(?![A-Za-z])")), F.lit(0))
    header = F.decode(F.substring("content", 1, len(MAGIC)), "ISO-8859-1") != MAGIC
    rows = files.select("path", "length", F.when(~header, pages).alias("page_count"), header.alias("bad"))
    error = F.when(F.col("bad"), "header").when(F.col("length") > max_bytes, "max_file_size_bytes").when(F.col("page_count") > max_pages, "max_pages")
    return rows.select("path", "length", "page_count", error.alias("error"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame, keys: list[str], name: str = "name", sha: str = "sha256") -> DataFrame:
    """One hash per group of files over their names and hashes in the order of
    names, with the number of files and their bytes."""
    lines = F.sort_array(F.collect_list(F.concat(F.col(name), F.lit("\0"), F.col(sha))))
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("tree"))


def inventory(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Per folder: number and bytes of files, and whether weights and metadata are there."""
    ends = lambda *xs: F.coalesce(F.bool_or(F.lower(name).rlike("(?:" + "|".join(xs) + ")$")), F.lit(False))
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        ends(r"\.pdiparams", r"\.onnx", r"\.pth", r"\.safetensors", r"\.bin").alias("has_weights"), ends(r"\.json", r"\.ya?ml").alias("has_metadata"))


CHECKS = ["schema_version", "corpus_id", "artifacts", "unsafe_path", "missing", "size", "sha256"]


def verify_lock(lock: DataFrame, files: DataFrame, schema_version: str, corpus_id: str, wanted: list[str]) -> DataFrame:
    """lock_id and the first failing check, null if all pass.

    ``lock`` has lock_id, schema_version, corpus_id and artifacts (map of key to
    path, size_bytes, sha256); ``files`` has path, length, sha256, one row each.
    Checks come in the order of CHECKS; of the artifacts the first key that fails
    counts, in the order of ``wanted``."""
    keys = F.sort_array(F.coalesce(F.map_keys("artifacts"), F.array().cast("array<string>")))
    head = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema_version")
        .when(~F.col("corpus_id").eqNullSafe(F.lit(corpus_id)), "corpus_id")
        .when(keys != F.array(*map(F.lit, sorted(wanted))), "artifacts")
    )
    rows = lock.select("lock_id", head.alias("head"), F.explode_outer("artifacts").alias("key", "a"))
    met = rows.join(files.withColumnsRenamed({"path": "_path", "length": "_length", "sha256": "_sha"}), F.col("a.path") == F.col("_path"), "left")
    unsafe = F.col("a.path").startswith("/") | F.array_contains(F.split("a.path", "/"), "..")
    one = (
        F.when(F.col("head").isNotNull(), F.col("head")).when(unsafe, "unsafe_path").when(F.col("_path").isNull(), "missing")
        .when(~F.col("_length").eqNullSafe(F.col("a.size_bytes")), "size").when(~F.col("_sha").eqNullSafe(F.col("a.sha256")), "sha256")
    )
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("key"))
    return met.withColumns({"_e": one, "_p": place}).groupBy("lock_id").agg(F.min_by("_e", F.when(F.col("_e").isNotNull(), F.coalesce("_p", F.lit(0)))).alias("error"))


# The body of the comparison protocol.
PROTOCOL = {
    "comparison_kind": "deployment_profile",
    "corpus_policy": "identical-pdf-reference-and-manifest-hashes",
    "page_selection_policy": "identical-explicit-pages-or-all-pages",
    "protocol": "ocr-deployment-profile-v1",
}


def protocol_id(language: Column, mode: Column, quality_policy: Column) -> Column:
    """SHA-256 of the protocol as JSON with sorted keys and no spaces."""
    body = {k: F.lit(v) for k, v in PROTOCOL.items()} | {"language": language, "mode": mode, "quality_policy": quality_policy}
    return F.sha2(F.to_json(F.struct(*[body[k].alias(k) for k in sorted(body)])), 256)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one file whole or not at all: under another name beside it, then renamed
    over it through Spark's file system, so readers see the old or the new text."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID().toString()}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, target, over)
