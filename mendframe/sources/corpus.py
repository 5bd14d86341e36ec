"""Blobs: files of a folder, a stream of new files, and a deterministic corpus made of the documents table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.catalog import table
from mendframe.functions.kinds import KIND_OF_EXTENSION

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])
PACKETS = ("47" + "00" * 187) * 5

# (extension, bytes before the text, bytes after it) by variant, in hexadecimal
VARIANTS = [
    (".jpg", "FFD8FFE00010FFDB0043FFC00011FFC4001FFFDA000C", "FFD9"),
    (".jpg", "FFD8FFE00010FFDB0043FFC00011FFC4001FFFDA000C", ""),
    (".jpg", "FFDB0043FFC00011FFC4001FFFDA000C", "FFD9"),
    (".jpg", "FFD8FFDB0043FFC00011FFDA000C", "FFD9"),
    (".jpg", "FFD8", "FFD9"),
    (".jpg", "", ""),
    (".png", "89504E470D0A1A0A0000000D49484452", "0000000049454E44AE426082"),
    (".gif", "474946383961", "3B"),
    (".bmp", "424D80000000", ""),
    (".tif", "49492A0008000000", ""),
    (".webp", "524946468000000057454250", ""),
    (".avi", "5858524946468000000041564920", ""),
    (".bin", "47415242414745000000146674797069736F6D", ""),
    (".mp4", "000000146674797069736F6D", ""),
    (".mkv", "1A45DFA30000", ""),
    (".bin", "58581A45DFA300007765626D", ""),
    (".flv", "464C5601", ""),
    (".wmv", "3026B2758E66CF11A6D900AA0062CE6C", ""),
    (".mpg", "000001BA44", ""),
    (".txt", "", ""),
    (".jpg", "FFD8FFDB0043", "FFD9"),
    (".avi", "524946468000000041564920", ""),
    (".ts", PACKETS, ""),
    (".bin", "000000" + PACKETS, ""),
    (".dng", "", ""),
    (".heic", "000000186674797068656963", ""),
    (".jp2", "0000000C6A5020200D0A870A", ""),
    (".jpg", "FFD8" + "FFD8FFDA" * 40, "FFD9" * 10),
    (".png", "89504E470D0A1A0A", "FFD8"),
    (".jpg", "FFC00011FFD0FFD1FFD2", "FFD9"),
    (".MOV", "000000146674797071742020", ""),
    (".gif", "474946383761", "2C003B"),
    (".tiff", "4D4D002A00000008", "49492A00"),
    (".mp4", "", ""),
    ("", "89504E470D0A1A0A0000000D49484452", "49444154"),
    (".avif", "5858000000186674797061766966", ""),
]


def kind_by_extension(extension: Column) -> Column:
    """The declared kind of a lower-case extension without its dot, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in KIND_OF_EXTENSION.items() for x in pair]), extension)


def declared_kind(path: Column) -> Column:
    return kind_by_extension(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def files(spark: SparkSession, folder: str, recursive: bool = False, all_files: bool = False, complete: bool = False) -> DataFrame:
    """Files of a folder as blobs (path, content), only those of a known extension unless all_files.

    The extension filter is on the path, so contents of other files are never read. Order isn't part of a DataFrame;
    sort by path where it matters. Spark's listing leaves out empty files and those whose names begin with a dot or an
    underscore; complete adds them, by a listing on the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not complete:
        return _blobs(found.load(folder), all_files)
    hidden, empty = _left_out(spark, folder, recursive)
    own = _blobs(found.schema(FILE_SCHEMA).load(folder), all_files)
    if hidden:
        own = own.unionByName(_blobs(spark.read.format("binaryFile").load(hidden), all_files))
    nothing = spark.createDataFrame([(p,) for p in empty], "path string").withColumn("content", F.lit(b""))
    return own.unionByName(_blobs(nothing, all_files))


def _left_out(spark: SparkSession, folder: str, recursive: bool) -> tuple[list[str], list[str]]:
    """Paths of files that Spark's listing leaves out: hidden ones, and empty ones."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.getFileStatus(root).getPath()
    above = len(root.toString().rstrip("/"))
    hidden, empty, listed = [], [], system.listFiles(root, recursive)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toString()
        if status.getLen() == 0:
            empty.append(path)
        elif any(part[:1] in "._" for part in path[above:].strip("/").split("/")):
            hidden.append(path)
    return hidden, empty


def new_files(spark: SparkSession, folder: str, all_files: bool = False) -> DataFrame:
    """The same as a stream: each file once, as it arrives."""
    return _blobs(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder), all_files)


def _blobs(found: DataFrame, all_files: bool) -> DataFrame:
    kept = found if all_files else found.where(declared_kind(F.col("path")).isNotNull())
    return kept.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blob (doc_id, variant, path, content) of each document: its whole text between the bytes of a variant."""
    shapes = F.array(*[F.struct(F.lit(e).alias("ext"), F.unhex(F.lit(a)).alias("before"), F.unhex(F.lit(b)).alias("after")) for e, a, b in VARIANTS])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    variant = F.pmod(F.col("doc_id"), F.lit(len(VARIANTS))).cast("int")
    shaped = docs.withColumn("variant", variant).withColumn("shape", F.get(shapes, F.col("variant")))
    number = F.col("doc_id").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))
    return shaped.select(
        "doc_id", "variant", F.concat(F.lit("f"), padded, F.col("shape.ext")).alias("path"),
        F.concat(F.col("shape.before"), F.encode("text", "UTF-8"), F.col("shape.after")).alias("content"),
    )
