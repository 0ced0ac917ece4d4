"""Label catalogues, CSV files of mixed encodings, file lists and probe output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seqatlas.distribution import salted_join
from seqatlas.functions import text as X
from seqatlas.guards import InputError, must_hold, require_columns
from seqatlas.session import cut_lineage

BOM = "﻿"

# Video container suffixes.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "m4v")


def _vietnamese_table() -> tuple[str, str, str]:
    """Latin-1 letters, their code page 1258 readings, and the bytes 1258 leaves undefined."""
    source, target, undefined = [], [], []
    for code in range(128, 256):
        try:
            letter = bytes([code]).decode("cp1258")
        except UnicodeDecodeError:
            undefined.append(chr(code))
            continue
        if letter != chr(code):
            source.append(chr(code))
            target.append(letter)
    return "".join(source), "".join(target), "".join(undefined)


def _open_quotes(line: Column) -> Column:
    """An odd number of quotes: a quoted field goes on in the next line."""
    return F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'))), F.lit(2)) == 1


def _split_line(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda h: F.trim(F.regexp_replace(h, '^\\s*"|"\\s*$', "")))


def read_csv_any_encoding(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files in UTF-8 (with or without byte-order mark), code page 1258 or Latin-1.

    Every file has its own header, its first line; columns are matched by name without regard
    to case, in any order, and one that a file lacks is NULL. Without ``columns`` the names are those
    of the first file by path. The encoding is decided per file from all of its lines. Lines
    are split and decoded by Spark, so a large file is read in parallel. Only files with a quoted field that
    spans lines are read again as a whole, each by one task, in the encoding found. Values stay text;
    ``_encoding`` tells what was used.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    # The numbers of the lines must not be drawn twice.
    lines = cut_lineage(lines)
    source, target, undefined = _vietnamese_table()
    as_latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in undefined) + "]"
    files = lines.groupBy("_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.bool_or(F.when(~F.is_valid_utf8("value"), as_latin.rlike(pattern)).otherwise(False)).alias("_not_1258"),
        F.min(F.when((F.col("_block") == 0) & (F.length(F.trim("value")) > 0), F.col("_at"))).alias("_first"),
        F.bool_or(_open_quotes(as_latin)).alias("_spans"),
    )
    encoding = F.when(F.col("_utf8"), "utf-8").when(~F.col("_not_1258"), "cp1258").otherwise("latin1")
    decoded = (
        F.when(F.col("_encoding") == "utf-8", F.regexp_replace("value", f"^{BOM}", ""))
        .when(F.col("_encoding") == "cp1258", F.translate(as_latin, source, target))
        .otherwise(as_latin)
    )
    line = F.regexp_replace(decoded, "\r$", "")
    # The number of a line is unique: its header finds a file without gathering its lines.
    headers = lines.filter(F.col("_block") == 0).select(F.col("_at").alias("_first"), "value")
    files = files.withColumn("_encoding", encoding).join(headers, "_first").select("_file", "_first", "_spans", "_encoding", _split_line(line).alias("_head"))
    files = cut_lineage(files)
    # A file's lines meet its row block by block, so that no task sorts a whole file.
    blocks = lines.select("_file", "_block").distinct().join(files, "_file")
    marked = lines.join(blocks, ["_file", "_block"])
    marked = marked.select("_at", "_first", "_encoding", "_spans", "_head", line.alias("_line")).filter(F.length(F.trim("_line")) > 0)
    # One row, whatever the number of files.
    shape = files.agg(F.max(F.size("_head")).alias("width"), F.min_by("_head", "_file").alias("names")).first()
    if shape["width"] is None:
        raise InputError("the CSV files are empty")
    names, width = list(columns) if columns else shape["names"], shape["width"]
    fields = ", ".join(f"_c{i} string" for i in range(width))
    rows = marked.filter((F.col("_at") != F.col("_first")) & ~F.col("_spans"))
    parsed = rows.select("_encoding", "_head", F.from_csv("_line", F.lit(fields), {"quote": '"', "escape": '"'}).alias("_r"))
    values = F.array(*[F.col(f"_r._c{i}") for i in range(width)])
    joined = parsed.select("_encoding", "_head", values.alias("_values"))
    # The names of the files that are read as a whole; there are as many as such files.
    whole: dict[str, list[str]] = {}
    for row in files.filter("_spans").select("_file", "_encoding").collect():
        whole.setdefault(row["_encoding"], []).append(row["_file"])
    for name, paths_ in sorted(whole.items()):
        records = _records(spark, paths_, name, width)
        joined = joined.unionByName(salted_join(records, files.filter("_spans").select("_file", "_head"), ["_file"], salt_on=["_values"]).drop("_file"))
    joined = joined.withColumn("_head", F.transform("_head", lambda h: F.lower(h)))
    place = lambda n: F.array_position("_head", F.lit(n.lower())).cast("int")
    return joined.select(*[F.when(place(n) > 0, F.get("_values", place(n) - 1)).alias(n) for n in names], "_encoding")


def _records(spark: SparkSession, paths: Sequence[str], encoding: str, width: int) -> DataFrame:
    """(_file, _encoding, _values) of the records of whole files, without their headers."""
    fields = ", ".join(f"_c{i} string" for i in range(width))
    charset = "UTF-8" if encoding == "utf-8" else "ISO-8859-1"
    # A file with line breaks in fields is never split; the reader drops its first record, the header.
    reader = spark.read.schema(fields).options(multiLine="true", header="true", enforceSchema="true", quote='"', escape='"', encoding=charset)
    body = reader.csv(list(paths)).select("*", F.col("_metadata.file_path").alias("_file"))
    source, target, _ = _vietnamese_table()
    # Spark's reader does not know code page 1258: its letters are translated from Latin-1 as in split lines.
    letters = lambda c: F.translate(c, source, target) if encoding == "cp1258" else c
    clean = lambda c: letters(F.regexp_replace(c, "\r$", ""))
    return body.select("_file", F.lit(encoding).alias("_encoding"), F.array(*[clean(F.col(f"_c{i}")) for i in range(width)]).alias("_values"))


def discover_files(spark: SparkSession, roots: Sequence[str], pattern: str = "*.csv", skip: str | None = None) -> DataFrame:
    """Paths below the roots that match the pattern, each once, without the skipped tree."""
    found = None
    for root in roots:
        one = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .load(root)
            .select("path", "length")
        )
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise InputError("no root folders given")
    if skip:
        inside = skip.rstrip("/") + "/"
        found = found.filter(~F.contains(F.col("path"), F.lit(inside)))
    return found.dropDuplicates(["path"]).orderBy("path")


def labels_flat(df: DataFrame) -> DataFrame:
    """Flat catalogue: VIDEO and LABEL in any case, trimmed, rows with blanks dropped."""
    video, label = (X.find_column(df.columns, [c]) for c in ("video", "label"))
    if video is None or label is None:
        raise InputError("a label catalogue needs the columns VIDEO and LABEL")
    rest = [c for c in df.columns if c not in (video, label)]
    return (
        df.select(*rest, F.trim(F.col(video).cast("string")).alias("video"), F.trim(F.col(label).cast("string")).alias("label"))
        .filter((F.col("video") != "") & (F.col("label") != ""))
    )


def read_labels_nested(spark: SparkSession, path: str) -> DataFrame:
    instance = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("signer_id", T.LongType())])
    schema = T.StructType([T.StructField("gloss", T.StringType()), T.StructField("instances", T.ArrayType(instance))])
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def labels_nested(df: DataFrame) -> DataFrame:
    """Nested catalogue (gloss, instances) to (video_id, gloss, signer_id); entries without
    gloss or video are skipped."""
    require_columns(df, ["gloss", "instances"], "nested catalogue")
    return (
        df.filter(F.trim("gloss") != "")
        .select(F.trim("gloss").alias("gloss"), F.explode("instances").alias("_i"))
        .select(F.trim(F.col("_i.video_id").cast("string")).alias("video_id"), "gloss", F.col("_i.signer_id").alias("signer_id"))
        .filter(F.col("video_id") != "")
    )


def existing_labels(labels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Catalogue rows whose file exists."""
    return labels.join(files.select(key), key, "left_semi")


def missing_labels(labels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return labels.join(files.select(key), key, "left_anti")


def file_inventory(files: DataFrame, path: str = "path", extensions: Sequence[str] | None = VIDEO_EXTENSIONS) -> DataFrame:
    """Number of files per folder and (lower-case) extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = files.select(X.parent_folder(F.col(path)).alias("folder"), ext.alias("extension"))
    if extensions is not None:
        rows = rows.filter(F.col("extension").isin(*extensions))
    return rows.groupBy("folder", "extension").agg(F.count(F.lit(1)).alias("files"))


def path_metadata(path: Column) -> tuple[Column, Column]:
    """(label, file name): the parent folder and the last part of a path."""
    return X.parent_folder(path), X.base_name(path)


def label_map(entries: DataFrame, key: str, label: str) -> DataFrame:
    """Two-column map (key, label); whole numbers also answer to ``class_0007``."""
    base = entries.select(F.trim(F.col(key).cast("string")).alias("key"), F.col(label).cast("string").alias("label"))
    alias = base.filter(F.col("key").rlike(r"^\d+$")).select(
        F.format_string("class_%04d", F.col("key").cast("long")).alias("key"), "label"
    )
    return base.unionByName(alias).groupBy("key").agg(F.min("label").alias("label"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label map from a JSON object, a two-column CSV, or text lines ``<number> <label>``."""
    lines = spark.read.text(path).withColumn("value", F.trim(F.regexp_replace("value", f"^{BOM}", "")))
    if path.lower().endswith(".json"):
        pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")))
        return label_map(pairs, "key", "value")
    if path.lower().endswith(".csv"):
        table = spark.read.csv(path, header=True)
        return label_map(table, *table.columns[:2])
    parts = lines.filter("value <> ''").select(
        F.regexp_extract("value", r"^(\d+)\s+(.*)$", 1).alias("k"), F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2).alias("v")
    )
    return label_map(parts.filter("k <> ''"), "k", "v")


def resolve_labels(df: DataFrame, mapping: DataFrame, *, raw: str, path: str, into: str = "label") -> DataFrame:
    """Label of a sample: its stored label through the map (or as it is); without one,
    the first of parent folder, file stem and ``class_<n>`` in the path that the map
    knows; else the parent folder, else the stem."""
    stored = F.regexp_replace(F.col(raw).cast("string"), r"^(\d+)\.0$", "$1")
    stem = F.regexp_replace(X.base_name(F.col(path)), r"(?<=.)\.[^.]*$", "")
    parent = X.parent_folder(F.col(path))
    small = mapping
    keyed = df.withColumns(
        {
            "_k0": stored,
            "_k1": parent,
            "_k2": stem,
            "_k3": F.regexp_extract(path, r"(class_\d+)", 1),
        }
    )
    for i in range(4):
        keyed = keyed.join(
            small.select(F.col("key").alias(f"_k{i}"), F.col("label").alias(f"_l{i}")), f"_k{i}", "left"
        )
    inferred = F.coalesce("_l1", "_l2", "_l3", F.nullif("_k1", F.lit("")), "_k2")
    label = F.when(F.col("_k0").isNotNull(), F.coalesce("_l0", "_k0")).otherwise(inferred)
    return keyed.withColumn(into, label).drop(*[f"_{a}{i}" for a in "kl" for i in range(4)])


PROBE_SCHEMA = """struct<streams: array<struct<codec_name: string, width: int, height: int,
    r_frame_rate: string, nb_frames: string, duration: string>>>"""


def probe_metadata(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed fields from the JSON of a container probe.

    The frame rate is numerator over denominator; a missing frame count is duration times
    rate, a missing duration frame count over rate. Without rate or frame count the file is
    unreadable and all its numbers are NULL.
    """
    stream = F.get(F.from_json(F.col(payload), PROBE_SCHEMA)["streams"], F.lit(0))
    s = df.withColumn("_s", stream)
    part = lambda i: F.get(F.split("_s.r_frame_rate", "/"), F.lit(i)).try_cast("double")
    fps = F.nullif(F.try_divide(part(0), part(1)), F.lit(0.0))
    duration = F.col("_s.duration").try_cast("double")
    frames = F.coalesce(F.col("_s.nb_frames").try_cast("long"), F.bround(duration * fps).cast("long"))
    s = s.withColumns({"_fps": fps, "_frames": frames})
    readable = F.col("_fps").isNotNull() & F.col("_frames").isNotNull()
    only = lambda c: F.when(readable, c)
    return s.select(
        *df.columns,
        only(F.coalesce(duration, F.col("_frames") / F.col("_fps"))).alias("duration_seconds"),
        only(F.col("_frames")).alias("frame_count"),
        only(F.col("_fps")).alias("fps"),
        only(F.col("_s.width")).alias("width"),
        only(F.col("_s.height")).alias("height"),
        only(F.col("_s.codec_name")).alias("codec"),
        F.coalesce(readable, F.lit(False)).alias("readable"),
    )


def schema_listing(lines: DataFrame, order: str, value: str, *, section: str, column: str, group: Sequence[str] = ()) -> DataFrame:
    """(section, column) rows of a prose listing: a column line belongs to the nearest
    section line above it. The patterns have one group each.

    A listing is a document; ``group`` names the columns that identify it.
    """
    from pyspark.sql import Window

    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract(value, section, 1), F.lit(""))
    field = F.nullif(F.regexp_extract(value, column, 1), F.lit(""))
    return (
        lines.withColumn("section", F.last(name, ignorenulls=True).over(above))
        .withColumn("column", F.when(name.isNull(), field))
        .filter(F.col("column").isNotNull() & F.col("section").isNotNull())
    )


def whitelist_report(columns: Sequence[str], allowed: Sequence[str]) -> Mapping[str, list[str]]:
    """Which allowed columns a table has or lacks, and which of its columns are ignored."""
    present = set(columns)
    return {
        "used": [c for c in allowed if c in present],
        "missing": [c for c in allowed if c not in present],
        "ignored": [c for c in columns if c not in set(allowed)],
    }
