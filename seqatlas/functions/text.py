"""Keys, names and labels as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqatlas.guards import InputError

# Container suffixes of the video files, letters that name a regional
# variant in a file name, and characters a folder name cannot hold.
VIDEO_SUFFIXES = ("npz", "mp4", "avi", "mov", "mkv")
REGION_NAMES = {"N": "Nam", "T": "Trung", "B": "Bac"}
FORBIDDEN_IN_FOLDERS = r'[<>:"/\\|?*]'
EMPTY_FOLDER = "unknown_label"

# Feature groups, tried in this order, by tokens in the column name.
FEATURE_GROUPS = (
    ("handshape", ("angle", "distance_ratio", "palm_width", "openness", "curvature", "handshape")),
    ("movement", ("motion", "velocity", "acceleration", "trajectory", "straightness", "direction_change", "dtw")),
    ("orientation", ("finger_dir", "palm_normal", "orientation")),
    ("spatial relationship", ("location", "head_", "shoulder_", "chest_", "waist_", "body", "face", "left_right")),
    ("structure", ("one_two", "has_left", "has_right")),
)
SECTION_GROUPS = {
    "handshape_features.csv": "handshape",
    "location_video.csv": "location",
    "orientation_video.csv": "orientation",
    "motion_features_per_video.csv": "movement",
}


def dataset_key(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Corpus key: trimmed upper case, missing as '', alternative names unified."""
    key = F.upper(F.trim(F.coalesce(name.cast("string"), F.lit(""))))
    for other, main in (aliases or {}).items():
        key = F.when(key == other, F.lit(main)).otherwise(key)
    return key


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC form; Spark has no built-in for it."""
    return text.str.normalize("NFC")


def text_key(text: Column, compose: bool = True) -> Column:
    """Trimmed label, missing as ''; with ``compose``, in Unicode NFC form.

    Text that is plain ASCII is already composed; the Python function gets NULL for it.
    """
    key = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    if not compose:
        return key
    plain = key.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(plain, key), nfc(F.when(~plain, key)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def video_key(path: Column, suffixes: Sequence[str] | None = None) -> Column:
    """File name without folders and suffix, in lower case.

    ``suffixes`` limits which endings are cut; None cuts any ending.
    """
    name = F.lower(base_name(F.trim(F.coalesce(path.cast("string"), F.lit("")))))
    ending = r"(?<=.)\.[^.]*$" if suffixes is None else rf"\.({'|'.join(suffixes)})$"
    return F.regexp_replace(name, ending, "")


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]+)/[^/]*$", 1)


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, compared without case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def canonical_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename differing source columns to common names; unmatched columns stay."""
    found = {name: find_column(df.columns, options) for name, options in wanted.items()}
    lost = [name for name, col in found.items() if col is None]
    if lost:
        raise InputError(f"no source column for: {', '.join(lost)}")
    used = set(found.values())
    return df.select(
        *[F.col(col).alias(name) for name, col in found.items()],
        *[c for c in df.columns if c not in used and c not in found],
    )


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}__{c}" for c in df.columns if c not in keep})


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def region_of_label(label: Column) -> tuple[Column, Column]:
    """(base label, region letter) of a label that ends in _B, _T or _N, else NULLs."""
    trimmed = F.trim(label)
    return _part(trimmed, r"^(.+)_([BTN])$", 1), _part(trimmed, r"^(.+)_([BTN])$", 2)


def region_of_file(name: Column) -> Column:
    """Regional variant named by the letters between number and suffix of a file name."""
    letter = F.upper(F.regexp_extract(name, r"^[A-Za-z]+\d+([A-Za-z]*)\.[^.]+$", 1))
    variant = F.lit(None).cast("string")
    for key, region in REGION_NAMES.items():
        variant = F.when(letter == key, F.lit(region)).otherwise(variant)
    return variant


def safe_folder(label: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.trim(label), FORBIDDEN_IN_FOLDERS, "_"), F.lit(" ."))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit(EMPTY_FOLDER)).otherwise(cleaned)


def label_tokens(text: Column) -> Column:
    """Upper case with single spaces; any Unicode white space separates tokens."""
    return F.upper(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def resolution(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.concat_ws("x", width.cast("string"), height.cast("string")))


def or_unknown(name: Column, word: str = "unknown") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(word))


def feature_group(name: Column) -> Column:
    """Group of a feature by its name; the first group with a matching token wins."""
    lower = F.lower(name)
    group = F.lit("other")
    for label, tokens in reversed(FEATURE_GROUPS):
        group = F.when(lower.rlike("|".join(tokens)), F.lit(label)).otherwise(group)
    return group


def section_group(section: Column) -> Column:
    group = F.lit("other")
    for ending, label in SECTION_GROUPS.items():
        group = F.when(section.endswith(ending), F.lit(label)).otherwise(group)
    return group


HIGH_BYTES = "".join(map(chr, range(128, 256)))


def fourcc(code: Column) -> Column:
    """Codec tag packed in a 32-bit integer, lowest byte first; NULL when not positive.

    The four bytes are read at once: an expression for each letter would repeat ``code`` so often that the code
    Spark generates is too long to be compiled.
    """
    n = code.cast("long")
    word = F.unhex(F.lpad(F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    letters = F.translate(F.reverse(F.decode(word, "ISO-8859-1")), HIGH_BYTES, "")
    tag = F.btrim(letters, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(n > 0, F.nullif(tag, F.lit("")))
