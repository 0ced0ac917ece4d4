"""Numeric columns: cleaning, selection, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqatlas.guards import require_any_numeric

# Columns that identify rows rather than describe them.
IDENTIFIERS = ("dataset", "gloss", "label", "video", "video_key", "path", "file", "hand", "error", "sample_id", "sample_index")


def finite(value: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """NULL for every NaN or infinite value of the floating-point columns."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in floating})


def numeric_columns(
    df: DataFrame,
    *,
    exclude: Sequence[str] = IDENTIFIERS,
    prefixes: Sequence[str] = (),
    exact: Sequence[str] = (),
) -> list[str]:
    """Numeric columns that are no identifiers, optionally limited by prefix or name."""
    skip = {c.lower() for c in exclude}
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]
    if prefixes or exact:
        found = [c for c in found if c in exact or any(c.startswith(p) for p in prefixes)]
    return found


def select_numeric(df: DataFrame, keys: Sequence[str], features: Sequence[str] | None = None, **rules) -> DataFrame:
    """Keys plus numeric features as doubles; text that is no number becomes NULL."""
    chosen = list(features) if features is not None else numeric_columns(df, **rules)
    chosen = [c for c in chosen if c not in keys]
    require_any_numeric(chosen)
    return df.select(*keys, *[finite(F.col(c).try_cast("double")).alias(c) for c in chosen])


def similarity_score(cosine: Column) -> Column:
    return (cosine + 1) / 2


def score_band(score: Column, high: float = 0.7, moderate: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= moderate, "moderate").when(score.isNotNull(), "low")


def spread_band(std: Column, limit: float = 0.15) -> Column:
    return F.when(std > limit, "dispersed").otherwise("concentrated")


def directed_minmax(value: Column, means: Sequence[Column], stds: Sequence[Column], lower_is_better: Column) -> Column:
    """Scale to [0, 1], 1 being better, on the span of mean±std of all corpora.

    Only positive bounds count; an empty or narrow span gives 0.5.
    """
    ends = F.array(*[e for m, s in zip(means, stds) for e in (m - s, m + s)])
    ends = F.filter(ends, lambda e: e > 0)
    low, high = F.array_min(ends), F.array_max(ends)
    scaled = (value - low) / (high - low)
    turned = F.when(lower_is_better, 1 - scaled).otherwise(scaled)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), turned))
    return F.when((F.size(ends) == 0) | (high - low < 1e-4), F.lit(0.5)).otherwise(clipped)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or missing."""
    return F.when(b != 0, a / b)
