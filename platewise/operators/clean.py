"""Cleaning and keys of candidate tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default validity rule for text inputs (re-aimed molecule check).
BRACKET_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"))
DISALLOWED_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def _count_char(col: Column, ch: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def default_rule(col: str) -> Column:
    """Reason a text is invalid, or null when valid: empty, unbalanced brackets, bad characters."""
    c = F.col(col)
    reason = F.when(c.isNull() | (F.length(F.trim(c)) == 0), F.lit("empty"))
    for o, cl in BRACKET_PAIRS:
        reason = reason.when(_count_char(c, o) != _count_char(c, cl), F.lit(f"unbalanced {o}{cl}"))
    return reason.when(c.rlike(DISALLOWED_CHARS), F.lit("disallowed character"))


def validate_rows(df: DataFrame, col: str, rule: Callable[[str], Column] = default_rule
                  ) -> tuple[DataFrame, DataFrame]:
    """B2: split into (clean, rejects); rejects carry the reason. One pass, no shuffle."""
    flagged = df.withColumn("reject_reason", rule(col))
    return (flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            flagged.filter(F.col("reject_reason").isNotNull()))


def has_missing(features: str) -> Column:
    """True when the vector is null or holds a null or NaN coordinate."""
    return F.col(features).isNull() | F.exists(features, lambda v: v.isNull() | F.isnan(v))


def drop_nan_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """Drop candidates with any missing (null/NaN) feature; a narrow filter."""
    return df.filter(~has_missing(features))


def _canonical_vector(features: str) -> Column:
    # -0.0 and 0.0 are the same coordinate
    return F.transform(features, lambda v: v + F.lit(0.0))


def dedup_features(df: DataFrame, id_col: str = "candidate_id", features: str = "features") -> DataFrame:
    """Among rows with equal feature vectors keep the one with the lowest id.

    ``min(id)`` grouped by (hash, vector) is a partial aggregate: equal vectors
    collapse map-side, so a vector shared by a third of all rows costs one row
    per map task in the shuffle. The survivors are re-attached by a semi-join on id.
    """
    vec = _canonical_vector(features)
    keep = (df.select(F.col(id_col), vec.alias("__v"))
            .groupBy(F.xxhash64("__v").alias("__h"), "__v").agg(F.min(id_col).alias("__keep")))
    return df.join(keep.select(F.col("__keep").alias(id_col)), id_col, "left_semi")


def remove_rows(df: DataFrame, ids: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Delete the given ids (anti-join; AQE broadcasts the id list when it is small)."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def lookup_original(df: DataFrame, vectors: DataFrame, id_col: str = "candidate_id",
                    features: str = "features", query_id: str = "query_id") -> DataFrame:
    """Map each query vector back to the first (lowest-id) row holding the same vector."""
    first = (df.select(F.col(id_col), _canonical_vector(features).alias("__v"))
             .groupBy(F.xxhash64("__v").alias("__h"), "__v").agg(F.min(id_col).alias("original_id")))
    qv = vectors.select(F.col(query_id), _canonical_vector(features).alias("__v"))
    qv = qv.withColumn("__h", F.xxhash64("__v"))
    return qv.join(first, ["__h", "__v"], "left").select(query_id, "original_id")


def preprocess(df: DataFrame, id_col: str = "candidate_id", features: str = "features") -> DataFrame:
    """Drop rows with missing features, then duplicates (in that order), target kept alongside."""
    return dedup_features(drop_nan_rows(df, features), id_col, features)
