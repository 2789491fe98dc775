"""Emberline: satellite fire detections to labelled training tables, as Spark DataFrame operators."""

from emberline.plans.jobs import (
    audit,
    build_environment,
    clean_cover,
    feature_join,
    fetch_fires,
    label_union,
    label_union_by_year,
    merge_features,
    profile,
)

__all__ = [
    "audit",
    "build_environment",
    "clean_cover",
    "feature_join",
    "fetch_fires",
    "label_union",
    "label_union_by_year",
    "merge_features",
    "profile",
]
