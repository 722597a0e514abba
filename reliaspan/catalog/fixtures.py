"""Inputs shared by several queries: segment edges of the main panel and the cohort attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.operators.connectivity import fc_edges, side_by_side
from reliaspan.operators.slices import label_segments
from reliaspan.sources.panels import N_MONTHS, SHORT_ROWS, lineitem_frames

K_FULL = N_MONTHS / SHORT_ROWS


def segment_conditions(names=("short", "rest", "full")):
    t = F.col("t")
    every = {"short": t < SHORT_ROWS, "rest": t >= SHORT_ROWS, "full": F.lit(True)}
    return {n: every[n] for n in names}


def segment_edges(spark, sf_dir, kind="pearson", segments=("short", "full"), fisher=False, constant=None):
    """(subject_id, seg, i, j, r) for several segments of one scan."""
    frames = label_segments(lineitem_frames(spark, sf_dir), segment_conditions(segments))
    return fc_edges(frames, ["subject_id", "seg"], kind, fisher, constant)


def segment_pairs(spark, sf_dir, kind="pearson", segments=("short", "full"), fisher=False, constant=None):
    """(subject_id, i, j, one column per segment)."""
    edges = segment_edges(spark, sf_dir, kind, segments, fisher, constant)
    return side_by_side(edges, ["subject_id"], "seg", segments)


def with_attributes(df):
    """Attributes are arithmetic on the subject key, so they attach without a join."""
    sid = F.col("subject_id")
    site = (sid % 5).cast("int")
    return df.withColumns({"grp": (sid % 2).cast("int"), "site": site, "tr": F.lit(2.0) + F.lit(0.5) * (site % 2)})


def short_frames(spark, sf_dir):
    """The short window, labelled rather than filtered below the panel aggregation, so that a query
    that also needs the rest of the recording reuses the panel's shuffle instead of a second scan."""
    marked = label_segments(lineitem_frames(spark, sf_dir), segment_conditions(("short", "rest")))
    return marked.filter(F.col("seg") == "short").drop("seg")
