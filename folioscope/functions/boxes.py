"""Bounding-box arithmetic: boxes are structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def v_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def v_gap(a: Column, b: Column) -> Column:
    return F.when(a["y1"] < b["y0"], b["y0"] - a["y1"]).when(b["y1"] < a["y0"], a["y0"] - b["y1"]).otherwise(F.lit(0.0))


def hits_seed(line: Column, seed: Column, slop: float = 4.0) -> Column:
    over = F.least(line["x1"], seed["x1"] + slop) - F.greatest(line["x0"], seed["x0"] - slop)
    return (over > 0) & (over >= F.least(F.lit(6.0), 0.2 * F.greatest(F.lit(1.0), line["x1"] - line["x0"])))


def same_column(width: float, a: Column, b: Column) -> Column:
    return (a["x0"] >= width * 0.5 - 12.0) == (b["x0"] >= width * 0.5 - 12.0)


def display_number(width: float, a: Column) -> Column:
    wide = F.greatest(F.lit(1.0), a["x1"] - a["x0"]) > width * 0.12
    return F.when(wide, F.lit(False)).when(a["x0"] >= width * 0.5 - 12.0, a["x0"] >= width * 0.7).otherwise(a["x1"] >= width * 0.5 - width * 0.04)


def right_bias(a: Column) -> Column:
    return F.when(a["x0"] >= 350, F.lit(0.12)).when(a["x0"] >= 250, F.lit(0.06)).otherwise(F.lit(0.0))


def issues(a: Column, page: Column, width: float, height: float, margin: float = 4.0) -> Column:
    """Why a box can't be trusted, in order; empty if it can."""
    why = F.array(
        F.when(page.isNull(), "missing_page"), F.when((a["x1"] <= a["x0"]) | (a["y1"] <= a["y0"]), "degenerate_bbox"),
        F.when((a["x0"] < margin) | (a["x1"] > width - margin), "bbox_near_x_edge"), F.when((a["y0"] < margin) | (a["y1"] > height - margin), "bbox_near_y_edge"),
    )
    return F.filter(why, lambda x: x.isNotNull())


def rounded(a: Column, digits: int = 1) -> Column:
    return F.struct(*[F.bround(a[c].cast("double"), digits).alias(c) for c in ("x0", "y0", "x1", "y1")])


def vertically_distinct(a: Column, b: Column, least: float = 22.0) -> Column:
    """Whether the middles of two boxes lie further apart than ``least``, up or down."""
    return F.abs((a["y0"] + a["y1"]) * 0.5 - (b["y0"] + b["y1"]) * 0.5) > least
