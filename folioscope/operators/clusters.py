"""Growth of a numbered formula from its line over the pieces around it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import layout as ly

_OUT = "doc_id long, page long, ord long"


#: Line pairs that are looked at at once.
PAIRS = 1 << 19
_LINE = "x0 y0 x1 y1 left right seed0 seed2 number target fragment prose".split()


def _grow(page: dict[str, np.ndarray], real: np.ndarray, close: float, reach: float, band: float) -> np.ndarray:
    """Which lines belong to the target's formula: pages by lines, in order; ``real`` tells lines from filling."""
    x0, y0, x1, y1 = (page[c] for c in ("x0", "y0", "x1", "y1"))
    rows, target = np.arange(len(x0)), np.argmax(page["target"] & real, axis=1)
    at = lambda v: v[rows, target][:, None]
    number, some = page["number"], (page["target"] & real).any(axis=1)
    own = at(number)
    foreign = (number != "") & (own != "") & (number != own) & real
    inside = (x0 <= at(x1) + 8.0) & (x1 >= page["left"] - 1.0) & (x0 <= page["right"] + 1.0) & ~foreign & real
    # vertical distance of each line to each other one; 0 where they meet
    apart = np.maximum(0.0, np.maximum(y0[:, None, :] - y1[:, :, None], y0[:, :, None] - y1[:, None, :]))
    other = np.where(foreign[:, None, :], apart, np.inf).min(axis=2)
    seed0, seed1 = page["seed0"] - 8.0, page["seed2"] + 8.0
    shared = np.minimum(x1, seed1) - np.maximum(x0, seed0)
    on_seed = (shared > 0) & (shared >= np.minimum(6.0, 0.2 * np.maximum(1.0, x1 - x0)))
    able, taken = page["fragment"] & inside, np.zeros(x0.shape, bool)
    taken[rows, target] = some
    before = None
    while before is None or (taken.sum(axis=1) != before).any():
        before = taken.sum(axis=1)
        low, high = np.where(taken, x0, np.inf).min(axis=1), np.where(taken, x1, -np.inf).max(axis=1)
        for i in np.flatnonzero((able & ~taken & some[:, None]).any(axis=0)):
            d = np.where(taken, apart[:, i, :], np.inf).min(axis=1)
            beside = (x0[:, i] <= high + close) & (x1[:, i] >= low - close)
            taken[:, i] |= able[:, i] & some & (d <= reach) & (other[:, i] + 1.0 >= d) & (beside | on_seed[:, i])
    middle = 0.5 * (y0 + y1)
    return taken | (~page["prose"] & inside & (np.abs(middle - at(middle)) <= band) & some[:, None])


def _pages(close: float, reach: float, band: float):
    """Batches sorted by page and line: pages of alike many lines are grown together, some at a time."""

    def grown(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in _LINE}
        columns = {c: v.astype(str) if c == "number" else v.astype(bool if c in ("target", "fragment", "prose") else float) for c, v in columns.items()}
        first, sizes = _bounds(table)
        keep = np.zeros(table.num_rows, bool)
        wide = np.ceil(np.log2(sizes)).astype(int)
        for w in np.unique(wide):
            lines = np.arange(1 << w)
            pages = np.flatnonzero(wide == w)
            some = max(1, PAIRS >> (2 * w))
            for k in range(0, len(pages), some):
                mine = pages[k : k + some]
                real = lines[None, :] < sizes[mine][:, None]
                at = first[mine][:, None] + np.where(real, lines[None, :], 0)
                keep[at[real]] = _grow({c: v[at] for c, v in columns.items()}, real, close, reach, band)[real]
        return table.select(["doc_id", "page", "ord"]).filter(pa.array(keep)).combine_chunks()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
            if held.num_rows:
                last = int(_bounds(held)[0][-1])  # the last page may go on in the next batch
                if last:
                    yield from grown(held.slice(0, last)).to_batches()
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from grown(held).to_batches()

    return run


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each page; null is a key like others."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("doc_id", "page"):
        column = table.column(c)
        value, none = column.fill_null(0).to_numpy(), column.is_null().to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (none[1:] != none[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, table.num_rows))


def clusters(lines: DataFrame, close: float = 28.0, reach: float = 24.0, band: float = 16.0) -> DataFrame:
    """doc_id, page, ord: the lines that belong to the formula of a page's target line.

    lines has doc_id, page, ord, text, x0, y0, x1, y1, left, right (the column), seed0, seed2 and target. Pieces of
    formulas within ``reach`` join, unless they are nearer to another numbered line; then whatever isn't prose on the
    target's own line. A page's lines are few whatever the size of the corpus; many pages are grown at once. No target: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    known = lines.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "left", "right", "seed0", "seed2")],
        F.coalesce("target", F.lit(False)).alias("target"), ly.line_number(text).alias("number"), ly.math_fragment(text).alias("fragment"), ly.prose(text).alias("prose"),
    )
    dealt = known.select("doc_id", "page", "ord", *_LINE).repartition("doc_id", "page")
    return dealt.sortWithinPartitions("doc_id", "page", "ord").mapInArrow(_pages(close, reach, band), _OUT)
