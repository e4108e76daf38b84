"""PAG-09: boxes of recognised lines to the rows of a page's main and side column.

Lines: image, text, top, left, right, height, and width, the page's. All work is done image by image; an image has as many lines
as fit on a page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Where a side column may start, and what makes it one.
SIDE_FROM, SIDE_TO = 0.45, 0.85
SIDE_LINES, SIDE_CROSSINGS = 5, 2
TOLERANCE = 0.01
WRAPPED_CHARS, WRAPPED_LEFT, WRAPPED_GAP = 40, 0.02, 0.8
ROW_SHARE = 0.5


def side_columns(lines: DataFrame) -> DataFrame:
    """(image, start): where the side column of an image starts, if it has one: the rightmost left edge beside which `SIDE_LINES` lines
    stand on either side, and which `SIDE_CROSSINGS` lines of the left side cross at most.

    A sweep from left to right: a line counts as left of an edge from its own left edge on, and as crossing until its right edge. Edges
    are asked at their place in this order, so that running sums answer all of them at once."""
    slack = F.col("width") * TOLERANCE
    lines = lines.withColumn("slack", slack)
    starts = lines.select("image", (F.col("left") + F.col("slack")).alias("x"), F.lit(2).alias("turn"), F.lit(1).alias("main"), (F.col("right") - F.col("slack") > F.col("left") + F.col("slack")).cast("int").alias("open"), F.lit(None).cast("double").alias("edge"))
    stops = lines.where("right - slack > left + slack").select("image", (F.col("right") - F.col("slack")).alias("x"), F.lit(0).alias("turn"), F.lit(0).alias("main"), F.lit(-1).alias("open"), F.lit(None).cast("double").alias("edge"))
    asked = lines.where(F.col("left").between(SIDE_FROM * F.col("width"), SIDE_TO * F.col("width"))).select("image", F.col("left").cast("double").alias("x"), "slack").distinct()
    asked = asked.select("image", "x", F.lit(1).alias("turn"), F.lit(0).alias("main"), F.lit(0).alias("open"), (F.col("x") - F.col("slack")).alias("edge"))
    order = Window.partitionBy("image").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image")
    swept = starts.unionByName(stops).unionByName(asked).withColumn("n", F.sum("main").over(order)).withColumn("crossing", F.sum("open").over(order)).withColumn("all", F.sum("main").over(every))
    fits = (F.col("n") >= SIDE_LINES) & (F.col("all") - F.col("n") >= SIDE_LINES) & (F.col("crossing") <= SIDE_CROSSINGS)
    return swept.where(F.col("edge").isNotNull() & fits).groupBy("image").agg(F.max("edge").alias("start"))


Line = tuple[float, float, str, float, float]  # top, left, text, height, width


def column_rows(lines: list[Line]) -> list[str]:
    """The rows of one column, from top to bottom: parts of nearly the same height stand side by side, and a line that goes on a paragraph
    is put behind it."""
    known = lambda x: (x != x, 0.0 if x != x else x)  # noqa: E731  unknown places come last
    rows: list[list[Line]] = []
    for line in sorted(lines, key=lambda x: (*known(x[0]), *known(x[1]), x[2])):
        if rows and abs(rows[-1][0][0] - line[0]) < ROW_SHARE * min(rows[-1][0][3], line[3]):
            rows[-1].append(line)
        else:
            rows.append([line])
    out: list[str] = []
    above = None
    for row in rows:
        row.sort(key=lambda part: known(part[1]))
        first, text = row[0], " ".join(part[2] for part in row)
        goes_on = above is not None and len(row) == 1 and len(out[-1]) >= WRAPPED_CHARS
        if goes_on and abs(first[1] - above[1]) < WRAPPED_LEFT * first[4] and first[0] - above[0] - above[3] < WRAPPED_GAP * above[3]:
            out[-1] += " " + text
        else:
            out.append(text)
        above = first
    return out


PARTS = ["top", "left", "text", "height", "width"]


def _all_rows(*columns: pa.Array) -> pa.Array:
    """The lines of some columns, a list for each part of a line, to the rows of each."""
    return pa.array([column_rows(list(zip(*parts, strict=True))) for parts in zip(*(c.to_pylist() for c in columns), strict=True)], pa.list_(pa.string()))


def layout_rows(lines: DataFrame) -> DataFrame:
    """(image, side, row, text): the rows of the main column and of the side column."""
    placed = lines.join(side_columns(lines), "image", "left").withColumn("side", F.coalesce(F.col("left") >= F.col("start"), F.lit(False)))
    parts = [F.col(c) if c == "text" else F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in PARTS]
    columns = placed.groupBy("image", "side").agg(F.collect_list(F.struct(*parts)).alias("lines"))
    rows = F.arrow_udf(_all_rows, "array<string>")(*[F.col(f"lines.{c}") for c in PARTS])
    return columns.select("image", "side", F.posexplode(rows).alias("row", "text"))
