"""Operators on frames of cells, keyed by (frame, y, x)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.rank import top_k


def grid_components(cells: DataFrame, frame: str, y: str, x: str, colour: str) -> DataFrame:
    """cells with label, the least (y, x) of its 4-connected component of one colour in its frame, as a struct.

    A frame is a board of bounded size, so one frame is one group of a grouped map; frames spread over all tasks.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(a, b): i for i, (a, b) in enumerate(zip(pdf[y], pdf[x], strict=True))}
        tint, parent = pdf[colour].to_list(), list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for (a, b), i in sorted(at.items()):
            for near in ((a - 1, b), (a, b - 1)):
                j = at.get(near)
                if j is not None and tint[i] == tint[j]:
                    parent[root(i)] = root(j)
        least: dict[int, tuple[int, int]] = {}
        for place, i in sorted(at.items()):
            least.setdefault(root(i), place)
        found = [least[root(i)] for i in range(len(pdf))]
        return pd.DataFrame({frame: pdf[frame], y: pdf[y], x: pdf[x], colour: pdf[colour], "label_y": [p[0] for p in found], "label_x": [p[1] for p in found]})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    columns = ", ".join(f"{c} {kinds[c]}" for c in (frame, y, x, colour))
    labelled = cells.select(frame, y, x, colour).groupBy(frame).applyInPandas(label, f"{columns}, label_y long, label_x long")
    return labelled.select(frame, y, x, colour, F.struct(F.col("label_y").alias("y"), F.col("label_x").alias("x")).alias("label"))


def grid_objects(labelled: DataFrame, frame: str, y: str, x: str, colour: str, label: str = "label", scenery: float = 1 / 8) -> DataFrame:
    """frame, place (from 1, largest first), colour, area, y, x: the components of a frame, at the middle of their extent, rounded down.

    Colours that cover more than `scenery` of a frame's cells are no objects. Equal areas go by greater x, then greater y, then
    the lesser label.
    """
    tinted = labelled.withColumn("_of", F.count("*").over(Window.partitionBy(frame, colour))).withColumn("_all", F.count("*").over(Window.partitionBy(frame)))
    middle = lambda c: F.floor((F.min(c) + F.max(c)) / 2)
    found = tinted.where(F.col("_of") <= F.floor(F.col("_all") * scenery)).groupBy(frame, label, colour).agg(F.count("*").alias("area"), middle(y).alias("y"), middle(x).alias("x"))
    order = Window.partitionBy(frame).orderBy(F.col("area").desc(), F.col("x").desc(), F.col("y").desc(), label)
    return found.select(frame, F.row_number().over(order).cast("long").alias("place"), colour, "area", "y", "x")


def frame_diff(before: DataFrame, after: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """Objects of two frames as events: vanished, appeared, moved (key, event, dy, dx); those that stay give none."""
    a, b = before.select(key, F.col(y).alias("_ya"), F.col(x).alias("_xa")), after.select(key, F.col(y).alias("_yb"), F.col(x).alias("_xb"))
    both = a.join(b, key, "full")
    dy, dx = F.col("_yb") - F.col("_ya"), F.col("_xb") - F.col("_xa")
    event = F.when(F.col("_yb").isNull(), "vanished").when(F.col("_ya").isNull(), "appeared").when((dy != 0) | (dx != 0), "moved")
    return both.select(key, event.alias("event"), dy.alias("dy"), dx.alias("dx")).where("event is not null")


def clock_cells(rows: DataFrame, cell: list[str], run: str, time: str, value: str) -> DataFrame:
    """Cells that agree across runs at every time and yet vary in time."""
    at = rows.groupBy(*cell, time).agg((F.min(value) == F.max(value)).alias("_same"), F.min(value).alias("_v"))
    return at.groupBy(*cell).agg(F.bool_and("_same").alias("_all"), (F.min("_v") != F.max("_v")).alias("_varies")).where("_all and _varies").select(*cell)


def shortest_per_state(df: DataFrame, state: list[str], length: str, payload: str) -> DataFrame:
    """One payload per state, of the least length; ties by the payload."""
    return df.groupBy(*state).agg(F.min(F.struct(length, payload)).alias("_m")).select(*state, f"_m.{length}", f"_m.{payload}")


def shape_pairs(pieces: DataFrame, regions: DataFrame, shape: str, piece: str, region: str, area: str, place: str, most: int = 12) -> DataFrame:
    """Each piece of area 2 or more with the first region of its shape at another place, at most `most` pairs, by piece."""
    # the least region of each place, then a shape's two least: if the first is at the piece's own place, the second is not
    least = regions.where(F.col(place).isNotNull()).groupBy(shape, place).agg(F.min(region).alias("_region"))
    two = top_k(least, [shape], [F.col("_region"), F.col(place)], 2, "_n").groupBy(shape)
    two = two.agg(F.min(F.struct("_n", "_region", F.col(place).alias("_place"))).alias("_first"), F.max(F.struct("_n", "_region")).alias("_second"))
    other = F.when(F.col(place) != F.col("_first._place"), F.col("_first._region")).when((F.col(place) == F.col("_first._place")) & (F.col("_second._n") == 2), F.col("_second._region"))
    found = pieces.where(F.col(area) >= 2).join(two, shape).withColumn("_found", other).where("_found is not null")
    return found.groupBy(piece).agg(F.min("_found").alias(region)).orderBy(piece).limit(most)


def prefix_difference(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "step") -> DataFrame:
    """What each row adds to the running value of its group; the first adds its own."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
