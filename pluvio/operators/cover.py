"""Points in polygons by a cover of quadtree cells: most points meet no edge at all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.operators.pins import first_by

#: Halvings of a cell of one degree that edges touch.
DEEPEST = 5
EDGE = "struct<ring:int,x1:double,y1:double,x2:double,y2:double>"
CELL = f"code string, part int, area double, level int, cx int, cy int, inside boolean, base array<int>, edges array<{EDGE}>"
_EPS = 1e-9


def _touching(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which segments touch a closed box, by their own boxes and the side of the line that its corners lie on."""
    x0, y0, x3, y3 = box[0] - _EPS, box[1] - _EPS, box[2] + _EPS, box[3] + _EPS
    near = (np.minimum(x1, x2) <= x3) & (np.maximum(x1, x2) >= x0) & (np.minimum(y1, y2) <= y3) & (np.maximum(y1, y2) >= y0)
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (x0, x3) for y in (y0, y3)]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def _odd(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, x: float, y: float) -> np.ndarray:
    """Which edges a ray from (x, y) to the east crosses."""
    over = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def _cover(deepest: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        first = edges.iloc[0]
        x1, y1, x2, y2 = (edges[c].to_numpy(dtype=float) for c in ("x1", "y1", "x2", "y2"))
        names, ring = np.unique(edges["ring"].to_numpy(), return_inverse=True)
        outer = names == 0
        low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        area = float((first["max_x"] - first["min_x"]) * (first["max_y"] - first["min_y"]))
        out: list[tuple] = []
        todo = [(0, cx, cy) for cx in range(int(np.floor(first["min_x"])), int(np.floor(first["max_x"])) + 1) for cy in range(int(np.floor(first["min_y"])), int(np.floor(first["max_y"])) + 1)]
        while todo:
            level, cx, cy = todo.pop()
            size = 0.5**level
            box = (cx * size, cy * size, (cx + 1) * size, (cy + 1) * size)
            own = _touching(x1, y1, x2, y2, box)
            if not own.any():
                crossed = np.bincount(ring[_odd(x1, y1, x2, y2, box[0] + size / 2, box[1] + size / 2)], minlength=len(names)) % 2
                if (crossed == outer).all():
                    out.append((first["code"], first["part"], area, level, cx, cy, True, None, None))
            elif level < deepest:
                todo += [(level + 1, 2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)]
            else:
                # What a ray from within may cross: edges of the cell's band that do not lie to the west. Those that pass the whole band to the east are crossed by all.
                band = (high_y >= box[1]) & (low_y <= box[3]) & (high_x >= box[0])
                always = band & ~own & (low_y <= box[1]) & (high_y >= box[3]) & (low_x > box[2])
                base = np.bincount(ring[always], minlength=len(names)) % 2
                kept = np.flatnonzero(band & ~always)
                carried = [{"ring": int(ring[k]), "x1": x1[k], "y1": y1[k], "x2": x2[k], "y2": y2[k]} for k in kept]
                # For each ring, numbered anew in their order, the parity that a point needs of its own edges.
                out.append((first["code"], first["part"], area, level, cx, cy, False, [int((b + o) % 2) for b, o in zip(base, outer, strict=True)], carried))
        return pd.DataFrame(out, columns=[c.split(" ", 1)[0] for c in CELL.split(", ")])

    return run


def cover(edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Cells of one degree and its halves that cover each polygon: ``code, part, area, level, cx, cy, inside, base, edges``.

    ``edges`` has ``code, ring, x1, y1, x2, y2``, the polygon's box, and may have ``part``, a number
    for each polygon of a county; ring 0 is the outer one. A cell that no edge touches lies wholly
    inside and has none, or wholly outside and is left out. One that was halved ``deepest`` times and
    that edges still touch has the edges that a ray to the east may cross from some of its points
    but not from others; the parity of those that every ray crosses is in ``base``. One polygon is
    one group, as large as its outline has points.
    """
    part = F.col("part") if "part" in edges.columns else F.lit(0)
    rows = edges.select(F.col("code").cast("string").alias("code"), part.cast("int").alias("part"), F.col("ring").cast("int").alias("ring"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "min_x", "min_y", "max_x", "max_y")])
    return rows.groupBy("code", "part").applyInPandas(_cover(deepest), CELL)


def in_cells(points: DataFrame, cells: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Each point (``pin_id, lat, lon``) with each cell that holds it, by equal keys, one for each size of cell."""
    at = points.select("pin_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    scale = F.pow(F.lit(2.0), F.col("level"))
    keyed = at.select("pin_id", "lat", "lon", "level", F.floor(F.col("lon") * scale).cast("int").alias("cx"), F.floor(F.col("lat") * scale).cast("int").alias("cy"))
    return keyed.join(cells, ["level", "cx", "cy"])


def _held() -> Column:
    """Whether the point's own edges have, in every ring, the parity that is needed."""
    over = lambda e: (e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))
    right = lambda e: F.col("lon") < F.try_divide((e["x2"] - e["x1"]) * (F.col("lat") - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
    crossed = F.filter("edges", lambda e: over(e) & right(e))
    return F.forall(F.transform("base", lambda need, i: (F.size(F.filter(crossed, lambda e: e["ring"] == i)) % 2) == need), lambda ok: ok)


def counties_of(points: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``pin_id, code``: the county of each point that lies in one; of several that of the smallest box, then code."""
    found = in_cells(points, cover(edges, deepest), deepest).where(F.col("inside") | _held())
    return first_by(found, ["pin_id"], F.col("area"), F.col("code")).select("pin_id", "code")
