"""Simplified borders that neighbours share: arcs between junctions, each simplified once for all polygons beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shapes


def _kept(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The places of a line that stay: its ends, and again and again the farthest from a straight piece, while that is more than tolerance away."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, e = stack.pop()
        if e - a < 2:
            continue
        d, q = p[e] - p[a], p[a + 1 : e] - p[a]
        length2 = (d * d).sum()
        t = np.clip(q @ d / length2, 0, 1) if length2 > 0 else np.zeros(len(q))
        far = np.hypot(*(q - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, e)]
    return keep


def _arcs(edges: list[tuple], junctions: set[tuple]) -> list[list[tuple]]:
    """Lines of undirected edges (x1, y1, x2, y2) between junctions; those without one start at their least corner."""
    at: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2 in edges:
        at.setdefault((x1, y1), []).append((x2, y2))
        at.setdefault((x2, y2), []).append((x1, y1))
    arcs = []
    # Corners that lines end at come first, so what is left of the others are closed lines.
    for start in [*sorted(c for c in at if c in junctions or len(at[c]) != 2), *sorted(at)]:
        while at.get(start):
            line = [start]
            while at.get(line[-1]):
                here, to = line[-1], at[line[-1]].pop()
                at[to].remove(here)
                line.append(to)
                if to == start or to in junctions or len(at[to]) != 1:
                    break
            arcs.append(line)
    return arcs


def simplified(edges: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, rings) of polygons (edges, each ring turning left around its inside), no place moved by more than about tolerance.

    Polygons that share whole edges stay neighbours without gap or overlap: a
    corner where three of them meet, or two and the outside, is kept, and what
    runs between two such corners is one line for all. A task holds the border
    of two polygons. A closed line without such a corner keeps its least corner
    and the one farthest from it; rings that have no area left are gone.
    """
    c = ["x1", "y1", "x2", "y2"]
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    turned = F.when(forward, F.struct(*c)).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    sides = edges.where(F.col(key).isNotNull()).where("x1 != x2 OR y1 != y2").select(F.struct(F.col(key).alias("k"), forward.alias("f")).alias("side"), turned.alias("e")).distinct()
    # Who is on either side of each edge.
    shared = sides.groupBy("e").agg(F.sort_array(F.collect_list("side")).alias("beside")).select(F.array_distinct(F.transform("beside", lambda s: s["k"])).alias("pair"), "e.*", "beside")
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    # A junction is a corner at which other polygons meet than along its edges.
    corners = shared.select("pair", ends.alias("p")).groupBy("p").agg(F.size(F.collect_set("pair")).alias("pairs"), F.count("*").alias("n"))
    junctions = corners.where("pairs > 1 OR n != 2").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(True).alias("j"))
    for n in "12":
        marks = junctions.select(F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("j").alias(f"j{n}"))
        shared = shared.join(marks, [f"x{n}", f"y{n}"], "left")
    sided = shared.select(F.to_json("pair").alias("pair"), *c, "j1", "j2", F.to_json("beside").alias("beside"))

    def lines(group: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in group[c].to_numpy(float).tolist()]
        fixed = {r[:2] for r, j in zip(rows, group["j1"], strict=True) if j is True} | {r[2:] for r, j in zip(rows, group["j2"], strict=True) if j is True}
        beside = dict(zip(rows, group["beside"], strict=True))
        out = []
        for line in _arcs(rows, fixed):
            p = np.array(line)
            a, b = line[0], line[1]
            sides = beside[(*a, *b) if a < b else (*b, *a)]
            parts = [p]
            if a == line[-1]:
                k = int(np.hypot(*(p - p[0]).T).argmax())
                parts = [p[: k + 1], p[k:]]
            for part in parts:
                q = part[_kept(part, tolerance)]
                out += [(*s, *t, a < b, sides) for s, t in zip(q[:-1].tolist(), q[1:].tolist(), strict=True)]
        return pd.DataFrame(out, columns=[*c, "forward", "beside"])

    kind = edges.schema[key].dataType.simpleString()
    made = sided.groupBy("pair").applyInPandas(lines, "x1 double, y1 double, x2 double, y2 double, forward boolean, beside string")
    of = made.select(*c, "forward", F.explode(F.from_json("beside", f"array<struct<k: {kind}, f: boolean>>")).alias("s"))
    same = F.col("forward") == F.col("s.f")
    told = of.select(F.col("s.k").alias(key), *(F.when(same, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(c, ["x2", "y2", "x1", "y1"], strict=True)))
    return shapes.rings(told, [key])
