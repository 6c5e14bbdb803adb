"""Nulls, odd indexes, broken outlines and clashing columns in every operator that reads sides."""

import datetime as dt

from interlock.llm.history import repeats
from interlock.llm.neighbours import nearest_sides
from interlock.llm.survivor import fused_views, most_central
from interlock.operators.pieces import usable_ids, usable_pieces
from tests.shapes import SIDES, outline, piece


def dirty(spark):
    t = dt.datetime(2026, 1, 2)
    rows = piece(1, [1, 2, 3, 4], 1) + piece(2, [1, 2, 3, 4], 2) + piece(3, [1, 2, 3, 4], None) + piece(4, [5, 6, 7, 8], 1)
    rows += [
        (1, 9, outline(1), [1, 1], False, None, None, None, None, 1, t), (1, None, outline(1), [1, 1], None, "", [None, 2.0], 5, 5, None, None), (None, 0, outline(1), [1, 1], False, "x", [1.0], 5, 5, 1, t),
        (5, 0, None, None, None, None, None, None, None, None, None), (6, 0, [[1, None], [2, 2]], [1, 1], False, "a", [1.0, 1.0], 1, 1, 1, t), (6, 1, [[1], [2, 2]], [1, 1], False, "a", [1.0, 1.0], 1, 1, 1, t), (7, 2, [None, [2, 2]], [1, 1], False, "a", [1.0, 1.0], 1, 1, 1, t),
    ]
    df = spark.createDataFrame(rows, SIDES)
    return df.selectExpr("*", "1 as outline", "2 as sid", "3 as key", "4 as x", "5 as near", "'q' as object", "6 as source", "7 as at")


def test_sides_with_dirt(spark):
    df = dirty(spark)
    assert {r[0] for r in usable_ids(df).collect()} == {1, 2, 3, 4}
    assert {r["x"]: r["y"] for r in repeats(usable_pieces(df), 1).collect()} == {2: 1}
    near = {(r["piece_id"], r["near_piece_id"]) for r in nearest_sides(df).collect()}
    assert near == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    groups = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (99, 5)], "piece_id long, group_id long")
    assert {tuple(r) for r in most_central(fused_views(df, groups)).collect()} == {(1, 1)}
