import random
import time

from pyspark.sql import functions as F

from interlock.operators.board import corners_and_edges, fill, fits_cell, generated_puzzle, solve, solve_boards, solve_from, solve_partial, spiral
from interlock.plans.search_queries import board_solve


def graph(fits, ids):
    g = {p: ([], [], [], []) for p in ids}
    for p, s, o, t, e in fits:
        g[p][s].append((o, t, e))
    for f in g.values():
        for s in f:
            s.sort(key=lambda x: (x[2], x[0], x[1]))
    return g


def adjacency(placed):
    """Pairs of neighbouring pieces, the same for all four turns of a board."""
    return {frozenset((p, placed[x + dx, y + dy][0])) for (x, y), (p, _) in placed.items() for dx, dy in ((1, 0), (0, 1)) if (x + dx, y + dy) in placed}


def test_spiral_covers_all_cells_by_steps():
    for w, h in ((1, 1), (4, 3), (3, 5), (1, 4)):
        s = spiral(w, h)
        assert len(set(s)) == w * h == len(s)
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(s, s[1:]))


def test_recovers_a_generated_puzzle():
    for seed, (w, h) in enumerate(((3, 3), (6, 4), (10, 10))):
        fits, answer = generated_puzzle(w, h, seed)
        g = graph(fits, [a[0] for a in answer])
        corners, edges = corners_and_edges(g)
        assert len(corners) == 4 and len(edges) == 2 * (w + h) - 4
        want = adjacency({(x, y): (p, t) for p, x, y, t in answer})
        boards = [solve_from(g, c, a, b) for c in corners for a, b in {(w, h), (h, w)}]
        assert any(b and adjacency(b) == want for b in boards)


def test_inner_piece_does_not_go_to_a_corner():
    fits, answer = generated_puzzle(3, 3, 5)
    g = graph(fits, [a[0] for a in answer])
    middle = next(p for p, x, y, _ in answer if (x, y) == (1, 1))
    assert not any(fits_cell(g, {}, middle, 0, 0, t, 3, 3) for t in range(4))
    assert not fits_cell(g, {(1, 1): (1, 0)}, middle, 1, 1, 0, 3, 3) and not fits_cell(g, {}, middle, 5, 1, 0, 3, 3)


def test_partial_and_fill_with_missing_pieces():
    fits, answer = generated_puzzle(6, 5, 7, noise=0)
    gone = {p for p, x, y, _ in answer if (x, y) == (3, 2)}
    g = graph([f for f in fits if f[0] not in gone], [a[0] for a in answer if a[0] not in gone])
    placed = solve_partial(g, 6, 5)
    assert 0 < len(placed) <= 29
    assert len({p for p, _ in placed.values()}) == len(placed)
    answer_map = {(x, y): (p, t) for p, x, y, t in answer}
    start = {c: v for c, v in answer_map.items() if c[1] == 0}
    full = fill(graph(fits, [a[0] for a in answer]), start, 6, 5)
    assert full == answer_map


def test_boards_in_spark(spark):
    rows, pieces, want = [], [], {}
    for board in (1, 2):
        fits, answer = generated_puzzle(5, 4, board)
        random.Random(board).shuffle(fits)
        rows += [(board, *f) for f in fits]
        pieces += [(board, a[0]) for a in answer]
        want[board] = adjacency({(x, y): (p, t) for p, x, y, t in answer})
    f = spark.createDataFrame(rows, "board_id long, piece_id long, side int, other_piece long, other_side int, err double")
    p = spark.createDataFrame(pieces, "board_id long, piece_id long")
    s = spark.createDataFrame([(1, 5, 4), (2, 5, 4)], "board_id long, width int, height int")
    got = solve_boards(p, f, s).collect()
    assert {r["complete"] for r in got} == {True}
    for board in (1, 2):
        assert adjacency({(r["x"], r["y"]): (r["piece_id"], r["orientation"]) for r in got if r["board_id"] == board}) == want[board]


def test_board_is_as_large_as_its_customers_ask_for(spark, tmp_path):
    spark.range(150 + 20).select((F.col("id") >= 150).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = board_solve(spark, str(tmp_path)).groupBy("board_id").agg(F.count("*"), F.max("x") + 1, F.max("y") + 1, F.min("complete")).collect()
    assert {tuple(r) for r in got} == {(0, 156, 13, 12, True), (1, 25, 5, 5, True)}


def test_search_time_grows_with_the_board():
    """10,000 pieces: laying the whole board again for each state took some 40 s."""
    fits, answer = generated_puzzle(100, 100, 1)
    g = {p: ([], [], [], []) for p, *_ in answer}
    for p, s, o, t, e in sorted(fits, key=lambda f: f[4]):
        g[p][s].append((o, t, e))
    began = time.process_time()
    placed = solve_from(g, corners_and_edges(g)[0][0], 100, 100)
    assert len(placed) == 10_000 and time.process_time() - began < 15


def test_a_long_border_is_no_reason_to_give_up(spark):
    """1,200 border cells; a limit of 1,000 steps made larger boards partial ones, and let a search that runs long end without its board."""
    fits, answer = generated_puzzle(2, 600, 1)
    want = adjacency({(x, y): (p, t) for p, x, y, t in answer})
    g = graph(fits, [a[0] for a in answer])
    corner = next(p for p, x, y, _ in answer if (x, y) == (0, 0))
    assert adjacency(solve_from(g, corner, 2, 600)) == want
    f = spark.createDataFrame([(1, *r) for r in fits], "board_id long, piece_id long, side int, other_piece long, other_side int, err double")
    s = spark.createDataFrame([(1, 2, 600)], "board_id long, width int, height int")
    got = solve_boards(f.select("board_id", "piece_id").distinct(), f, s).collect()
    assert len(got) == 1200 and {r["complete"] for r in got} == {True}
    assert adjacency({(r["x"], r["y"]): (r["piece_id"], r["orientation"]) for r in got}) == want


def test_a_search_without_end_keeps_no_corner_from_its_turn():
    """On a board that is wider than high half the corners lead nowhere; with any two border pieces fitting each other, their search would take years."""
    fits, answer = generated_puzzle(16, 14, 2)
    inner = [(p, (s - t) % 4, x, y) for p, x, y, t in answer for s, on in enumerate((y == 0, x == 15, y == 13, x == 0)) if not on]
    border = [i for i in inner if i[2] in (0, 15) or i[3] in (0, 13)]
    g = graph(fits + [(p, s, o, os, 2.0 + abs(p - o) / 1e6) for p, s, *_ in border for o, os, *_ in border if p != o], [a[0] for a in answer])
    at = {(x, y): p for p, x, y, _ in answer}
    wrong, right = [], []
    for p in (at[0, 0], at[15, 0], at[15, 13], at[0, 13]):
        (right if p in (at[0, 0], at[15, 13]) else wrong).append(p)
    placed = solve(g, wrong + right, 16, 14)
    assert adjacency(placed) == adjacency({(x, y): (p, t) for p, x, y, t in answer})


def test_a_board_that_has_no_answer_ends():
    """Without the fits of two neighbours all states run out; too few pieces with a flat side end it at once."""
    fits, answer = generated_puzzle(13, 12, 3, noise=12)
    ids, at = [a[0] for a in answer], {(x, y): p for p, x, y, _ in answer}
    apart = graph([f for f in fits if {f[0], f[2]} != {at[1, 0], at[2, 0]}], ids)
    assert all(solve_from(apart, c, 13, 12) is None for c in corners_and_edges(apart)[0])
    whole = graph(fits, ids)
    edge = at[4, 0]
    whole[edge] = tuple(f or [(at[5, 5], 0, 1.0)] for f in whole[edge])
    assert solve_from(whole, at[0, 0], 13, 12) is None
