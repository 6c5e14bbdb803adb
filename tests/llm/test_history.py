import numpy as np

from interlock.functions.outline import pack, side_vectors
from interlock.llm import history
from interlock.llm.history import History, close_signatures, keyed, repeats
from interlock.operators.pieces import usable_pieces
from tests.shapes import SIDES, outline, piece

from pyspark.sql import functions as F


def brute(rows):
    import pyarrow as pa

    sides = {}
    for r in rows:
        sides.setdefault(r[0], {})[r[1]] = r
    v = {p: side_vectors(pack(pa.array([s[k][2] for k in range(4)], pa.list_(pa.list_(pa.int32()))))) for p, s in sides.items() if len(s) == 4}
    batch = {p: s[0][9] for p, s in sides.items()}
    accepted, cases = [], {}
    for p in sorted(v, key=lambda p: (batch[p], p)):
        hits = [q for q in accepted if batch[q] < batch[p] and any(all(round(float(np.linalg.norm(v[p][(k + s) % 4] - v[q][k])), 6) <= 0.06 for k in range(4)) for s in range(4))]
        if hits:
            cases[p] = min(hits, key=lambda q: (batch[q], q))
        else:
            accepted.append(p)
    return cases


def rows_with_repeats():
    rows = []
    for p in range(30):
        rows += piece(p, [10 * p + k for k in range(4)], batch=1 + p % 3, jitter=1)
    for p in range(12):
        rows += piece(100 + p, [10 * p + k for k in range(4)], batch=4 + p % 2, turn=p % 4, jitter=1)
    for p in range(20):  # one piece over and over, in one batch and in later ones
        rows += piece(200 + p, [3, 4, 5, 6], batch=2 + p // 8, turn=p % 4)
    return rows


def test_equals_brute_force_in_one_and_several_deliveries(spark):
    rows = rows_with_repeats()
    pieces = usable_pieces(spark.createDataFrame(rows + rows[:9], SIDES)).cache()
    want = brute(rows)
    assert len(want) >= 15
    for n in (1, 3):
        got = {r["x"]: r["y"] for r in repeats(pieces, deliveries=n).collect()}
        assert got.keys() == want.keys()
        assert sum(got[k] != want[k] for k in want) == 0


def test_history_keeps_only_accepted_and_survives_empty_deliveries(spark):
    pieces = usable_pieces(spark.createDataFrame(piece(1, [1, 2, 3, 4], 1) + piece(2, [1, 2, 3, 4], 2) + piece(3, [5, 6, 7, 8], 2), SIDES))
    h = History(spark)
    assert h.ingest(pieces.where("batch_id = 1")).count() == 0
    assert h.ingest(pieces.limit(0)).count() == 0
    assert [tuple(r) for r in h.ingest(pieces.where("batch_id = 2")).collect()] == [(2, 1)]
    assert {r[0] for r in h.accepted().select("piece_id").collect()} == {1, 3}


def test_a_named_delivery_counts_once_and_a_broken_one_leaves_nothing(spark, monkeypatch):
    pieces = usable_pieces(spark.createDataFrame(piece(1, [1, 2, 3, 4], 1) + piece(2, [1, 2, 3, 4], 2) + piece(3, [5, 6, 7, 8], 2), SIDES)).cache()
    h = History(spark)
    h.ingest(pieces.where("batch_id = 1"), "one")
    with monkeypatch.context() as m:
        m.setattr(h, "_commit", lambda *_: 1 / 0)
        try:
            h.ingest(pieces.where("batch_id = 2"), "two")
        except ZeroDivisionError:
            pass
    assert {r[0] for r in h.accepted().select("piece_id").collect()} == {1}
    for _ in range(2):
        assert [tuple(r) for r in h.ingest(pieces.where("batch_id = 2"), "two").collect()] == [(2, 1)]
        assert sorted(r[0] for r in h.accepted().select("piece_id").collect()) == [1, 3]


def test_deliveries_read_their_own_partitions_only(spark, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_PART", 16)
    monkeypatch.setattr(history, "FANOUT", 3)
    rows = [r for b in range(3) for p in range(50) for r in piece(1000 * b + p, [7 * (50 * b + p) + k for k in range(4)], batch=b)]
    rows += piece(9000, [9000, 9001, 9002, 9003], batch=3) + piece(9999, [7 * 5 + k for k in range(4)], batch=4, turn=2, jitter=1)  # repeats piece 5 of the first
    pieces = usable_pieces(spark.createDataFrame(rows, SIDES)).cache()
    h, read, there, cases = History(spark), [], [], []
    for b in range(5):
        there.append(sum(r["bands"] for r in h._state()[1]["runs"]))
        cases += [tuple(r) for r in h.ingest(pieces.where(F.col("batch_id") == b), f"d{b}").collect()]
        read.append(h.partitions_read)
    assert cases == [(9999, 5)] and [r["level"] for r in h._state()[1]["runs"]] == [1, 0] and h.accepted().count() == 151
    # one piece has BANDS keys: that many partitions of a run at most, and those of the candidates, of the hundreds there are
    assert there[3] >= 128 and read[3] <= 16 + 2 and read[4] <= 2 * 16 + 4


def test_closed_outline_is_never_the_same(spark):
    loop = [[0, 0], [5, 5], [0, 0]]
    rows = [(p, k, loop if k == 0 else outline(k), [1, 1], False, "a", [1.0, 1.0], 1, 1, p, None) for p in (1, 2) for k in range(4)]
    assert repeats(usable_pieces(spark.createDataFrame(rows, SIDES)), 1).count() == 0


def test_signatures_of_near_pieces_are_close(spark):
    rows = piece(1, [1, 2, 3, 4], jitter=2) + piece(2, [1, 2, 3, 4], turn=2, jitter=2) + piece(3, [11, 12, 13, 14])
    k = keyed(usable_pieces(spark.createDataFrame(rows, SIDES))).select("piece_id", "sig")
    p = k.alias("a").join(k.alias("b"), F.col("a.piece_id") < F.col("b.piece_id")).select("a.piece_id", "b.piece_id", close_signatures(F.col("a.sig"), F.col("b.sig"), 0.06)).collect()
    assert {(a, b): c for a, b, c in p} == {(1, 2): True, (1, 3): False, (2, 3): False}
