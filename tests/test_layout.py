"""Side columns against all cuts, rows against what a reader sees."""

import random

from adsentry.operators import layout as L

SCHEMA = "image long, text string, top double, left double, right double, height double, width double"


def side_start(lines):
    """Every edge is tried, the rightmost first."""
    width = lines[0][6]
    slack = L.TOLERANCE * width
    for start in sorted({x[3] for x in lines if 0.45 * width <= x[3] <= 0.85 * width}, reverse=True):
        main = [x for x in lines if x[3] < start - slack]
        crossing = sum(x[4] > start + slack for x in main)
        if len(main) >= 5 and len(lines) - len(main) >= 5 and crossing <= 2:
            return start - slack
    return None


def test_side_columns_as_by_all_cuts(spark):
    rng, images = random.Random(9), {}
    for image in range(120):
        edges = [0, 100, 452, 480, 600, 601, 850, rng.randrange(1000)]
        images[image] = []
        for i in range(rng.choice([1, 9, 10, 14, 25])):
            left = float(rng.choice(edges))
            images[image].append((image, f"t{i}", float(rng.randrange(500)), left, left + rng.choice([0, 5, 20, 100, 330, 400]), 20.0, 1000.0))
    want = {i: side_start(x) for i, x in images.items()}
    got = {r.image: r.start for r in L.side_columns(spark.createDataFrame([x for v in images.values() for x in v], SCHEMA)).collect()}
    assert got == {i: s for i, s in want.items() if s is not None}
    assert 10 < len(got) < 110


def test_rows_of_two_columns(spark):
    main = [("Sehr schönes Fahrrad, kaum gefahren und immer", 100, 10, 400), ("im Keller gestanden.", 122, 11, 200), ("Neue Zeile", 200, 10, 200), ("Preis", 240, 10, 80), ("120 €", 244, 200, 260), ("Ende", 300, 10, 60)]
    side = [(f"Seite {i}", 100 + 40 * i, 700, 800) for i in range(5)]
    lines = [(1, t, float(top), float(a), float(b), 20.0, 1000.0) for t, top, a, b in main + side]
    lines += [(2, t, float(top), float(a), float(b), 20.0, 1000.0) for t, top, a, b in main]
    random.Random(1).shuffle(lines)
    got = {}
    for r in sorted(L.layout_rows(spark.createDataFrame(lines, SCHEMA)).collect()):
        got.setdefault((r.image, r.side), []).append(r.text)
    rows = ["Sehr schönes Fahrrad, kaum gefahren und immer im Keller gestanden.", "Neue Zeile", "Preis 120 €", "Ende"]
    assert got == {(1, False): rows, (1, True): [f"Seite {i}" for i in range(5)], (2, False): rows}
    assert L.layout_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_unknown_places(spark):
    """Lines without a place come last, each in a row of its own."""
    lines = [(1, "b", None, 5.0, 9.0, 20.0, 1000.0), (1, "a", 3.0, None, 9.0, 20.0, 1000.0), (1, "c", None, 1.0, 9.0, 20.0, 1000.0), (None, "d", 1.0, 1.0, 9.0, None, 1000.0)]
    got = [(r.image, r.side, r.row, r.text) for r in L.layout_rows(spark.createDataFrame(lines, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted([(1, False, 0, "a"), (1, False, 1, "c"), (1, False, 2, "b"), (None, False, 0, "d")], key=repr)


def test_many_images_in_a_batch(spark):
    """Rows are made in batches of columns, not in a call for each."""
    plan = L.layout_rows(spark.createDataFrame([(1, "a", 1.0, 1.0, 2.0, 3.0, 4.0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan
