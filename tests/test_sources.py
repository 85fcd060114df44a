"""Sources: blank lines (A1), exact numbers of rows (A2), checks of front snapshots (A4), penalties of the sweep."""
import pytest

from qualm.sources import io as IO


def write(folder, **files):
    """A folder with the given file texts."""
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return f"file://{folder}"


def test_blank_lines_lose_no_file(spark, tmp_path):
    folder = write(tmp_path, a="\n\nid|text\n1|one\n\n2|two\n", b="id|text\n3|three\n", c="   \nid|text\n4|\"fo\nur\"\n   \n", d="\n\n",
                   e="﻿text|id\nfive|5\n", f="id|text\n6|x|y\n")
    rows, skipped = IO.read_delimited_dir(spark, folder, ["id", "text"])
    assert sorted(map(tuple, rows.collect())) == [("1", "one"), ("2", "two"), ("3", "three"), ("4", "fo\nur"), ("5", "five")]
    assert skipped.count() == 1
    with pytest.raises(ValueError, match="misses"):
        IO.read_delimited_dir(spark, folder, ["id", "answer"])


def test_sources_have_exact_numbers_of_rows(spark, tmp_path):
    folder = write(tmp_path, a="k|v\n" + "".join(f"{i % 40}|x\n" for i in range(60)))
    take = lambda n, seed=1: IO.load_random_sources(spark, {"s": folder}, {"s": n}, {"s": ["k", "v"]}, seed)["s"].collect()
    assert len(take(60)) == 60 and len(take(0)) == 0 and len(take(25)) == 25
    assert sorted(take(25)) == sorted(take(25)) != sorted(take(25, 2))
    with pytest.raises(ValueError, match="cannot take"):
        take(61)


@pytest.mark.parametrize("rows,message", [
    ([(0, 1.0, 2.0, 1.0), (1, 1.0, 3.0, 1.0)], None), ([(0, 1.0, 2.0, None)], None), ([(0, 1.0, None, 1.0)], "objectives"),
    ([(0, 1.0, 2.0, 1.0), (1, 1.0, 3.0, None)], "all or none")])
def test_front_snapshots_are_checked(spark, rows, message):
    path = IO.scratch_dir(spark, "fronts")
    df = spark.createDataFrame([(1, 2, *r) for r in rows], "seed int, gen int, idx long, f1 double, f2 double, x0 double")
    IO.write_fronts(df.selectExpr("*", *[f"x0 as x{i}" for i in range(1, 6)]), path)
    if message:
        with pytest.raises(ValueError, match=message):
            IO.read_fronts(spark, path)
    else:
        assert IO.read_fronts(spark, path).count() == len(rows)


def test_front_snapshots_of_wrong_shape(spark):
    for columns, message in (("seed int, gen int, idx long, f1 double", "two objectives"), ("seed int, gen int, f1 double, f2 double, x0 double", "miss"),):
        path = IO.scratch_dir(spark, "fronts")
        IO.write_fronts(spark.createDataFrame([tuple([1] * 2 + [1.0 if "double" in c else 1 for c in columns.split(", ")[2:]])], columns), path)
        with pytest.raises(ValueError, match=message):
            IO.read_fronts(spark, path)
    path = IO.scratch_dir(spark, "fronts")
    rows = [(1, 2, 1.0, 2.0, 1.0, None)]
    df = spark.createDataFrame(rows, "seed int, gen int, f1 double, f2 double, x0 double, x1 double")
    IO.write_fronts(df.selectExpr("*", *[f"x0 as x{i}" for i in range(2, 6)]), path)
    with pytest.raises(ValueError, match="not whole"):
        IO.read_fronts(spark, path)


def test_configurations_without_scores_get_the_penalty(spark):
    from qualm.operators.sweep import PENALTY
    from qualm.operators.sweep_hdbscan import hdbscan_knn_many, hdbscan_objectives
    pts = spark.createDataFrame([(1, i, [float(i % 2 * 9), float(i) / 50]) for i in range(40)], "space long, row_id long, v array<double>")
    ev = spark.createDataFrame([(1, 100 + i, [float(i % 3), 0.3]) for i in range(9)], "space long, row_id long, v array<double>")
    cfg = spark.createDataFrame([(1, 1, 5, 3, 0.0, 4), (2, 1, 5, 3, 0.0, 6), (3, 1, 60, 3, 0.0, 4)],
                                "cfg long, space long, min_cluster_size long, min_samples long, epsilon double, n_neighbors long")
    uq = hdbscan_knn_many(pts, ev, cfg, penalise=True)
    assert {r.cfg for r in uq.select("cfg").distinct().collect()} == {1, 2}  # no group of 60 rows
    assert {r.cfg for r in hdbscan_knn_many(pts, ev, cfg).select("cfg").distinct().collect()} == {1, 2, 3}
    scored = uq.selectExpr("cfg", "uq", "double(row_id % 4) as bertscore_f1", "double(row_id % 3) as rougeL")
    found = {r.cfg: (r.f1, r.f2) for r in hdbscan_objectives(scored, cfg.select("cfg")).collect()}
    assert found[3] == (PENALTY, PENALTY) and PENALTY not in found[1] and len(found) == 3
