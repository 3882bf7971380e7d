"""What only shows on large tables, held by plans and small cases."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["aabb_overlap", "plan_comparison", "segment_crossings", "edge_overlap", "gap_reviews"])
def test_no_table_is_broadcast(spark, small, name):
    """Rows that explode or Python makes are more than Spark's estimate says, so their joins shuffle."""
    plan = __spark_entry__.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rings_of_one_split_are_dealt_over_tasks(spark, small):
    """Python work on few small files would run in as few tasks."""
    plan = __spark_entry__.queries()["raster_overlap"](spark, small)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInPandas") :]
    assert "Exchange hashpartitioning(name" in scan and "Broadcast" not in plan


def test_files_of_one_record_are_written_by_all_tasks(spark):
    from plumbline.plans.source_queries import each_in_a_file

    rows = spark.range(40).selectExpr("cast(id as string) AS name", "concat('a\n', id) AS value").coalesce(1)
    path = each_in_a_file(rows)
    found = spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_name AS file").collect()
    assert sorted(r.value for r in found) == sorted(f"a\n{k}\n" for k in range(40)) and len({r.file for r in found}) == 40
    assert len({r.file.split("-")[1] for r in found}) > 1


def test_many_small_groups_stream(spark, monkeypatch):
    """A data frame a group costs more than its work; groups that span batches stay whole."""
    from plumbline.operators import walls
    from plumbline.plans import capture_queries as queries

    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)
    spans = queries.room_walls(spark, "/root/testdata/sf0.001").where("capture_id IN ('c2', 'c3', 'c6', 'c7')")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cycles = [(r.capture_id, r.hypothesis, len(r.walls)) for r in walls.boundary_cycles(spans).collect()]
        faces = [(r.capture_id, len(r.walls)) for r in walls.boundary_faces(spans).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(cycles) == [(f"c{k}", "boundary_hypothesis_1", 4) for k in (2, 3, 6, 7)]
    assert sorted(n for c, n in faces if c == "c2") == [4] and sorted(c for c, _ in faces) == ["c2", "c3", "c3", "c3", "c6", "c7", "c7", "c7"]


def test_rooms_in_a_row_are_no_single_group(spark):
    """Each room overlaps the next: order decides along the whole row, and no task gets all of its rings."""
    from plumbline.operators import polygon

    box = lambda x, w: [[x, 0.0], [x + w, 0.0], [x + w, 3.0], [x, 3.0]]
    rows = [("p", k, f"r{k}", box(3.0 * k, 4.0 if k % 5 else 3.0)) for k in range(40)]
    got = polygon.stitch(spark.createDataFrame(rows, "property_id string, ordinal int, candidate_id string, vertices array<array<double>>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan.replace("MapInPandas", "") and "Broadcast" not in plan
    want = polygon.stitch_scan([(p, n, v) for p, _, n, v in rows], 0.05, 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[2] for r in want} == {"included_candidate", "excluded_overlap"}


def test_crowded_band_is_dealt_over_tasks(spark):
    from plumbline.operators.keyed import band_pairs

    rows = spark.range(60).selectExpr("id", "id % 3 * 0.3D AS v")
    got = band_pairs(rows, "id", "v", 0.5, piece=7)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60) if abs(a % 3 - b % 3) * 0.3 <= 0.5]


def test_near_duplicates_leave_no_shuffle_files(spark):
    """Files of finished steps would stay until the driver collects garbage: more than the texts."""
    from plumbline.llm import jaccard

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    rows = [(k, " ".join(f"w{(k // 2) * 40 + j + (j == 7) * k}" for j in range(60))) for k in range(40)]
    before = files()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert not files() - before
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: k - k % 2 for k in range(40)}


def test_pairs_of_a_larger_table_are_dealt_over_more_tasks(spark):
    """With a fixed number of tasks the memory of one grows with the table."""
    from plumbline.operators.keyed import cooccurrence

    parts = {}
    for n in (40, 400):
        rows = [(k // 4, (k * 7) % n) for k in range(n)] * 2 + [(0, None), (None, 1), (None, 2)]
        got = cooccurrence(spark.createDataFrame(rows, "g long, i long"), "g", "i", piece=30)
        parts[n] = got.rdd.getNumPartitions()
        groups = [{i for g, i in rows if g == k and i is not None} for k in range(n // 4)]
        assert sorted(map(tuple, got.collect())) == sorted({(a, b) for s in groups for a in s for b in s if a < b})
    assert parts[40] == 4 and 20 <= parts[400] <= 22
    assert cooccurrence(spark.createDataFrame([], "g long, i long"), "g", "i").count() == 0


def test_sets_of_pairs_meet_in_as_many_tasks_as_they_fill(spark):
    """edge_set_f1 joins two such sets; with a fixed number of tasks the memory of one grows with them."""
    from plumbline.operators import audit
    from plumbline.operators.keyed import cooccurrence

    rows = [(k // 4, k, k % 4) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, i long, n int")
    sides = [cooccurrence(df.where(w), "g", "i", piece=20) for w in ("n <= 2", "n >= 1")]
    got = audit.set_scores(*sides)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("SortMergeJoin [a") :]
    assert "hashpartitioning(a" in joined and "Exchange hashpartitioning(a#" in joined and ", 15)" in joined and ", 4)" not in joined
    assert tuple(got.first())[:3] == (100, 300, 300)


def test_a_row_on_both_sides_of_the_join_counts_twice(spark):
    """edge_set_f1 and cooccurrence_pairs: at a row counted once the tasks that join rows held half as much again as those of pairs."""
    from plumbline.operators.keyed import cooccurrence

    rows = [(k // 2, k) for k in range(400)] * 2
    got = cooccurrence(spark.createDataFrame(rows, "g long, i long"), "g", "i", piece=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(g#" in plan and ", 16), REPARTITION_BY_NUM" in plan and ", 8), REPARTITION_BY_NUM" not in plan
    assert sorted(map(tuple, got.collect())) == [(k, k + 1) for k in range(0, 400, 2)]


def shuffled_rows(spark):
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_band_shuffles_grow_with_the_table(spark):
    """Not with its square, whether its rows are spread or crowded."""
    from plumbline.operators.keyed import band_pairs

    before = shuffled_rows(spark)
    for values, n in (("id * 0.25D", 3), ("id % 2 * 0.25D", 2000), ("IF(id % 100 = 0, 7.9D, 8.1D)", 4000)):
        rows = spark.range(4000).selectExpr("id", f"{values} AS v")
        got = band_pairs(rows, "id", "v", 0.5, piece=50)
        assert got.count() == {3: 3999 + 3998, 2000: 4000 * 3999 // 2, 4000: 4000 * 3999 // 2}[n]
        after = shuffled_rows(spark)
        assert after - before < 20 * 4000, values
        before = after


def test_band_pairs_of_odd_values(spark):
    """Differences that round to the width, values no bucket holds, repeated and missing keys: what the comparison says."""
    from plumbline.operators.keyed import band_pairs

    inf, nan = float("inf"), float("nan")
    values = [None, nan, nan, inf, inf, -inf, -inf, 1e300, 1e300, -1e300, -1e300, 1e17, 1e17 + 16, -1e-20, 0.0, -0.0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 1.0, -0.5, -0.4, 2.0**52, 2.0**52 + 0.5, 2.0**53, 5e-324]
    rows = [(None if k % 13 == 5 else k % 23, v) for k, v in enumerate(values * 2)]
    for width in (0.5, 0.1, 0.2, 1 / 3):
        want = sorted((a, b) for a, x in rows for b, y in rows if None not in (a, b, x, y) and a < b and abs(x - y) <= width)
        for piece in (1, 100_000):
            assert sorted(map(tuple, band_pairs(spark.createDataFrame(rows, "id int, v double"), "id", "v", width, piece=piece).collect())) == want
