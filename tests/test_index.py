import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridx.index import GridIndex
from gridx.operators import build, probe, requests, stats, synth
from gridx.plans.catalog import IndexSpec
from gridx.plans.planner import STRATEGIES, ProbePlan
from gridx.plans.predicates import parse, render
from gridx.sources import datasource, sinks, tables
from gridx.streaming import append

GROUPS = (("A", "C"), ("B", "D"), ("A",))


@pytest.fixture(scope="module")
def base(spark):
    return synth.uniform_table(spark, 3000, 4, seed=4).cache()


@pytest.fixture(scope="module")
def index(base):
    return GridIndex.over(base, GROUPS, bins=5).persist()


def ids(df):
    return sorted(r["rid"] for r in df.select("rid").collect())


def brute(base, query):
    keep = [(q.column, q.op, q.value) for q in parse(query)]
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    return sorted(r["rid"] for r in base.collect() if all(test[o](r[c], v) for c, o, v in keep))


QUERIES = ["A < 19 and B < 19 and C < 19", "A > 5 and B > 10 and D < 97", "A < 38 and C < 38 and B < 38 and C < 19", "D >= 30 and D < 60", "A > 200", "A > -1", "A > 9 and A < 1", "Z > 1 and A < 50", "A >= 13.25 and A <= 13.26"]


@pytest.mark.parametrize("text", QUERIES)
def test_all_strategies_agree_and_hold_the_answer(base, index, text):
    if "Z" in text:
        plan = index.plan(text)
        assert [x.column for x in plan.predicates] == ["Z", "A"] and {g.name for g in plan.groups} == {"A-C", "A"}
        return
    exact = brute(base, text)
    found = {s: ids(index.ids(text, strategy=s, parts=3)) for s in STRATEGIES}
    found |= {f"{s} without": ids(index.ids(text, strategy=s, exclude_above=0.0)) for s in STRATEGIES}
    assert len({tuple(v) for v in found.values()}) == 1
    assert set(exact) <= set(found["count"])
    assert ids(index.rows(base, text)) == exact
    assert ids(index.rows(base, text, scan_above=0.0)) == exact
    assert index.count(text, strategy="bitmap").first()["n"] == len(found["count"])
    enlarged = [x for x in parse(text)]
    from gridx.plans.predicates import enlarge

    wide = render(enlarge(enlarged, index.spec.edges))
    assert brute(base, wide) == ids(index.ids(wide) if wide else index.ids(text))


def test_random_rectangles(base, index):
    for text in synth.random_queries(index.spec.edges, 0.4, 4, seed=8):
        assert ids(index.ids(text, strategy="bitmap")) == brute(base, text) == ids(index.ids(text))


def test_every_row_is_in_each_group_once(base, index):
    for p in index.posts.values():
        row = p.agg(F.count("*").alias("n"), F.count_distinct("rid").alias("d")).first()
        assert row["n"] == row["d"] == 3000


def test_plan_order_and_json(index):
    plan = index.plan("A < 60 and B < 20 and D > 1")
    assert [g.name for g in plan.groups if not g.exclude][0] == "B-D"
    assert any(g.exclude for g in plan.groups)
    again = ProbePlan.from_json(plan.to_json())
    assert again == plan
    assert ids(index.ids(again)) == ids(index.ids(plan))


def test_other_filters_scan(base, index):
    assert index.rows(base, "A > 50 or B < 10").count() == base.where("A > 50 or B < 10").count()


def test_nan_and_null_rows(spark):
    rows = [(0, 1.0, 1.0), (1, math.nan, 1.0), (2, None, 1.0), (3, 9.0, None), (4, 5.0, 5.0), (5, math.inf, -math.inf)]
    df = spark.createDataFrame(rows, "rid long, v double, w double")
    index = GridIndex.over(df, (("v",), ("w",)), edges={"v": [2.0, 6.0], "w": [3.0]})
    assert {r["rid"] for r in index.posts["v"].where("b0 = 2").collect()} == {1, 2, 3, 5}
    assert ids(index.rows(df, "v > 6")) == [3, 5]
    assert ids(index.rows(df, "v <= 9 and w <= 5")) == [0, 4]
    assert ids(build.without_absent(df, ["v", "w"])) == [0, 4, 5]


def test_stored_index(spark, base, tmp_path):
    path = str(tmp_path / "i")
    index = GridIndex.create(base, path, GROUPS, bins=[5][0], compression="delta+zstd")
    again = GridIndex.open(spark, path)
    assert again.spec == index.spec and again.spec.rows == 3000
    text = "A < 19 and B < 50"
    assert ids(again.rows(base, text)) == brute(base, text)
    plan = sinks.plan_text(again.ids(text))
    assert "PushedFilters" in plan and "b0" in plan
    assert {r["grp"] for r in stats.stored_bytes(spark, path).collect()} == set(index.spec.names)
    build.write(base, index.spec, path)  # groups that exist stay
    assert GridIndex.open(spark, path).posts["A"].count() == 3000
    more = base.withColumn("rid", F.col("rid") + 3000)
    build.append(more, index.spec, path)
    assert GridIndex.open(spark, path).count("A > -1").first()["n"] == 6000
    assert len(ids(GridIndex.open(spark, path).rows(base.unionByName(more), text))) == 2 * len(brute(base, text))
    with pytest.raises(ValueError, match="batches"):
        build.write(base, IndexSpec((("B",),), {"B": index.spec.edges["B"]}), path)


def test_data_source_serves_ids_and_bins(spark, base, tmp_path):
    path = str(tmp_path / "i")
    index = GridIndex.create(base, path, GROUPS)
    datasource.register(spark)
    source = spark.read.format("gridx").option("path", path).option("group", "A-C").option("spec", index.spec.to_json())
    every = source.load()
    assert every.columns == ["rid", "cell", "A", "C"] and every.count() == 3000
    assert sorted(map(tuple, every.collect())) == sorted((r["rid"], r["cell"], r["b0"], r["b1"]) for r in index.posts["A-C"].collect())
    some = every.where("A < 2 and C >= 3 and C <> 4 and rid > 100")
    assert sorted(map(tuple, some.collect())) == sorted((r["rid"], r["cell"], r["b0"], r["b1"]) for r in index.posts["A-C"].collect() if r["b0"] < 2 and r["b1"] == 3 and r["rid"] > 100)
    found = source.option("query", "A < 19 and C >= 50").load()
    exact = brute(base, "A < 19 and C >= 50")
    assert set(exact) <= set(ids(found)) == set(ids(index.ids("A < 19 and C >= 50"))) | set(ids(found))
    assert ids(base.join(found.select("rid"), "rid", "left_semi").where("A < 19 and C >= 50")) == exact


def test_folder_of_another_configuration_is_refused(spark, base, tmp_path):
    path = str(tmp_path / "i")
    first = GridIndex.create(base, path, (("A", "C"),))
    more = GridIndex.create(base, path, (("A", "C"), ("B", "D")), edges=first.spec.edges | GridIndex.over(base, (("B", "D"),)).spec.edges)
    text = "A < 60 and B < 40 and D >= 20"
    assert set(more.spec.names) == {"A-C", "B-D"} and ids(more.rows(base, text)) == brute(base, text)
    with pytest.raises(ValueError, match="A"):
        GridIndex.create(base, path, (("A",),), edges={"A": [10.0, 20.0]})
    assert ids(GridIndex.open(spark, path).rows(base, text)) == brute(base, text)
    again = GridIndex.create(base, path, (("A",),), edges={"A": [10.0, 20.0]}, overwrite=True)
    assert again.spec.names == ["A"] and ids(again.rows(base, "A < 12")) == brute(base, "A < 12")


def test_batches_replace_themselves_and_broken_folders_are_told(spark, base, tmp_path):
    path = str(tmp_path / "i")
    index = GridIndex.create(base, path, GROUPS)
    more = base.withColumn("rid", F.col("rid") + 3000)
    for _ in range(2):
        build.append(more, index.spec, path, 4)
    assert GridIndex.open(spark, path).count("A > -1").first()["n"] == 6000
    build.remove(spark, f"{path}/postings/A/batch=4")
    build.remove(spark, f"{path}/stats/A/batch=4")
    with pytest.raises(ValueError, match="numbers of rows"):
        GridIndex.open(spark, path)
    build.remove(spark, f"{path}/postings/A")
    with pytest.raises(ValueError, match="missing"):
        GridIndex.open(spark, path)
    with pytest.raises(ValueError, match="no index"):
        GridIndex.open(spark, str(tmp_path / "none"))


def test_groups_that_leave_rows_out(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else float(i % 10), math.nan if i % 4 == 0 else float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, v double, w double").cache()
    for absent in (("v",), ("v", "w"), ()):
        index = GridIndex.create(df, str(tmp_path / "-".join(absent or ["all"])), (("v",), ("w",)), edges={"v": [3.0, 6.0], "w": [2.0]}, absent=absent)
        assert index.posts["v"].count() == (133 if "v" in absent else 200) and index.spec.rows == 200
        for text in ("v >= 0", "v < 3 and w >= 2", "w > -1", "v >= 0 and w >= 0", "v > 9 and v < 1"):
            exact = ids(df.where(" and ".join(f"({t} and not isnan({t.split()[0]}))" for t in text.split(" and "))))
            for strategy in STRATEGIES:
                assert ids(index.rows(df, text, strategy=strategy, scan_above=None)) == exact
                assert set(exact) <= set(ids(index.ids(text, strategy=strategy, exclude_above=0.1)))


def test_combinations_of_parts(base, index):
    text = "A < 60 and C >= 10 and B < 75 and D > 5"
    plain = ids(index.ids(text))
    for parts in ({"A-C": 3, "B-D": 4}, {"A-C": 2, "B-D": 2, "A": 2}, None):
        for more in ({"exclude_above": 1.0}, {"exclude": ("B-D", "A-C")}):
            assert ids(index.ids(text, strategy="expand", parts=parts, **more)) == plain
    with pytest.raises(ValueError, match="combinations"):
        index.ids(text, strategy="expand", parts={"A-C": 20, "B-D": 20}, exclude_above=1.0)


def test_clustered_table(spark, base, tmp_path):
    index = GridIndex.create(base, str(tmp_path / "c"), GROUPS, clustered=True)
    for text in ("A < 19 and C >= 50", "B < 3", "A > 9 and A < 1", "A > 50 or B < 2"):
        assert ids(index.rows(None, text)) == ids(base.where(text))


def test_lists_and_histogram(base, index):
    lists = index.lists("A-C", [(0, 2), (1, 3)]).collect()
    assert len(lists) == 4 and all(r["rids"] == sorted(r["rids"]) and len(r["rids"]) == r["cardinality"] for r in lists)
    h = build.histogram(base, index.spec, "B-D")
    assert h.count() == 25 and h.agg(F.sum("cardinality")).first()[0] == 3000


def test_bitmaps_round_trip(spark):
    values = [0, 1, 7, 8, 32767, 32768, 32769, 65535, 65536, 10**10]
    df = spark.createDataFrame([(v,) for v in values], "rid long")
    assert ids(probe.ids_of(probe.bitmaps(df))) == values


def test_merged_requests(spark):
    cases = [([(5, 7), (3, 5), (-1, 3)], 1, [(-1, 7)]), ([(5, 6), (3, 4), (1, 2)], 1, [(1, 2), (3, 4), (5, 6)]), ([], 1, []), ([(1, 2), (3, 4), (6, 7), (8, 8)], 2, [(1, 4), (6, 7)]), ([(1, 5), (2, 3), (5, 6)], 0, [(1, 5), (5, 6)])]
    for ranges, distance, expected in cases:
        assert requests.merge_list(ranges, distance) == expected
        df = spark.createDataFrame([("g", a, b) for a, b in ranges], "grp string, start long, stop long")
        assert sorted((r["start"], r["stop"]) for r in requests.merge_ranges(df, distance=distance, keep=True).collect()) == expected
    rng = random.Random(4)
    many = [(None if k % 9 == 0 else f"g{k % 3}", a := rng.randrange(2000), a + rng.choice([0, 1, 2, 5, 300 if k == 17 else 3])) for k in range(600)]
    df = spark.createDataFrame(many, "grp string, start long, stop long")
    by = {}
    for g, a, b in many:
        by.setdefault(g, []).append((a, b))
    expected = sorted((str(g), *x) for g, found in by.items() for x in requests.merge_list(found))
    for pieces in (1, 7, 40):
        assert sorted((str(r["grp"]), r["start"], r["stop"]) for r in requests.merge_ranges(df, pieces=pieces).collect()) == expected


def test_dealing():
    assert requests.deal([5, 1, 1, 1], 2) == [0, 1, 1, 1]
    assert requests.deal([1, 1, 5], 2, largest_first=True) == [1, 1, 0]
    assert requests.grouped([[1, 1], [1]], 1) == [[0, 0], [0]]
    assert requests.grouped([[1, 1], [1]], 3) == [[0, 1], [2]]
    assert requests.grouped([[3, 1], [2]], 2, whole_requests=True) == [[0, 0], [1]]
    assert requests.group_count(8) == 1 and requests.group_count(100) == 8 and requests.group_count(10_000) == 79
    parts = requests.split_counts(4, [10, 30, 0])
    assert parts[0] == [(0, 10)] and parts[1][-1][1] == 30 and parts[2] == []


def test_generators(spark):
    t = synth.uniform_table(spark, 500, 3, seed=9)
    assert t.orderBy("rid").collect() == t.repartition(7).orderBy("rid").collect()
    assert synth.column_names(28)[0] == "AA"
    p = synth.uniform_marginals(synth.cluster_prior(2, 6, [(1, 1), (4, 4)], 1.5))
    assert abs(p.sum() - 1) < 1e-9 and abs(p.sum(axis=0) - 1 / 6).max() < 1e-6
    d = synth.distribution_table(spark, p)
    region = synth.conditioned(d, F.col("cell") < 12)
    rows = synth.sample_cells(spark.range(4000).withColumnRenamed("id", "rid"), region.select("cell", "p"), "rid", "g", 3)
    found = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sum(found.values()) == 4000 and max(found) < 12
    for r in region.collect():
        assert abs(found.get(r["cell"], 0) / 4000 - r["p"]) < 0.05
    q = synth.subset_sizes([0.2, 0.3, 0.4])
    assert len(q) == 2 and abs(q.sum() - 1) < 1e-6 and (q >= 0).all() and synth.subset_sizes([0.3]).tolist() == [1.0]
    grids, masses = {g: region.select("cell", "p") for g in "ghi"}, {"g": 0.4, "h": 0.6, "i": 0.7}
    sweep = synth.benchmark_sweep(spark, grids, masses, 400, [0.0, 0.5, 1.0], seed=1)
    for share, df in sweep.items():
        rows = df.collect()
        assert sorted(r["rid"] for r in rows) == list(range(400))
        filled = [sum(r[g] is not None for g in "ghi") for r in rows]
        assert filled.count(3) == math.ceil(share * 0.4 * 400) and min(filled) >= 1
        if share == 1.0:
            assert all(r["g"] is None for r, n in zip(rows, filled) if n < 3)
    ordered = synth.benchmark_rows(spark, grids, masses, 100, 0.5, seed=1, start=7, shuffle=False).collect()
    assert sorted(r["rid"] for r in ordered) == list(range(7, 107)) and all((None not in tuple(r)) == (r["rid"] < 27) for r in ordered)
    assert synth.benchmark_rows(spark, grids, masses, 100, 0.5, seed=1, sampler=lambda d: d.where("grid = 'g'")).where("g is null").count() == 0


def test_sweep_of_indices(spark, tmp_path):
    p = synth.distribution_table(spark, synth.uniform_marginals(synth.shell_prior(1, 6)))
    grids = {g: synth.conditioned(p, F.col("cell") < 3).select("cell", "p") for g in ("g", "h")}
    found = synth.benchmark_sweep(spark, grids, {"g": 0.5, "h": 0.5}, 200, [0.5, 1.0], path=str(tmp_path), shape={"g": 6, "h": 6})
    for share, index in found.items():
        assert index.spec.rows == 200 and index.count("g < 3 and h < 3").first()["n"] == math.ceil(share * 0.5 * 200)


def test_cells_are_drawn_by_their_place(spark):
    p = {0: 0.1, 1: 1e-9, 2: 0.6, 3: 0.0, 4: 0.3 - 1e-9}
    d = spark.createDataFrame(list(p.items()), "cell long, p double")
    rows = synth.sample_cells(spark.range(500).withColumnRenamed("id", "rid"), d, "rid", "g", 3).collect()
    ends = [0.1, 0.1 + 1e-9, 0.7 + 1e-9]
    assert len(rows) == 500
    for r in rows:
        u = synth.chance(3, r["rid"], "g")
        assert r["g"] == (0 if u < ends[0] else 1 if u < ends[1] else 2 if u < ends[2] else 4)


@pytest.mark.parametrize("dims, bins, max_shell", [(2, 5, None), (2, 5, 2), (1, 6, None), (3, 4, None), (2, 5, 1)])
def test_radial_shells(spark, dims, bins, max_shell):
    if max_shell == 1:  # the outermost slices would be empty
        with pytest.raises(ValueError):
            synth.radial_shells(dims, bins, max_shell)
        return
    cells = {}
    for r in synth.radial_distribution(spark, dims, bins, max_shell).collect():
        cells[tuple(r["cell"] // bins**k % bins for k in range(dims))] = r["p"]
    of = lambda c: round(math.sqrt(sum((x - (bins - 1) / 2) ** 2 for x in c)))
    for axis in range(dims):
        for place in range(bins):
            assert sum(p for c, p in cells.items() if c[axis] == place) == pytest.approx(1 / bins)
    assert all(p >= 0 and (max_shell is None or of(c) <= max_shell or p == 0) for c, p in cells.items())
    assert len({(of(c), round(p, 12)) for c, p in cells.items()}) == len({of(c) for c in cells})


def test_random_partitions_and_boxes(spark):
    found = [r["groups"] for r in synth.random_partitions(spark, "ABCD", [2, 2], 3, seed=1).collect()]
    assert len(set(map(tuple, found))) == 3 and all(sorted("".join(f).replace("-", "")) == list("ABCD") for f in found)
    with pytest.raises(ValueError):
        synth.random_partitions(spark, "AB", [1, 1], 2, trials=50)
    with pytest.raises(ValueError):
        synth.random_partitions(spark, "AB", [1], 1)
    for number in range(20):
        boxes = {"a": (1, 3), "b": (0, 5)}
        moved = synth.moved(boxes, synth.shifts(boxes, {"a": 5, "b": 5}, 2, number))
        assert moved["b"] == (0, 5) and 0 <= moved["a"][0] and moved["a"][1] <= 5 and moved["a"][1] - moved["a"][0] == 2
    with pytest.raises(ValueError):
        synth.shifts({"a": (1, 9)}, {"a": 5}, 2)


def test_random_numbers_agree(spark):
    df = spark.range(20).select("id", synth.uniform(5, "id", F.lit("x")).alias("u"))
    assert all(r["u"] == synth.chance(5, r["id"], "x") for r in df.collect())
    places = sorted(r[0] for r in spark.range(91).select(synth.permuted(F.col("id"), 91, 3)).collect())
    assert places == list(range(91))


def test_row_ids_over_many_files(spark, tmp_path):
    paths = []
    for k, n in enumerate((3, 5, 2)):
        spark.range(k * 100, k * 100 + n).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        paths.append(str(tmp_path / f"p{k}"))
    rows = sorted((r["rid"], r["id"]) for r in tables.with_row_id(spark, paths[::-1]).collect())
    assert rows == list(enumerate([0, 1, 2, 100, 101, 102, 103, 104, 200, 201]))


def test_statistics(spark, base, index):
    report = stats.selectivity_report(base, index.spec, "A < 19 and B < 19").first()
    assert report["exact_rows"] == len(brute(base, "A < 19 and B < 19")) and report["index_rows"] == index.ids("A < 19 and B < 19").count()
    tasks = spark.createDataFrame([(0, "io", 0, 10), (0, "and", 10, 20), (1, "io", 0, 5)], "worker_id int, type string, start_ns long, stop_ns long")
    assert stats.utilisation(tasks).first()["utilisation"] == pytest.approx(25 / 40)
    assert {tuple(r) for r in stats.pivot_tasks(tasks, ["io", "and"]).collect()} == {(0, 1, 1), (1, 1, 0)}
    assert stats.without_constant_columns(tasks.withColumn("k", F.lit(1))).columns == tasks.columns


def test_stream_appends_batches(spark, tmp_path):
    spec = IndexSpec((("A", "B"),), {"A": [30.0, 60.0], "B": [50.0]})
    source = synth.uniform_table(spark, 900, 2, seed=6)
    for k in range(3):
        source.where(F.col("rid") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_stream(stream, spec, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    index = append.open_stream_index(spark, spec, str(tmp_path / "out"))
    text = "A < 40 and B >= 50"
    assert ids(index.rows(source, text)) == brute(source, text)
    assert index.stats.agg(F.sum("cardinality")).first()[0] == 900


def test_result_files_meet_their_statistics(spark, tmp_path):
    for run, stamp, n in (("a", "20240101T000000", 1), ("b", "20240102T000000", 2)):
        (tmp_path / f"{run}-{stamp}.json").write_text(json.dumps({"n": n}, indent=1))
    results = tables.run_results(spark, str(tmp_path))
    statistics = spark.createDataFrame([("a", "20240101T000000", 10), ("b", "20240101T000000", 20)], "run string, stamp string, ns long")
    assert {(r["run"], r["n"], r["ns"]) for r in tables.matched_results(results, statistics).collect()} == {("a", 1, 10), ("b", 2, None)}


def test_plans_and_reports_are_written(spark, base, index, tmp_path):
    found = [index.plan(t) for t in QUERIES[:3]]
    sinks.plans(spark, found, str(tmp_path / "plans"))
    assert sorted(p.to_json() for p in sinks.read_plans(spark, str(tmp_path / "plans"))) == sorted(p.to_json() for p in found)
    sinks.report(index.stats.select("grp", "cardinality"), str(tmp_path / "csv"), "csv")
    sinks.parquet(base, str(tmp_path / "t"), rows_per_file=1000)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000
