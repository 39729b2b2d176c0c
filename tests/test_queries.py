from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from gridx import queries
from gridx.operators import requests


def test_ranges_of_the_whole_table_are_merged(spark, sf_dir):
    ranges = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_quantity").collect():
        ranges[r["l_returnflag"]].append((r["l_partkey"], r["l_partkey"] + int(r["l_quantity"]) % 7))
    got = entry.queries()["merge_requests_lineitem"](spark, sf_dir).collect()
    assert sorted((r["grp"], r["start"], r["stop"]) for r in got) == sorted((g, *x) for g, found in ranges.items() for x in requests.merge_list(found))
    assert sum(r["n"] for r in got) == sum(a != b for found in ranges.values() for a, b in found)


def test_the_uniform_table_has_the_size_of_the_reference(spark, sf_dir):
    got = entry.queries()["uniform_table"](spark, sf_dir)
    assert got.columns == ["rid", *"ABCDEFGHIJ"] and got.count() == 1_000_000


TABLES = "region nation customer supplier part orders lineitem events".split()


#: Queries that write folders, stream, plan or draw random numbers; the driver compares all queries.
COMPARED = """stored_probe_orders clustered_rows_lineitem plan_json_orders plan_order_orders probe_product_orders probe_product_exclude_orders probe_parts_by_cells_orders
stored_configuration_orders merged_batches_orders streamed_probe_orders windowed_cells_events data_source_orders compressions_orders absent_rows_orders absent_rows_probe_orders
selected_volumes_orders index_sizes_orders bounded_files_orders written_report_orders aligned_columns matched_results weighted_top_gumbel weighted_top_per_group shuffled_nations
sampled_cells_orders benchmark_rows uniform_marginals_clusters radial_shells random_partitions random_range_queries quantile_edges_lineitem""".split()


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    expected = connection.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(str(tuple(map(str, r))) for r in found.select(*names).collect()) == sorted(str(tuple(map(str, r))) for r in expected.fetchall())
