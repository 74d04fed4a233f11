import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

FAST = (
    "history_filtered", "national_coverage", "municipality_list", "canonical_places", "map_version_join",
    "municipal_only", "best_layer", "run_ledger", "upsert_merge", "entry_classify", "url_policy_check",
    "catalogue_extract", "fuzzy_names", "import_candidates", "catalogue_entries", "ambiguous_elections",
    "already_normalised", "raw_rows", "csv_export_compact", "page_set_rejects", "history_page_deep", "registry_rows",
    "verification_store", "registry_file", "tree_levels", "manifest", "csv_export_files", "closure_list",
)


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_every_query_has_sql():
    from urna.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_no_plan_holds_a_cross_join(spark, small):
    for name in ("history_results", "municipality_coverage", "temporal_audit", "subject_totals"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, tmp_path, small):
    from urna.operators import facts as reads
    from urna.plans.election_view import facts

    path = str(tmp_path / "facts")
    facts(spark, small).write.partitionBy("category", "election_date").parquet(path)
    stored = spark.read.parquet(path)
    wanted = reads.filter_results(stored, category="camera", year=1996, municipality="Roma").select("votes")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "category" in plan.split("PartitionFilters")[1]
    assert "EqualTo(municipality_key,roma)" in plan


def test_the_view_is_passed_over_once(spark, small):
    """Pages of all kinds, and all parts of the coverage report, come from one pass over the rows."""
    from urna.operators import coverage
    from urna.plans.election_view import archives, facts
    from urna.plans.source_queries import _site_tree

    view = facts(spark, small)
    n = view.count()

    def counted():
        seen = spark.sparkContext.accumulator(0)

        def look(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return view.mapInArrow(look, view.schema), seen

    rows, seen = counted()
    site, roots = _site_tree(rows)
    assert site.count() > roots.count() > 0 and seen.value == n
    rows, seen = counted()
    asked = spark.createDataFrame([("ASIA", "ROMA")], "region string, municipality string")
    assert coverage.municipality_coverage(rows, archives(spark, small), asked).count() > 0 and seen.value == n
