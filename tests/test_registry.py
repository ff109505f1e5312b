"""Every registered query of the catalog and signal families runs and agrees in columns with its SQL twin's names."""

import importlib

import pytest

from spanfit.plans import registry

SF = "/root/testdata/sf0.001"


def test_names_and_twins():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) == sum(len(f.QUERIES) for f in registry.FAMILIES)
    assert sql.keys() <= queries.keys()
    without = queries.keys() - sql.keys()
    # folds, a CRC, and what unit tests hold against plain Python
    assert without == {"width_clusters", "rum_sample", "window_limiter", "bucket_limiter", "repeated_phrases", "repeated_prose", "slug_discovery"}


CHECKED = """fit_search cavity_counts evidence_match rum_percentiles url_predicates facet_search accuracy_audit feed_match fuzzy_match prefix_match batch_targets replacement_sources error_clean bad_vitals page_gate link_classes
    keyword_gaps coverage_similarity candidate_cascade query_intents failure_buckets best_document evidence_audit url_states fit_badges picked_products link_pools fit_calculator readable_specs""".split()


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    pd = pytest.importorskip("pandas")
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(tuple("None" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_has_all(spark):
    entry = importlib.import_module("__spark_entry__")
    assert registry.queries().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
