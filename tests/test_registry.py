import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lagweave.plans import registry

SF = "/root/testdata/sf0.001"
QUICK = ["gene_profile", "profile_boot", "clade_aps", "vcf_profile", "derived_params", "file_pairing", "read_gene_join", "merged_moments", "zip_blocks", "histogram_auto", "fit_known", "lmfit_files", "gene_fit_data"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    a = registry.QUERIES[name](spark, SF).toPandas()
    b = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    tidy = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert tidy(a) == tidy(b)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
