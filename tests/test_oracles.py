"""Every registered query with an oracle agrees with DuckDB on the smallest test data."""

import pytest

from harness import compare, duck
from riskloom.plans.catalog import QUERIES
from riskloom.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
# Queries whose SQL oracle needs more rows than sf0.001 has (100-fraud windows).
NEEDS_MORE_ROWS = {"temporal_windows"}
NAMES = sorted(n for n in QUERIES if n in ORACLE and n not in NEEDS_MORE_ROWS)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
    assert r["cols_match"] and r["rows_spark"] == r["rows_oracle"] and r["hash_match"], r
    assert not r["type_mismatches"], r["type_mismatches"]


def test_every_query_has_oracle_or_is_model_or_stream():
    no_oracle = {n for n in QUERIES if n not in ORACLE}
    allowed_prefixes = ("model_", "job_", "tree_", "linear_", "global_", "isotonic_", "ablation_", "investigation_",
                        "seeded_")
    assert all(n.startswith(allowed_prefixes) for n in no_oracle), no_oracle
