"""Registered queries of the corpus operators against their SQL twins and contracts."""

from __future__ import annotations

import pytest

from cuemill import llm
from tests.comparing import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, name):
    assert spark_rows(llm.queries()[name](spark, SF)) == duck_rows(connection(SF), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_lm_scoring", "op6_quality_rules", "op7_quality_classifier", "op9_license_scans", "op10_token_counts"])
def test_a_row_for_each_document(spark, name):
    assert llm.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
