"""A spread of named queries against their SQL; ``tests/oracle.py`` runs all of them."""

import pytest

from logspark.catalog import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["scl_convert", "scl_severity_ues", "flt_auth_success", "prj_flatten", "det_csv_shape", "par_json", "par_xml",
         "jn_geo_range", "jn_threat_domain", "enr_threat", "alr_security_failure", "agg_alert_groups",
         "win_recent_evidence", "cor_intrusion_chain", "snk_upsert", "src_byte_offset", "set_dedup_receipt",
         "str_sessions", "onb_inspect", "enr_order", "cor_all", "par_json_deep"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES.get(name)) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
