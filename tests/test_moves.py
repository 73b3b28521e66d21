"""Moves whose objects and targets share keys."""

import duckdb

from siltbed.plans import registry

from .compare import same
from .conftest import SF


def test_move_status_where_targets_are_objects_too(spark, tmp_path):
    """Keys 5,000,000 apart make an object another's target: it then has two sizes, so where the length is of whole blocks two pieces begin at one block and end apart."""
    con = duckdb.connect()
    copy = f"COPY (SELECT {{}} FROM (SELECT range AS k FROM range(2)), '{SF}/{{}}.parquet') TO '{tmp_path}/{{}}.parquet' (FORMAT parquet)"
    con.execute(copy.format("* REPLACE (o_orderkey + k * 5000000 AS o_orderkey, 102400 + k * 28672.0 AS o_totalprice)", "orders", "orders"))
    con.execute(copy.format("* REPLACE (l_orderkey + k * 5000000 AS l_orderkey)", "lineitem", "lineitem"))
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    same(registry.QUERIES["d12_move_status"](spark, str(tmp_path)), con.execute(registry.ORACLE_SQL["d12_move_status"]).df())
