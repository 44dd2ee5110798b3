"""The driver contract in __spark_entry__.py."""

import importlib.util
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs_and_schema_is_stable(spark):
    m = _entry_module()
    a, b = m.entry(spark), m.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0
    assert set(a.columns) == {"user_id", "username", "segment_type", "total_amount", "order_count",
                              "avg_order_amount", "last_order_days", "update_time"}


def test_every_query_has_oracle_sql():
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert len(own) >= 100 and own <= set(o) <= set(q)
    assert all(isinstance(v, str) and v.strip() for v in o.values())
