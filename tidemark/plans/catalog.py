"""Query catalog: every registered query is a Spark job over the driver tables
plus (when SQL can express it) an independent DuckDB oracle formulation.

``register(name, sql=...)`` decorates ``fn(ctx) -> DataFrame``. ``ctx`` gives
the bound role frames (``ctx.users``, ``ctx.tickets`` ...) and the fixed
``as_of`` instants of the bound data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.roles_sql import with_roles
from tidemark.session import configure
from tidemark.sources import bind
from tidemark.sources.tables import Tables

# Fixed instants of the bound data (FIXTURES §3): orders end on 2001-08-01,
# events (tickets, dispatch, monitoring, alarms) on 2024-01-30.
ORDERS_AS_OF = dt.date(2001, 8, 1)
EVENTS_AS_OF = dt.datetime(2024, 1, 30, 23, 59, 59)
# Segment thresholds for the bound order amounts (reference defaults 500 / 100).
SEG_HIGH, SEG_MEDIUM = 3_000_000, 2_000_000

_QUERIES: dict[str, Callable[["Ctx"], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Ctx:
    """Per-call context: tables + role frames (built lazily, not cached)."""

    orders_as_of = ORDERS_AS_OF
    events_as_of = EVENTS_AS_OF

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    # role frames
    @property
    def users(self): return bind.users(self.t)
    @property
    def orders(self): return bind.orders(self.t)
    @property
    def items(self): return bind.order_items(self.t)
    @property
    def agents(self): return bind.agents(self.t)
    @property
    def tickets(self): return bind.tickets(self.t)
    @property
    def logs(self): return bind.ticket_logs(self.t)
    @property
    def devices(self): return bind.devices(self.t)
    @property
    def dispatch(self): return bind.dispatch(self.t)
    @property
    def changes(self): return bind.change_log(self.t)
    @property
    def equipment(self): return bind.equipment(self.t)
    @property
    def monitoring(self): return bind.monitoring(self.t)
    @property
    def alarms(self): return bind.alarms(self.t)


def register(name: str, sql: str | None = None, extra_ctes: dict[str, str] | None = None):
    def deco(fn: Callable[[Ctx], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_roles(sql, extra_ctes)
        return fn
    return deco


def _load_all() -> None:
    # importing the query modules fills the registry
    from tidemark.plans import (  # noqa: F401
        q_changes, q_equipment, q_grid, q_grid_mix, q_live, q_monitors, q_orders, q_scenarios, q_sinks, q_state, q_streaming,
        q_tickets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {name: (lambda spark, sf_dir, _fn=fn: _fn(Ctx(spark, sf_dir)))
            for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
