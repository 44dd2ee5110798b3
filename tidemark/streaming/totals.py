"""Aggregates kept up to date by signed deltas of a change stream.

A micro-batch is written to its ODS table; the rows it changes, as they were before and
are after it, come from one aggregate over the buckets it wrote, and only the differences
of the keys those rows belong to are added to the stored sums. No group is re-read, however
many rows it has; an agent, product or hour that holds a third of all rows costs one stored
row. Between the steps stand the tables' own files, not cached frames.

What is read beside the batch is as of the batch before, so a retried batch writes the same
rows again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import orders as O
from tidemark.operators.changes import op_rank
from tidemark.operators.metrics import metric_rows
from tidemark.streaming.pktable import PKTable

MONEY = "decimal(28,2)"


def changed_rows(table: PKTable, batch_id: int, by: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """The keys of the written batch with the structs ``before`` and ``after`` of the other ``columns`` (default: all): the row as of the
    batch before, and with the batch; null where there is none. The rows are dealt by key before they are aggregated:
    a batch has few rows a key, and a sort aggregate in front of the shuffle would sort them all for nothing. ``by``
    deals by some columns of the key, so that what follows is grouped by them without another shuffle."""
    vals = columns or [c for c in table.schema().names if c not in (*table.keys, table.op, table.seq)]
    order = F.struct(F.col(table.seq).alias("_seq"), op_rank(F.col(table.op)).alias("_rank"), F.col(table.op).alias("_op"), *vals)
    dealt = table.changes_with(batch_id).select(*table.keys, order.alias("_w"), "_new").repartition(*(by or table.keys))
    if table.is_stored(batch_id - 1):
        last = dealt.groupBy(*table.keys).agg(F.max("_w").alias("after"), F.max(F.when(~F.col("_new"), F.col("_w"))).alias("before"),
                                              F.max("_new").alias("_new"))
    else:  # nothing was there before
        last = dealt.groupBy(*table.keys).agg(F.max("_w").alias("after")).select(
            "*", F.when(F.lit(False), F.col("after")).alias("before"), F.lit(True).alias("_new"))

    def alive(c):
        return F.when(F.col(f"{c}._op") != "d", F.struct(*[F.col(f"{c}.{x}").alias(x) for x in vals])).alias(c)
    return last.where("_new").select(*table.keys, alive("before"), alive("after"))


def signed_rows(changed: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The rows before a batch with ``sign`` -1 and those after it with 1, in one pass over ``changed_rows``."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("o")),
                   F.struct(F.lit(1).alias("sign"), F.col("after").alias("o")))
    return changed.select(*keys, F.explode(both).alias("_x")).where("_x.o IS NOT NULL").select(*keys, "_x.sign", "_x.o.*")


class SignedSums:
    """Sums per key in a PK table. ``sums`` maps a column to its type and must hold ``n``, the number
    of rows of the key: a key whose ``n`` falls to 0 is deleted. A NULL key is a key; a NULL measure adds
    nothing. A log row holds the sums of its key and, as ``d_<sum>``, what its batch added: the sums as of a
    batch are those of the snapshot plus the differences after it, a plain hash aggregate. ``moved`` are sums of
    which only the differences are wanted: the log has them as ``d_<sum>``, and no total is kept."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, str], buckets: int = 4,
                 bucket_keys: list[str] | None = None, moved: dict[str, str] | None = None):
        self.keys, self.sums = keys, {"n": "bigint"} | sums
        self.all = self.sums | (moved or {})
        self.table = PKTable(spark, path, keys, buckets, bucket_keys=bucket_keys)

    def signed(self, rows: DataFrame, sign) -> DataFrame:
        """The rows with their measures added (``sign`` 1) or taken away (-1): one number or a column. NULL adds nothing."""
        less = F.lit(sign) < 0 if isinstance(sign, int) else sign < 0
        values = {c: F.col(c).cast(t) for c, t in self.all.items()}
        return rows.select(*self.keys, *[F.when(less, -v).otherwise(v).alias(c) for c, v in values.items()])

    def apply(self, after: DataFrame, before: DataFrame, batch_id: int) -> DataFrame:
        """Add the rows ``after`` the batch and take away those ``before`` it (key and sum columns each, one row
        per source row). Returns the keys touched with their sums, ``n_before``, and the differences as ``d_<sum>``."""
        return self.add(self.signed(after, 1).unionByName(self.signed(before, -1)), batch_id)

    def add(self, signed: DataFrame, batch_id: int, spread: bool = False, by: list[str] = ()) -> DataFrame:
        """Add signed rows. The stored sums and the differences meet in one aggregate, over the touched buckets or,
        for rows known to be ``spread`` over them, over all without a look at them first; these are written where they
        are. ``by``: the columns of the key that the rows are dealt by; the stored ones are dealt to them, and no row
        of the batch again. Returns the batch as written."""
        held, only, old = None, None, [p for p in self.table.stored(batch_id - 1) if p is not None]
        if old and not spread:
            held = signed = signed.groupBy(*self.keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in self.all.items()]).persist()
            only = held.select(*self.table.bucket_keys)
        both = signed.select(*self.keys, *[F.col(c).cast(t).alias(f"d_{c}") for c, t in self.all.items()])

        def total(c, t):
            return F.coalesce(F.sum(c).cast(t), F.lit(0).cast(t))
        if old:  # a NULL costs an aggregate less than adding a zero
            was = self._was(batch_id - 1, only)
            both = both.unionByName(was.repartition(*by) if by and spread else was, allowMissingColumns=True)
        met = both.groupBy(*self.keys).agg(*[total(f"d_{c}", t).alias(f"d_{c}") for c, t in self.all.items()],
                                           *[(total(c, t) if old else F.lit(0).cast(t)).alias(c) for c, t in self.sums.items()])
        new = met.where(" OR ".join(f"d_{c} <> 0" for c in self.all)).select(
            *self.keys, *[f"d_{c}" for c in self.all], *[(F.col(c) + F.col(f"d_{c}")).cast(t).alias(c) for c, t in self.sums.items()])
        self.table.write_batch(new.select(
            F.when(F.col("n") == 0, "d").otherwise("u").alias("op"), F.lit(batch_id).cast("bigint").alias("seq"), "*"), batch_id, large=spread)
        if held is not None:
            held.unpersist()
        return self.table.log(batch_id - 1, batch_id).select(
            *self.keys, (F.col("n") - F.col("d_n")).alias("n_before"), *[f"d_{c}" for c in self.all], *self.sums)

    def _was(self, version: int | None, only: DataFrame | None = None) -> DataFrame:
        """Rows of the touched buckets whose sums per key are those as of batch ``version``."""
        snap, log = self.table.stored(version)
        parts = []
        if snap is not None:
            parts.append(self.table.restrict(snap, only).where("op <> 'd'").select(*self.keys, *self.sums))
        if log is not None:
            parts.append(self.table.restrict(log, only).select(*self.keys, *[F.col(f"d_{c}").alias(c) for c in self.sums]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self) -> DataFrame:
        if self.table.schema() is None:
            raise FileNotFoundError(self.table.path)
        return self._was(None).groupBy(*self.keys).agg(
            *[F.sum(c).cast(t).alias(c) for c, t in self.sums.items()]).where("n <> 0")


class _Totals:
    """A chain of an ODS table and the sums over it, fed by ``process_batch`` in ``foreachBatch``."""

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        self._process(batch, int(batch_id))  # each row of it is written once, then read from its table

    @staticmethod
    def _change(table: PKTable, changes: DataFrame, b: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Write the batch; the rows of its keys before and after it, and the persisted frame behind both."""
        table.write_batch(changes, b, large=table.is_large(changes))
        rows = changed_rows(table, b).persist()
        before, after = (rows.where(F.col(c).isNotNull()).select(*table.keys, f"{c}.*") if len(changes.columns) > len(table.keys) + 2
                         else rows.where(F.col(c).isNotNull()).select(*table.keys) for c in ("before", "after"))
        return before, after, rows

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Process what is there (availableNow) and stop; a later run goes on from the checkpoint."""
        (stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


class TicketTotals(_Totals):
    """Ticket stream -> workload per agent, daily ticket stats, ticket dashboard."""

    COLS = ["ticket_id", "agent_id", "status", "created_at", "updated_at", "closed_at"]

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.ods = PKTable(spark, f"{root}/ods_tickets", ["ticket_id"], buckets)
        self.by_agent = SignedSums(spark, f"{root}/by_agent", ["agent_id", "day"], {
            "active": "bigint", "resolved": "bigint", "minutes": "bigint", "n_minutes": "bigint"}, buckets)
        self.by_day = SignedSums(spark, f"{root}/by_day", ["day"], {
            "resolved": "bigint", "closed": "bigint", "pending": "bigint", "hours": "bigint", "n_hours": "bigint"}, buckets)

    @staticmethod
    def _moves(t: DataFrame) -> DataFrame:
        """Signed sums per agent, day of the last update and day of creation: those of both tables follow from them."""
        st, sign = F.col("status"), F.col("sign")
        m, h = R.minutes_between("created_at", "updated_at"), R.hours_between("created_at", "closed_at")
        ones = {"active": st.isin("pending", "in_progress"), "n_minutes": m.isNotNull(), "n_hours": h.isNotNull(),
                **{s: st == s for s in ("resolved", "closed", "pending")}}
        return t.groupBy("agent_id", F.to_date("updated_at").alias("updated"), F.to_date("created_at").alias("created")).agg(
            F.sum(sign).alias("n"), F.sum(m * sign).alias("minutes"), F.sum(h * sign).alias("hours"),
            *[F.sum(F.when(c, sign).otherwise(0)).alias(k) for k, c in ones.items()])

    def _process(self, batch: DataFrame, b: int) -> None:
        self.ods.write_batch(batch.select("op", "seq", *self.COLS), b, large=self.ods.is_large(batch))
        moves = self._moves(signed_rows(changed_rows(self.ods, b))).persist()
        for sums, day in ((self.by_agent, "updated"), (self.by_day, "created")):
            rows = moves.withColumn("day", F.coalesce(F.col(day).cast("string"), F.lit("")))
            if sums is self.by_agent:
                rows = rows.where("agent_id IS NOT NULL")
            sums.add(sums.signed(rows, 1), b)
        moves.unpersist()

    def agent_workload(self, agents: DataFrame, as_of: dt.datetime) -> DataFrame:
        """The columns of ``tickets.agent_workload`` but the run time, from one row per agent and day."""
        today = F.when(F.col("day") == as_of.date().isoformat(), F.col("resolved"))
        per = self.by_agent.read().groupBy(F.col("agent_id").alias("_a")).agg(
            F.sum("active").alias("active"), F.sum(today).alias("today"), F.sum("minutes").alias("m"), F.sum("n_minutes").alias("k"))
        z = F.lit(0).cast("bigint")
        return agents.join(per, F.col("agent_id") == F.col("_a"), "left").select(
            "agent_id", "agent_name", "department", F.coalesce("active", z).alias("active_tickets"),
            F.coalesce("today", z).alias("resolved_today"),
            F.try_divide(F.col("m").cast("double"), F.col("k")).alias("avg_response_time_minutes"))

    def daily_stats(self) -> DataFrame:
        return self.by_day.read().select(
            F.when(F.col("day") != "", F.col("day")).cast("date").alias("stat_date"), F.col("n").alias("total_created"),
            F.col("resolved").alias("total_resolved"), F.col("closed").alias("total_closed"),
            F.try_divide(F.col("hours").cast("double"), F.col("n_hours")).alias("avg_resolution_time_hours"))

    def dashboard(self) -> DataFrame:
        one = self.by_day.read().agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_tickets"),
            F.coalesce(F.sum("pending"), F.lit(0)).cast("double").alias("pending_tickets"),
            F.try_divide(F.sum("hours").cast("double"), F.sum("n_hours")).alias("avg_resolution_time"))
        return metric_rows(one, ["total_tickets", "pending_tickets", "avg_resolution_time"])


class OrderTotals(_Totals):
    """Users and orders stream -> hourly order sums, from which come the daily stats, the sales trend and
    the six dashboard rows."""

    ORDER = ["id", "order_amount", "order_status", "created_at"]

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.orders = PKTable(spark, f"{root}/ods_orders", ["id"], buckets)
        self.users = PKTable(spark, f"{root}/ods_users", ["id"], buckets)
        self.by_hour = SignedSums(spark, f"{root}/by_hour", ["hour"], {
            "amount": MONEY, "completed": "bigint", "pending": "bigint", "sales": MONEY, "n_sales": "bigint"}, buckets)
        self.n_users = SignedSums(spark, f"{root}/n_users", ["what"], {}, 1)

    @staticmethod
    def _hour_rows(o: DataFrame) -> DataFrame:
        st, amount = F.col("order_status"), F.col("order_amount")
        sales = F.when(st == "completed", amount)
        return o.select(
            F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH"), F.lit("")).alias("hour"), F.lit(1).alias("n"),
            amount.alias("amount"), (st == "completed").cast("int").alias("completed"), (st == "pending").cast("int").alias("pending"),
            sales.alias("sales"), sales.isNotNull().cast("int").alias("n_sales"))

    @staticmethod
    def _user_rows(u: DataFrame) -> DataFrame:
        return u.select(F.lit("users").alias("what"), F.lit(1).alias("n"))

    def _process(self, batch: DataFrame, b: int) -> None:
        users = batch.where("tbl = 'users'").select("op", "seq", "id")
        if not users.isEmpty():  # one column of the batch
            u0, u1, rows = self._change(self.users, users, b)
            self.n_users.apply(self._user_rows(u1), self._user_rows(u0), b).unpersist()
            rows.unpersist()
        o0, o1, rows = self._change(self.orders, batch.where("tbl = 'orders'").select("op", "seq", *self.ORDER), b)
        touched = self.by_hour.apply(self._hour_rows(o1), self._hour_rows(o0), b)
        for df in (rows, touched):
            df.unpersist()

    def _days(self) -> DataFrame:
        day = F.when(F.col("hour") != "", F.substring("hour", 1, 10)).cast("date")
        return self.by_hour.read().withColumn("stat_date", day)

    def daily_stats(self) -> DataFrame:
        return self._days().groupBy("stat_date").agg(
            F.sum("n").alias("total_orders"), F.sum("amount").cast("double").alias("total_amount"),
            F.sum("completed").alias("completed_orders"), F.sum("pending").alias("pending_orders"))

    def sales_trend(self) -> DataFrame:
        start = F.to_timestamp_ntz(F.concat(F.when(F.col("hour") != "", F.col("hour")), F.lit(":00:00")))
        return self.by_hour.read().where("completed > 0").select(
            start.alias("hour_start"), F.col("sales").cast("double").alias("total_sales"), F.col("completed").alias("order_count"),
            F.try_divide(F.col("sales").cast("double"), F.col("n_sales")).alias("avg_order_value"))

    def dashboard(self, as_of: dt.date) -> DataFrame:
        """metric_name, metric_value, metric_desc of ``orders.realtime_dashboard``."""
        z, today = F.lit(0.0), F.col("stat_date") == F.lit(as_of.isoformat()).cast("date")

        def total(c, *cond):
            x = F.col(c)
            return F.coalesce(F.sum(F.when(cond[0], x) if cond else x).cast("double"), z)
        one = self._days().agg(
            total("n").alias("total_orders"), total("sales").alias("total_sales"),
            F.coalesce(F.try_divide(total("sales"), F.sum("n_sales")), z).alias("avg_order_value"),
            total("n", today).alias("today_orders"), total("sales", today).alias("today_sales"))
        users = self.n_users.read().agg(total("n").alias("total_users"))
        rows = metric_rows(users, ["total_users"]).unionByName(
            metric_rows(one, ["total_orders", "total_sales", "avg_order_value", "today_orders", "today_sales"]))
        desc = F.create_map(*[x for k, v in O.DASHBOARD_DESC.items() for x in (F.lit(k), F.lit(v))])
        return rows.withColumn("metric_desc", desc[F.col("metric_name")])


class ProductTotals(_Totals):
    """Order item stream -> product stats. The number of distinct orders of a product moves by one where a
    (product, order) pair appears or vanishes, so no product's orders are counted again. Of a pair only its number of
    items is kept; its other measures are differences on their way to the product."""

    KEY = ["order_id", "l_linenumber", "item_partkey", "item_suppkey", "created_at"]
    COLS = [*KEY, "product_name", "quantity", "unit_price"]
    # money in whole cents, added up as long: sales (up to 10**18 an item) in two parts, of more than 2**30 rows each
    PARTS = ["quantity", "sales_high", "sales_low", "price", "n_price"]
    LOW = 30  # bits of ``sales_low``

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.ods = PKTable(spark, f"{root}/ods_items", self.KEY, buckets)
        self.pairs = SignedSums(spark, f"{root}/product_orders", ["product_name", "order_id"], {}, buckets,
                                moved=dict.fromkeys(self.PARTS, "bigint"))
        self.products = SignedSums(spark, f"{root}/products", ["product_name"], {
            "orders": "bigint", "quantity": "bigint", "sales": MONEY, "price": MONEY, "n_price": "bigint"}, buckets)

    @classmethod
    def _pair_rows(cls, i: DataFrame) -> DataFrame:
        cents = i.select("sign", "product_name", "order_id", "quantity", (F.col("unit_price") * 100).cast("bigint").alias("price"))
        sales = F.col("quantity") * F.col("price")
        return cents.select("sign", "product_name", "order_id", F.lit(1).alias("n"), "quantity", F.shiftright(sales, cls.LOW).alias("sales_high"),
                            sales.bitwiseAND(F.lit(2 ** cls.LOW - 1)).alias("sales_low"), "price",
                            F.col("price").isNotNull().cast("int").alias("n_price"))

    def _process(self, batch: DataFrame, b: int) -> None:
        large, by = self.ods.is_large(batch), ["order_id"]
        self.ods.write_batch(batch.select("op", "seq", *self.COLS), b, large=large)
        # the rows of an order meet once: its items' versions, then its pairs with products
        items = self._pair_rows(signed_rows(changed_rows(self.ods, b, by), by))
        pairs = self.pairs.add(self.pairs.signed(items, F.col("sign")), b, large, by)
        self._changed_products(self.products.add(self._moved(pairs), b), b)

    def _moved(self, pairs: DataFrame) -> DataFrame:
        """What the pairs of a product changed by; a pair that appeared or vanished is an order."""
        order = (F.col("n") > 0).cast("bigint") - (F.col("n_before") > 0).cast("bigint")
        per = pairs.groupBy("product_name").agg(F.sum(order).alias("orders"), *[F.sum(f"d_{c}").alias(c) for c in self.pairs.all])

        def money(cents):
            return (cents.cast("decimal(33,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)
        sales = F.col("sales_high").cast("decimal(19,0)") * F.lit(2 ** self.LOW).cast("decimal(10,0)") + F.col("sales_low")
        return per.select("product_name", "n", "orders", "quantity", money(sales).alias("sales"),
                          money(F.col("price")).alias("price"), "n_price")

    def _changed_products(self, touched: DataFrame, b: int) -> None:
        """Called with the products of a batch, their sums and differences."""

    def product_stats(self) -> DataFrame:
        """The columns of ``orders.product_stats`` but the run time."""
        return self.products.read().select(
            "product_name", F.col("quantity").alias("total_quantity"), F.col("sales").cast("double").alias("total_sales"),
            F.col("orders").alias("total_orders"), F.try_divide(F.col("price").cast("double"), F.col("n_price")).alias("avg_price"))
