"""Incremental maintenance of the orders chain (ODS → DWD → DWS → ADS) from one
change stream, by signed deltas inside ``foreachBatch``.

Per micro-batch ``b`` (all reads are as of ``b - 1``, so a retried batch computes
the same rows and overwrites its own files):

1. ODS: user and order changes are appended to their PK tables as batch ``b``.
2. DWD: the changes of orders are joined with the users as of batch ``b`` and
   appended to the DWD table; so are the stored orders of the users that the
   batch changes, so late and renamed users reach the orders they have.
3. The DWD rows before and after the batch become signed rows of their users,
   so an order that moves between users, changes its status or vanishes is
   taken from the one and added to the other.
4. Counters: how many orders a user has, and how many completed ones per day
   and per instant. Only differences are added; no order is read again,
   however many its user has. The differences of the user's sums go with them.
5. DWS: a row per touched user: the sums, and the newest completed order. The
   newest moves up by the batch itself; where it was taken back, the newest day
   that still counts orders and in it the newest instant follow from the day
   counters of that user and the instants of that day.
6. ADS holds no copy: the segments follow from the DWS rows.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import orders as O
from tidemark.operators.changes import latest_changes
from tidemark.session import shared_path
from tidemark.sources import changes as CH
from tidemark.streaming.pktable import PKTable
from tidemark.streaming.totals import MONEY, SignedSums, changed_rows

USER_COLS = ["id", "username", "email", "created_at", "updated_at"]
ORDER_COLS = ["id", "user_id", "order_amount", "order_status", "created_at", "updated_at"]
DWD_COLS = ["order_id", "user_id", "username", "email", "order_amount", "order_status", "created_at",
            "updated_at"]
DWS_COLS = ["user_id", "username", "total_amount", "total_orders", "avg_order_amount", "last_order_date"]


class DwdOrders:
    """The DWD orders, kept by batch: every change of an order joined with the users as of its batch, and again when its
    user changes.

    A row has ``op`` and ``seq`` of the change of its order, so the newest row of an order is told as in its ODS table;
    ``users_at`` is the batch whose users it met: of several rows of one change the last one counts.
    """

    def __init__(self, spark: SparkSession, root: str, orders: PKTable, users: PKTable, day, buckets: int = 4):
        self.spark, self.orders, self.users, self.day = spark, orders, users, day
        # what tells changes of equal seq and op apart stands in the order of the ODS table, before ``users_at``
        self.table = PKTable(spark, f"{root}/dwd_orders", ["order_id"], buckets, schema=(
            "op string, seq bigint, order_id bigint, user_id bigint, order_amount decimal(12,2), order_status string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz, users_at bigint, username string, email string"))

    def as_of(self, version: int) -> DataFrame:
        return self.table.as_of(version).select(*DWD_COLS)

    def read(self) -> DataFrame:
        return self.table.read().select(*DWD_COLS)

    def apply(self, b: int, large: bool = False) -> None:
        """Write the DWD rows of batch ``b``, whose changes are in the ODS tables; ``large``: as its orders were written."""
        self.table.write_batch(self.rows(b, large), b, large=large)

    def rows(self, b: int, large: bool = False) -> DataFrame:
        """The DWD rows of batch ``b``. Without ``large`` only the users that they need are made of their changes."""
        orders = self.orders.log(b - 1, b).select("op", "seq", *ORDER_COLS)
        of, renamed = orders.select(F.col("user_id").alias("id")), self.users.log(b - 1, b)
        held = None if renamed is None else self.orders.changes_upto(b - 1)
        if held is not None:
            renamed = renamed.select("id")
            orders = orders.unionByName(self._of_users(held, renamed).select(*orders.columns))
            of = of.unionByName(renamed)
        rows = O.dwd_orders(orders, self._users(b, None if large else of), self.day, "op", "seq")
        return rows.select("op", "seq", *DWD_COLS, F.lit(b).cast("bigint").alias("users_at"))

    @staticmethod
    def _of_users(held: DataFrame, users: DataFrame) -> DataFrame:
        """Of the stored changes of orders the newest ones of orders of these users. Where an order went to another user
        later, or was deleted, a newer row in the DWD table says so."""
        theirs = held.join(users.withColumnRenamed("id", "user_id"), "user_id", "left_semi")
        return latest_changes(theirs, ["id"]).where("op <> 'd'")

    def _users(self, b: int, only: DataFrame | None) -> DataFrame:
        if not self.users.is_stored(b):
            return self.spark.createDataFrame([], self.users.schema())
        # dealt anew: AQE splits the orders of one user over tasks only where both sides of the join come straight from a shuffle
        return self.users.as_of(b, only).hint("rebalance")


class UserTops:
    """Per user: sums over the orders and the newest completed one, with retraction.

    ``counts`` has three kinds of rows. (user, -, -): the user's orders.
    (user, -, day): completed orders of a day. (user, day, instant): completed
    orders of an instant. The first two share the user's bucket and are at most
    a row a day; instants are spread over buckets by day.
    Each has its number of orders, ``n``; of the user's sums only the differences of a batch stand there, on
    their way to ``rows``, which keeps them.
    """

    # money in whole cents, added up as long in two parts: exact for more than 2**40 orders of a user
    SUMS = {"kept": "bigint", "high": "bigint", "low": "bigint", "n_amount": "bigint"}
    LOW = 20  # bits of ``low``

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.counts = SignedSums(spark, f"{root}/user_counts", ["user_id", "day", "slot"], {}, buckets,
                                 bucket_keys=["user_id", "day"], moved=self.SUMS)
        self.rows = PKTable(spark, f"{root}/dws_user_stats", ["user_id"], buckets, schema=(
            "op string, seq bigint, user_id bigint, n bigint, " + ", ".join(f"{c} {t}" for c, t in self.SUMS.items()) + ", top bigint"))

    @staticmethod
    def _side(c: str) -> list[F.Column]:
        """Of the row ``before`` or ``after``: its user, whether it counts as completed, cents and time; zeros without a user."""
        user, status = F.col(f"{c}.user_id"), F.col(f"{c}.order_status")
        kept = user.isNotNull() & ((status == "completed") | status.isNull())
        cents = F.when(kept, (F.col(f"{c}.order_amount") * F.lit(100).cast("decimal(3,0)")).cast("bigint"))
        return [x.alias(f"{n}_{c}") for n, x in {
            "user": user, "kept": kept.cast("bigint"), "cents": cents, "slot": F.when(kept, F.unix_micros(F.to_timestamp(f"{c}.created_at")))}.items()]

    def _signed(self, changed: DataFrame) -> DataFrame:
        """Signed rows of the counters. What an order was and is to the same user is one row of its sums, or none if
        that is the same. A row of the changed order is picked by its number: 0 what the order adds to its user or moves
        there, 1 what it takes from another, 2 and 3 its day and instant, 4 and 5 those it had."""
        both = changed.select(*self._side("before"), *self._side("after"))
        both = both.withColumn("same", F.coalesce(F.col("user_before") == F.col("user_after"), F.lit(False)))
        c, zero, i = F.col, F.lit(0).cast("bigint"), F.col("_i")

        def was(x):  # of the order before it, where it is the same user's
            return F.when(c("same"), x).otherwise(zero)

        def cents(side):
            return F.coalesce(f"cents_{side}", zero)

        def counted(side):
            return c(f"cents_{side}").isNotNull().cast("bigint")

        def day(side):
            return F.floor(c(f"slot_{side}") / F.lit(86_400_000_000)).cast("bigint")
        still = c("same") & (c("kept_before") == c("kept_after")) & c("cents_before").eqNullSafe(c("cents_after"))
        # only completed orders that have a time count for days and instants
        here = c("slot_before").eqNullSafe(c("slot_after")) & (c("same") | c("slot_after").isNull())
        numbers = [F.array(*[F.lit(k) for k in range(n)]) for n in (2, 6)]
        rows = both.select("*", F.explode(F.when(here, numbers[0]).otherwise(numbers[1])).alias("_i")).where(
            F.when(i == 0, c("user_after").isNotNull() & ~still).when(i == 1, c("user_before").isNotNull() & ~c("same"))
            .when(i < 4, c("slot_after").isNotNull()).otherwise(c("slot_before").isNotNull()))
        moved = F.when(i == 0, cents("after") - was(cents("before"))).when(i == 1, -cents("before"))
        return rows.select(
            F.when(i.isin(0, 2, 3), c("user_after")).otherwise(c("user_before")).alias("user_id"),
            F.when(i == 3, day("after")).when(i == 5, day("before")).alias("day"),
            F.when(i == 2, day("after")).when(i == 3, c("slot_after")).when(i == 4, day("before")).when(i == 5, c("slot_before")).alias("slot"),
            F.when(i == 0, F.lit(1) - was(F.lit(1))).when(i.isin(2, 3), F.lit(1)).otherwise(F.lit(-1)).cast("bigint").alias("n"),
            F.when(i == 0, c("kept_after") - was(c("kept_before"))).when(i == 1, -c("kept_before")).alias("kept"),
            F.shiftright(moved, self.LOW).alias("high"), moved.bitwiseAND(F.lit(2 ** self.LOW - 1)).alias("low"),
            F.when(i == 0, counted("after") - was(counted("before"))).when(i == 1, -counted("before")).alias("n_amount"))

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Rows of the users as ``o_<column>``, null where the user is deleted, and their batch as ``s``."""
        return rows.select("user_id", F.col("seq").alias("s"), *[F.when(F.col("op") != "d", F.col(c)).alias(f"o_{c}") for c in self._columns()])

    def _columns(self) -> list[str]:
        return ["n", *self.SUMS, "top"]

    def _newest_rows(self) -> list[F.Column]:
        """The stored columns of a user by its newest batch: numbers only, a plain hash aggregate."""
        return [F.max_by(f"o_{c}", "s").alias(f"o_{c}") for c in self._columns()]

    def read(self) -> DataFrame:
        """The current rows of the users: user_id, n, the sums, ``amount``, ``top``."""
        rows = self._stored(self.rows.changes_upto(None)).groupBy("user_id").agg(*self._newest_rows()).where("o_n IS NOT NULL")
        cents = F.col("o_high").cast("decimal(19,0)") * F.lit(2 ** self.LOW).cast("decimal(7,0)") + F.col("o_low")
        return rows.select("user_id", *[F.col(f"o_{c}").alias(c) for c in self._columns()],
                           (cents.cast("decimal(33,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY).alias("amount"))

    def apply(self, changed: DataFrame, b: int, spread: bool = False) -> None:
        """``changed``: the orders of a batch before and after it; ``spread``: they touch every bucket of the users."""
        touched = self.counts.add(self._signed(changed), b, spread)
        instant, total = F.col("day").isNotNull(), F.col("day").isNull() & F.col("slot").isNull()
        sums = ["n", *self.SUMS]  # of a user's only row of differences
        met = touched.where(total | instant).select(  # where a day changed, an instant did
            "user_id", F.lit(True).alias("hit"), *[F.when(total, F.col(f"d_{c}")).alias(c) for c in sums],
            F.when(instant & (F.col("n") > 0), F.col("slot")).alias("risen"), F.when(instant & (F.col("n") == 0), F.col("slot")).alias("gone"))
        stored = self.rows.changes_upto(b - 1, None if spread else touched.select("user_id"), whole_buckets=True)
        if stored is not None:
            met = met.unionByName(self._stored(stored), allowMissingColumns=True)
        else:
            met = met.withColumns({c: F.lit(None).cast("bigint") for c in ("s", *[f"o_{c}" for c in self._columns()])})
        # a user is touched where a counter changed
        met = met.groupBy("user_id").agg(*[F.max(c).alias(c) for c in ("hit", *sums, "risen", "gone")], *self._newest_rows()).where("hit")
        # an instant of this batch that no longer counts any order was at most the newest: it was the newest or it is not
        fell = F.coalesce(F.col("gone") >= F.col("o_top"), F.lit(False))
        met = met.withColumn("was", F.when(~fell, F.col("o_top")))
        lost = fell & ~F.coalesce(F.col("risen") > F.col("o_top"), F.lit(False))
        rows = met.select("user_id", *[(F.coalesce(f"o_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c) for c in sums],
                          lost.alias("lost"), F.greatest("was", "risen").alias("top")).persist()
        search, found = rows.where("lost").select("user_id"), rows.select("user_id", *sums, "top")
        if not search.isEmpty():  # the newest completed order of these users was taken back
            found = rows.join(self._newest(search, b), "user_id", "left").select(
                "user_id", *sums, F.when(F.col("lost"), F.col("at")).otherwise(F.col("top")).alias("top"))
        self.rows.write_batch(found.select(
            F.when(F.col("n") == 0, "d").otherwise("u").alias("op"), F.lit(b).cast("bigint").alias("seq"), "user_id", *sums, "top"), b)
        rows.unpersist()

    def _newest(self, users: DataFrame, b: int) -> DataFrame:
        """user_id, at: the newest instant that still counts completed orders, from the day counters of these users
        and the instants of one day each."""
        days = self.counts.table.as_of(b, only=users.select("user_id", F.lit(None).cast("bigint").alias("day")))
        newest = days.where("day IS NULL AND slot IS NOT NULL AND n > 0").groupBy("user_id").agg(F.max("slot").alias("day"))
        instants = self.counts.table.as_of(b, only=newest).where("day IS NOT NULL AND n > 0")
        return instants.groupBy("user_id").agg(F.max("slot").alias("at"))


class OrdersChain:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 4, as_of=dt.date(2001, 8, 1),
                 compact_every: int | None = None, with_daily: bool = False):
        """``compact_every``: after every n-th batch each table is compacted to a
        snapshot, so per-batch reads stop growing with the number of batches."""
        self.spark, self.root, self.as_of = spark, root, as_of
        self.compact_every = compact_every
        self.ods_users = PKTable(spark, f"{root}/ods_users", ["id"], buckets, schema=(
            "op string, seq bigint, id bigint, username string, email string, created_at timestamp_ntz, updated_at timestamp_ntz"))
        self.ods_orders = PKTable(spark, f"{root}/ods_orders", ["id"], buckets, schema=(
            "op string, seq bigint, id bigint, user_id bigint, order_amount decimal(12,2), order_status string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz"))
        self.dwd_orders = DwdOrders(spark, root, self.ods_orders, self.ods_users, as_of, buckets)
        self.dws_users = UserTops(spark, root, buckets)
        # per-date partial sums: every measure is invertible, so a batch adds signed differences
        self.with_daily = with_daily
        self.dws_daily = SignedSums(spark, f"{root}/dws_daily", ["stat_date"], {
            "amount": MONEY, "completed": "bigint", "pending": "bigint"}, buckets)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        self._process(batch, int(batch_id))  # each row of it is written once, then read from its table
        if self.compact_every and (int(batch_id) + 1) % self.compact_every == 0:
            for t in self.tables():
                t.compact(int(batch_id), expire=True)

    def tables(self) -> list[PKTable]:
        tables = [self.ods_users, self.ods_orders, self.dwd_orders.table, self.dws_users.counts.table, self.dws_users.rows]
        return tables + ([self.dws_daily.table] if self.with_daily else [])

    def _process(self, batch: DataFrame, b: int) -> None:
        users = batch.where(F.col("tbl") == "users").select("op", "seq", *USER_COLS)
        orders = batch.where(F.col("tbl") == "orders").select("op", "seq", *ORDER_COLS)
        self.ods_users.write_batch(users, b, empty=False)  # seldom any: written without a look at the batch first
        large = self.ods_orders.is_large(orders)
        self.ods_orders.write_batch(orders, b, large=large)
        self.dwd_orders.apply(b, large)
        changed = changed_rows(self.dwd_orders.table, b, columns=[c for c in ORDER_COLS if c not in ("id", "updated_at")])
        self.dws_users.apply(changed, b, large)
        if self.with_daily:
            before, after = (changed.where(F.col(c).isNotNull()).select(f"{c}.*") for c in ("before", "after"))
            self.dws_daily.apply(self._day_rows(after), self._day_rows(before), b)

    @staticmethod
    def _day_rows(orders: DataFrame) -> DataFrame:
        st = F.col("order_status")
        return orders.select(F.to_date("created_at").alias("stat_date"), F.lit(1).alias("n"), F.col("order_amount").alias("amount"),
                             (st == "completed").cast("int").alias("completed"), (st == "pending").cast("int").alias("pending"))

    def daily_stats(self) -> DataFrame:
        return self.dws_daily.read().select(
            "stat_date", F.col("n").alias("total_orders"), F.col("amount").cast("double").alias("total_amount"),
            F.col("completed").alias("completed_orders"), F.col("pending").alias("pending_orders"))

    def dashboard(self) -> DataFrame:
        """Order metrics of the realtime dashboard from the per-date partials
        (a table with one row per day) — no scan of the order facts."""
        day = F.lit(self.as_of.isoformat()).cast("date")
        return self.dws_daily.read().agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_orders"),
            F.coalesce(F.sum(F.when(F.col("stat_date") == day, F.col("n"))), F.lit(0)).cast("double").alias("today_orders"))

    # ------------------------------------------------------------- running
    def run(self, source_path: str, checkpoint: str, max_files_per_trigger: int = 1):
        """Process every staged change file (availableNow) and stop."""
        stream = CH.read_change_stream(self.spark, source_path, max_files_per_trigger=max_files_per_trigger).drop("event_time")
        q = (stream.writeStream.foreachBatch(self.process_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    def user_stats(self) -> DataFrame:
        """The columns of ``orders.user_stats_left`` but the run time: users without orders with zeros, those with
        completed orders with their sums; users whose orders are all open or cancelled are not listed."""
        s = self.dws_users.read().select(F.col("user_id").alias("_u"), "n", "kept", "amount", "n_amount", "top")
        u = O.dwd_users(self.ods_users.read(), self.as_of).select("user_id", "username")
        amount = F.col("amount").cast("double")
        return u.join(s, F.col("user_id") == F.col("_u"), "left").where("n IS NULL OR kept > 0").select(
            "user_id", "username", F.coalesce(amount, F.lit(0.0)).alias("total_amount"),
            F.coalesce("kept", F.lit(0).cast("bigint")).alias("total_orders"),
            F.coalesce(F.try_divide(amount, F.col("n_amount")), F.lit(0.0)).alias("avg_order_amount"),
            F.timestamp_micros("top").cast("timestamp_ntz").alias("last_order_date"))


def _staged(spark: SparkSession, t, n_batches: int, files_per_batch: int) -> tuple[str, int]:
    run = shared_path(spark, "orders_chain", uuid.uuid4().hex)
    return run, CH.stage_change_files(CH.chain_versions(t), f"{run}/changes", n_batches, files_per_batch)


def stage_chain(spark: SparkSession, t, n_batches: int = 3, files_per_batch: int = 4) -> str:
    """Land the bound change log in a new folder under the shared checkpoint folder; returns the folder."""
    return _staged(spark, t, n_batches, files_per_batch)[0]


def run_chain_from_tables(spark: SparkSession, t, n_batches: int = 3, files_per_batch: int = 4) -> OrdersChain:
    """Stage the bound change log as ``n_batches`` event-time ranges under the
    shared checkpoint folder (a fresh folder per run), stream it through the
    chain one range per micro-batch, return the chain."""
    return replay_chain(spark, *_staged(spark, t, n_batches, files_per_batch))


def replay_chain(spark: SparkSession, run: str, files_per_batch: int = 4) -> OrdersChain:
    """Stream the files that ``stage_chain`` landed through a new chain."""
    chain = OrdersChain(spark, f"{run}/tables")
    chain.run(f"{run}/changes", f"{run}/checkpoint", files_per_batch)
    return chain


def latest_per_key_stream(stream: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """Streaming latest-per-key (ODS ingest without a sink-side merge): the
    ``max_by`` aggregate keeps one row of state per key and, in ``update``
    output mode, emits the changed keys of each trigger. Deletes come out as
    rows with op = 'd' for the sink to apply."""
    from tidemark.operators.changes import op_rank
    vals = [c for c in stream.columns if c not in keys]
    w = stream.groupBy(*keys).agg(
        F.max_by(F.struct(*vals), F.struct(F.col(seq), op_rank(F.col(op)))).alias("_w"))
    return w.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in vals])
