"""Temporal URL lists: every capture is judged by the entries active when it was fetched.

Dated add and remove events of a list entry become validity intervals
[from, to). A capture looks up its host, every parent domain and every
directory prefix of its URL. The as-of join is an equi-join on (pattern, level,
block): the days of an interval that lie between the first and the last capture
are cut into aligned blocks of 1, 2, 4, ... days, at most two of each size, and a
capture's day lies in one block of each size. An interval thus has rows by the
logarithm of its days, and the times are compared within a block. Captures whose
patterns no list names leave before they are spread over the sizes.

An entry's history is put in order day by day and then across its days, so its
changes of all time never meet in one task.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, scratch, written


def host_of(url: Column) -> Column:
    """Host in lower case without credentials, port or a trailing dot; null for a URL without one."""
    host = F.lower(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def lookup_patterns(url: Column) -> Column:
    """Patterns that cover a URL: host and parent domains (at least two labels), and host plus each directory prefix.

    An IP address has no parent domains.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    address = host.rlike(r"^\d+(\.\d+){3}$|^\[")
    domains = F.when((n >= 2) & ~address, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(
        F.slice(labels, i, n), "."))).otherwise(F.array(host))
    parts = F.split(path_of(url), "/")  # "/en/1.html" -> ["", "en", "1.html"]
    depth = F.size(parts) - 2           # the last part is a file name, the first is empty
    folders = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(
        host, F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, folders)))


def _first_and_rest(rows: DataFrame, neighbour: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a neighbour of their own day, which are one for an entry and day, and the others."""
    return rows.where(F.col(neighbour).isNull()), rows.where(F.col(neighbour).isNotNull())


def validity(events: DataFrame) -> DataFrame:
    """Events (list, pattern, action add | remove, at) -> intervals (list, pattern, valid_from, valid_to).

    ``valid_to`` is null while an entry is active. Of several events of an
    entry at one time the removal counts; repeated events change nothing.
    Events with a null pattern, time or unknown action are no events; a null
    list is a list of its own. No events give no intervals.
    """
    spark = events.sparkSession
    known = events.where(F.col("pattern").isNotNull() & F.col("at").isNotNull()
                         & F.col("action").isin("add", "remove"))
    at_once = known.groupBy("list", "pattern", F.to_date("at").alias("day"), "at").agg(
        F.max("action").alias("action"))  # remove > add
    of_day = Window.partitionBy("list", "pattern", "day").orderBy("at")
    of_entry = Window.partitionBy("list", "pattern").orderBy("day")  # over one row a day
    whole = of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    changes_at = scratch(spark, "url-changes")
    changes = written(at_once.withColumn("was", F.lag("action").over(of_day)).withColumn(
        "closing", F.last("action").over(whole)), changes_at)
    opening, later = _first_and_rest(changes, "was")
    opening = opening.withColumn("was", F.coalesce(F.lag("closing").over(of_entry), F.lit("remove")))
    turns = opening.unionByName(later).where(F.col("was") != F.col("action")).drop("was", "closing")
    turns_at = scratch(spark, "url-turns")
    turned = written(turns.withColumn("valid_to", F.lead("at").over(of_day)).withColumn(
        "opens", F.first("at").over(whole)), turns_at)
    closing, earlier = _first_and_rest(turned, "valid_to")
    closing = closing.withColumn("valid_to", F.lead("opens").over(of_entry))
    spans = written(closing.unionByName(earlier).where("action = 'add'").select(
        "list", "pattern", F.col("at").alias("valid_from"), "valid_to"), scratch(spark, "intervals"))
    discard(spark, changes_at, turns_at)
    return spans


def day_blocks(start: Column, end: Column, top: int) -> Column:
    """The days ``start``..``end`` (whole numbers, both included) as aligned blocks of 2^0..2^top days.

    An array of (level, block), at most two of a level; ``end`` + 1 is below 2^(top + 1).
    """
    def of_level(k: int) -> list[Column]:
        low = F.floor((start + (1 << k) - 1) / (1 << k)).cast("int")  # first block that begins in the range
        high = F.floor((end + 1) / (1 << k)).cast("int")              # first block that doesn't end in it
        block = [F.struct(F.lit(k).alias("level"), b.alias("block")) for b in (low, high - 1)]
        return [F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), block[0]),
                F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), block[1])]
    return F.filter(F.array(*[b for k in range(top + 1) for b in of_level(k)]), lambda b: b.isNotNull())


def judge(captures: DataFrame, events: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
          time_col: str = "fetched_at") -> DataFrame:
    """One row per row of ``captures``: page_id, url, fetched_at, n_active, lists (sorted, comma-joined), blocked.

    ``n_active`` counts the (list, pattern) entries active at fetch time that
    cover the URL. A URL without a host or a null time matches nothing; repeated
    rows are judged one by one, other columns are not read. Without captures the
    result is empty, without events nothing is blocked. A URL has one pattern for
    each label and directory, however long it is.
    """
    spark = captures.sparkSession
    rows = written(captures.select(captures[id_col].alias("page_id"), captures[url_col].cast("string").alias("url"),
                                   captures[time_col].cast("timestamp").alias("fetched_at"))
                   .withColumn("uid", F.monotonically_increasing_id()), scratch(spark, "captures"))
    day = lambda moment: F.unix_date(F.to_date(moment))
    first, last = rows.agg(F.min(day("fetched_at")), F.max(day("fetched_at"))).first()
    if first is None:
        first = last = 0
    top = max(0, (last - first + 1).bit_length() - 1)
    spans = validity(events).withColumn("start", F.greatest(day("valid_from"), F.lit(first)) - first).withColumn(
        "end", F.least(F.coalesce(day("valid_to"), F.lit(last)), F.lit(last)) - first).where("start <= end")
    blocks = spans.select("list", "pattern", "valid_from", "valid_to", F.inline(
        day_blocks(F.col("start"), F.col("end"), top)))
    looked = rows.where("fetched_at is not null").select(
        "uid", "fetched_at", (day("fetched_at") - first).alias("day"),
        F.explode(lookup_patterns(F.col("url"))).alias("pattern"))
    listed = looked.join(spans.select("pattern").distinct(), "pattern", "left_semi")
    spread = listed.select("uid", "fetched_at", "pattern", F.inline(F.array(*[F.struct(
        F.lit(k).alias("level"), F.shiftright("day", k).alias("block")) for k in range(top + 1)])))
    # sorted on both sides: the blocks grow with the lists, and their size is not known before they are made
    active = spread.join(blocks.hint("merge"), ["pattern", "level", "block"]).where(
        "fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    found = active.groupBy("uid").agg(F.count("*").alias("n_active"), F.array_join(
        F.sort_array(F.collect_set(F.coalesce("list", F.lit("")))), ",").alias("lists"))
    return rows.join(found, "uid", "left").select(
        "page_id", "url", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_active").isNotNull().alias("blocked"))
