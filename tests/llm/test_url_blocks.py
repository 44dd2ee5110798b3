"""URL lists: blocks of days, IP addresses, and the as-of join against a direct evaluation."""

import datetime as dt
import random

import pytest

pytest.importorskip("tidemark.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import url_lists  # noqa: E402

START = dt.datetime(2004, 1, 1)


def test_blocks_cover_their_days_once(lspark):
    rng = random.Random(3)
    spans = [tuple(sorted((rng.randrange(8192), rng.randrange(8192)))) for _ in range(150)] + [
        (0, 0), (8191, 8191), (0, 8191), (1, 8190), (0, 7304)]
    df = lspark.createDataFrame(spans, "a int, b int")
    for a, b, blocks in df.select("a", "b", url_lists.day_blocks(F.col("a"), F.col("b"), 13)).collect():
        days = sorted(d for x in blocks for d in range(x["block"] << x["level"], (x["block"] + 1) << x["level"]))
        assert days == list(range(a, b + 1)), (a, b)
        assert len(blocks) <= 26


def test_an_ip_address_has_no_parents(lspark):
    urls = ["http://1.2.3.4/a/b", "http://[2001:db8::1]:80/a/b", "http://a.b.c/x"]
    got = [sorted(r[0]) for r in lspark.createDataFrame([(u,) for u in urls], "u string").select(
        url_lists.lookup_patterns(F.col("u"))).collect()]
    assert got == [["1.2.3.4", "1.2.3.4/a/"], ["[2001:db8::1]", "[2001:db8::1]/a/"], ["a.b.c", "b.c"]]


@pytest.mark.parametrize("years", [20, 0])
def test_against_direct_evaluation(lspark, years):
    """Random events (many of them of one entry, many a day) and captures, also all captures on one day."""
    rng = random.Random(years)
    hosts = ["a.x.org", "x.org", "b.a.x.org", "1.2.3.4", "y.com"]

    def moment(spread):
        return START + dt.timedelta(minutes=rng.choice([0, 30, 720, 1439])) + dt.timedelta(days=rng.randrange(spread))
    events = [(rng.choice(["l", "m", None]), rng.choice(hosts + ["3.4", "x.org/d/"]), rng.choice(["add", "remove"]),
               moment(7300)) for _ in range(150)]
    events += [("l", "x.org", rng.choice(["add", "remove"]), START + dt.timedelta(days=rng.randrange(4), minutes=rng.randrange(1440)))
               for _ in range(200)]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'd/', 'd/e.html'])}",
                 moment(365 * years + 4 if years else 1)) for i in range(200)]

    def active(pattern, lst, at):
        past = [(t, a) for entry_list, p, a, t in events if p == pattern and entry_list == lst and t <= at]
        return bool(past) and max(past)[1] == "add"  # remove > add at one time
    want = {}
    for i, url, at in captures:
        host, path = url[7:].split("/", 1)
        labels = host.split(".")
        patterns = {host} if host == "1.2.3.4" else {".".join(labels[k:]) for k in range(len(labels) - 1)}
        if path.startswith("d/"):
            patterns.add(host + "/d/")
        hits = [(lst or "") for lst in ("l", "m", None) for p in patterns if active(p, lst, at)]
        want[i] = (len(hits), ",".join(sorted(set(hits))))
    ev = lspark.createDataFrame(events, "list string, pattern string, action string, at timestamp")
    cap = lspark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    rows = url_lists.judge(cap, ev).collect()
    assert {r["page_id"]: (r["n_active"], r["lists"]) for r in rows} == want and len(rows) == len(captures)
