import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import warc

SCHEMA = "record_id long, url string, ts timestamp, kind string, headers map<string,string>"
T0 = dt.datetime(2024, 1, 1)


def _canon(spark, *urls):
    return [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]


def test_canonical_urls(spark):
    assert _canon(spark, "HTTP://WWW.Example.com:80/A/b/?z=1&utm_source=x&a=2#frag", "example.com", "https://example.com/?ref=q", "https://m.example.com:8080/x", None) == ["example.com/A/b?a=2&z=1", "example.com", "example.com", "m.example.com:8080/x", None]


DAYS: dict[str, int] = {}


def _date(rnd, day):
    """The day of January 2024 in one of the forms that a server may send."""
    t = T0.replace(day=day)
    form = rnd.choice(["%a, %d %b %Y %H:%M:%S GMT", "%A, %d-%b-%y %H:%M:%S GMT", f"%a %b {day:2d} %H:%M:%S %Y", "%Y-%m-%d %H:%M:%S"])
    return DAYS.setdefault(t.strftime(form), day) and t.strftime(form)


def _plain(rows):
    out = {}
    for rid, url, ts, kind, h in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and ts is not None and r[2] is not None and (r[2], r[0]) < (ts, rid)]
        if not before:
            out[rid] = ("no_response", None)
            continue
        last = max(before, key=lambda r: (r[2], r[0]))
        mine, theirs = (h or {}).get("etag"), (last[4] or {}).get("etag")
        if mine is not None and theirs is not None:
            good = mine.removeprefix("W/") == theirs.removeprefix("W/")
        else:
            a, b = (last[4] or {}).get("last-modified"), (h or {}).get("last-modified")
            good = a is not None and b is not None and DAYS[a] <= DAYS[b]
        out[rid] = ("resolved", last[0]) if good else ("validator_mismatch", None)
    return out


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_against_a_scan(spark, ranges):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        url = "hot.example.com/x" if rnd.random() < 0.6 else f"e{rnd.randrange(20)}.example.com/y"
        kind = "response" if rnd.random() < (0.02 if url.startswith("hot") else 0.4) else "revisit"
        h = {"etag": rnd.choice(['"a"', 'W/"a"', '"b"'])} if rnd.random() < 0.7 else {"last-modified": _date(rnd, rnd.randrange(1, 29))} if rnd.random() < 0.8 else None
        rows.append((i, url if rnd.random() < 0.97 else None, T0 + dt.timedelta(seconds=rnd.randrange(60)) if rnd.random() < 0.97 else None, kind, h))
    got = {r.record_id: (r.status, r.response_id) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA), ranges).collect()}
    assert got == _plain(rows) and {s for s, _ in got.values()} == {"resolved", "no_response", "validator_mismatch"}


def test_headers_and_bodies(spark):
    rows = [
        (1, "http://e.com/a", T0, "response", {"content-type": "text/html", "etag": '"v"', "date": "old", "server": "one"}, "body"),
        (2, "https://www.e.com/a#x", T0 + dt.timedelta(1), "revisit", {"etag": '"v"', "date": "new", "server": "two", "set-cookie": "c"}, None),
        (2, "https://www.e.com/a#x", T0 + dt.timedelta(1), "revisit", {"etag": '"v"', "date": "new", "server": "two", "set-cookie": "c"}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", part string")
    done = warc.resolve(df)
    assert done.count() == 2
    assert all(r.headers == {"content-type": "text/html", "etag": '"v"', "date": "new", "server": "one"} for r in done.collect())
    assert {r.body for r in warc.with_bodies(done, df, "part").collect()} == {"body"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_http_dates(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        said = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "1994-11-06 08:49:37", " Sun, 06 Nov 1994 08:49:37 GMT ", "Monday, 01-Jan-70 00:00:00 GMT", "soon", "", None, "Sun, 06 Xxx 1994 08:49:37 GMT", "Sun, 31 Feb 1994 08:49:37 GMT"]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", F.unix_seconds(warc.http_time(F.col("x"), F.lit("2024-05-05 00:00:00").cast("timestamp"))).alias("t"))
        got = [r.t for r in df.orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [784111777] * 5 + [3155760000] + [None] * 5


def test_equal_http_dates_resolve_in_any_form(spark):
    rows = [(1, "e.com", T0, "response", {"last-modified": "Mon, 01 Jan 2024 00:00:00 GMT"})]
    rows += [(i, "e.com", T0 + dt.timedelta(i), "revisit", {"last-modified": x}) for i, x in enumerate(["Mon, 01 Jan 2024 00:00:00 GMT", "Monday, 01-Jan-24 00:00:00 GMT", "Mon Jan  1 00:00:00 2024", "Sun, 31 Dec 2023 23:59:59 GMT", "rubbish"], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("part", "found", "near", "carry", "first_url", "status", "canonical_url", "etag")})
    assert [r.status for r in warc.resolve(df).orderBy("record_id").collect()] == ["resolved"] * 3 + ["validator_mismatch"] * 2


def test_very_long_headers_and_urls(spark):
    long_ = "v" * 200_000
    rows = [(1, "e.com/" + long_, T0, "response", {"etag": long_}), (2, "e.com/" + long_, T0 + dt.timedelta(1), "revisit", {"etag": long_, "vary": long_})]
    assert [(r.status, len(r.headers["vary"])) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()] == [("resolved", 200_000)]
