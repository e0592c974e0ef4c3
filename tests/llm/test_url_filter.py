"""URL filter: intervals and as-of join against a plain loop; odd rows."""

import datetime as dt
import random

from astrolabe.llm.url_filter import capture_keys, filter_captures, validity
from pyspark.sql import functions as F

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def test_keys(spark):
    urls = {"https://U:p@A.b.Co.uk.:80/x/y?q#f": ["d:a.b.co.uk", "d:b.co.uk", "d:co.uk", "d:uk", "u:a.b.co.uk/x/y"],
            "http://h": ["d:h", "u:h"], "nonsense": [], "": [], "http:///x": [],
            "http://" + "a." * 200 + "b/p": [*("d:" + "a." * k + "b" for k in range(126, -1, -1)), "u:" + "a." * 200 + "b/p"],
            "http://" + "c" * 300: ["u:" + "c" * 300], "http://" + "c" * 100 + "." + "e" * 253: ["d:" + "e" * 253, "u:" + "c" * 100 + "." + "e" * 253]}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.k for r in df.select("url", capture_keys(F.col("url")).alias("k")).collect()} == urls


def test_against_a_plain_loop(spark):
    rng = random.Random(1)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "w.y.org"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["d:" + h for h in hosts] + ["d:com", "u:y.org/p"]), rng.choice(["add", "remove"]), D(rng.randint(0, 40)))
               for _ in range(120)]
    captures = [(k, f"http://{rng.choice(hosts)}/{rng.choice('pq')}?z", D(rng.randint(-2, 45))) for k in range(300)]
    captures += captures[:5]

    def active(key, list_name, day):
        state = False
        for d in range(-5, (day - D(0)).days + 1):
            actions = {a for n, k, a, e in entries if (n, k, e) == (list_name, key, D(d))}
            state = False if "remove" in actions else True if "add" in actions else state
        return state
    want = []
    for k, url, day in captures:
        address = url[7:].split("?")[0]
        host = address.split("/")[0]
        keys = ["u:" + address] + ["d:" + ".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)]
        lists = sorted({n for n in ("l1", "l2") for key in keys if active(key, n, day)})
        want.append((k, host, day, ",".join(lists), bool(lists)))
    got = filter_captures(spark.createDataFrame(captures, "page_id long, url string, fetch_day date"),
                          spark.createDataFrame(entries, "list string, key string, action string, day date"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(spark):
    captures = spark.createDataFrame(
        [(1, None, D(1), "x"), (None, "http://a.b/", D(1), "y"), (2, "", D(1), None), (3, "http://a.b/", None, "z"), (4, "http://a.b/" + "p" * 100_000, D(1), ""),
         (5, "http://a.b/", D(1), ""), (5, "http://a.b/", D(1), "")], "page_id long, url string, fetch_day date, spans string")
    entries = spark.createDataFrame([("l", "d:a.b", "add", D(0)), ("l", "d:a.b", "add", D(0)), (None, "d:a.b", "add", D(0)), ("m", None, "add", D(0)),
                                     ("m", "d:a.b", "add", None), ("m", "d:a.b", "other", D(0)), ("n", "d:a.b", "add", D(1)), ("n", "d:a.b", "remove", D(1))],
                                    "list string, key string, action string, day date")
    got = sorted((str(r.id), r.active_lists, r.blocked) for r in filter_captures(captures, entries).collect())
    assert got == [("1", "", False), ("2", "", False), ("3", "", False), ("4", "l", True), ("5", "l", True), ("5", "l", True), ("None", "l", True)]
    assert [(r.list, r.valid_from, r.valid_to) for r in validity(entries).collect()] == [("l", D(0), None)]
    assert not filter_captures(captures, entries.limit(0)).where("blocked").count()
    assert filter_captures(captures.limit(0), entries).count() == 0


def test_long_hosts_are_held_against_every_listed_parent(spark):
    """A size of the host changes nothing: parents within and beyond the usual length of a host name."""
    parent = ".".join(["q" * 60] * 6)     # 365 characters
    hosts = {1: "x." * 130 + "bad.com", 2: "y" * 70_000 + ".bad.com", 3: "x." * 130 + "good.com", 4: "z." * 9 + parent, 5: parent, 6: "notbad.com"}
    captures = spark.createDataFrame([(k, f"http://{h}/", D(1)) for k, h in hosts.items()], "page_id long, url string, fetch_day date")
    entries = spark.createDataFrame([("l", "d:bad.com", "add", D(0)), ("m", "d:" + parent, "add", D(0))], "list string, key string, action string, day date")
    got = {r.id: r.active_lists for r in filter_captures(captures, entries).collect()}
    assert got == {1: "l", 2: "l", 3: "", 4: "m", 5: "m", 6: ""}
