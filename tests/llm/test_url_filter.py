"""Temporal list join against a plain as-of lookup."""

import datetime as dt
import random

from retailcast.llm import url_filter as U

DAY = dt.date(2023, 1, 1)


def split(url):
    if not url or "://" not in url:
        return None, None
    rest = url.split("://", 1)[1].split("#")[0]
    cut = min([rest.index(c) for c in "/?" if c in rest], default=len(rest))
    host = rest[:cut].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = rest[cut:]
    return (host, host + (path[:-1] if path.endswith("/") else path)) if host else (None, None)


def active(events, kind, entry, day):
    past = {}
    for k, e, action, d in events:
        if (k, e) == (kind, entry) and d is not None and action in ("add", "remove") and d <= day:
            past.setdefault(d, set()).add(action)
    return bool(past) and "add" in past[max(past)]


def naive(url, day, events):
    host, address = split(url)
    if day is None:
        return None, []
    out = []
    for kind, entry in {(k, e) for k, e, _, _ in events if k and e}:
        fits = host and (host == entry or host.endswith("." + entry)) if kind == "domain" else address == entry
        if fits and active(events, kind, entry, day):
            out.append(f"{kind}:{entry}")
    return bool(out), sorted(out)


def run(spark, captures, events):
    c = spark.createDataFrame(captures, "id long, url string, fetched date, entries string, host string, hot string")
    e = spark.createDataFrame(events, "kind string, entry string, action string, day date")
    return {r.id: (r.blocked, r.entries) for r in U.filter_captures(c, e).select("row.id", "blocked", "entries").collect()}


def test_against_lookup(spark):
    rng = random.Random(1)
    hosts = ["a.example", "x.a.example", "b.example", "deep.x.a.example", "hot.example"]
    events = [(*rng.choice([("domain", h) for h in hosts] + [("url", f"{h}/p{i}") for h in hosts for i in range(3)]),
               rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(rng.randrange(60))) for _ in range(120)]
    events += [("domain", None, "add", DAY), (None, "b.example", "add", DAY), ("domain", "b.example", None, DAY),
               ("domain", "b.example", "add", None), ("domain", "example", "add", DAY + dt.timedelta(50))]
    captures = []
    for i in range(600):
        h = rng.choice(hosts) if i % 3 else "hot.example"
        url = f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{h.upper()}{rng.choice(['', ':80', '.'])}" \
              f"/p{rng.randrange(4)}{rng.choice(['', '/', '#f', '?q=1'])}"
        captures.append((i, url, DAY + dt.timedelta(rng.randrange(70)), "x", "x", "x"))
    captures += [(900, None, DAY, None, None, None), (901, "no url", DAY, None, None, None),
                 (902, "http://a.example/p1", None, None, None, None), (903, "", DAY, None, None, None)]
    assert run(spark, captures, events) == {i: naive(u, d, events) for i, u, d, *_ in captures}


def test_intervals(spark):
    e = [("domain", "a", "add", DAY), ("domain", "a", "add", DAY + dt.timedelta(2)), ("domain", "a", "remove", DAY + dt.timedelta(5)),
         ("domain", "a", "remove", DAY + dt.timedelta(5)), ("domain", "b", "remove", DAY), ("domain", "b", "add", DAY)]
    got = sorted((r.entry, r.valid_from, r.valid_to) for r in U.validity_intervals(
        spark.createDataFrame(e, "kind string, entry string, action string, day date")).collect())
    day = [DAY + dt.timedelta(k) for k in range(6)]
    assert got == [("a", day[0], day[2]), ("a", day[2], day[5]), ("b", day[0], None)]


def test_empty_sides_and_repeats(spark):
    same = [(1, "http://a/x", DAY, "", "", ""), (1, "http://a/x", DAY, "", "", "")]
    assert run(spark, same, []) == {1: (False, [])}
    assert run(spark, [], [("domain", "a", "add", DAY)]) == {}
    assert run(spark, same, [("domain", "a", "add", DAY)]) == {1: (True, ["domain:a"])}


def test_a_long_list_meets_salted_probes(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_ENTRIES", 0)
    test_against_lookup(spark)


def test_captures_are_read_twice(spark, tmp_path):
    """Once for the pairs, once for the result."""
    spark.createDataFrame([(i, f"http://h{i % 5}.com/{i}", DAY) for i in range(50)],
                          "id long, url string, fetched date").write.parquet(str(tmp_path / "c"))
    events = spark.createDataFrame([("domain", "h1.com", "add", DAY)], "kind string, entry string, action string, day date")
    seen, cut = [], U.cut_lineage
    U.cut_lineage = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
    try:
        out = U.filter_captures(spark.read.parquet(str(tmp_path / "c")), events)
    finally:
        U.cut_lineage = cut
    plans = [*seen, out._jdf.queryExecution().executedPlan().toString()]
    assert sum(p.count("FileScan parquet") for p in plans) == 2 and out.where("blocked").count() == 10
