"""Operators on small fixtures: limits, order, skew, upserts, streams, plans."""

import datetime as dt
import os
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import admission, corpus, grid, ordering, publishing, reports, search, vectors, visits
from waymark.operators.filters import PlaceFilter
from waymark.plans import bindings
from waymark.sources import landed, snapshots, tables
from waymark.streaming import admission as stream_admission
from waymark.streaming import visits as stream_visits

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 3, 0, 0)
REQUESTS = "ip string, ts timestamp, req long"


# ---- admission ------------------------------------------------------------------------
def plain_limiter(events, per_window, per_day, window):
    """The rule read plainly: one pass per key in time order."""
    out, state = set(), {}
    for ip, ts, req in sorted(events, key=lambda e: (e[1], e[2])):
        recent, days = state.setdefault(ip, ([], {}))
        day = (ts + dt.timedelta(hours=9)).date()
        live = [t for t in recent if t >= ts - dt.timedelta(seconds=window)]
        if len(live) < per_window and days.get(day, 0) < per_day:
            recent.append(ts)
            days[day] = days.get(day, 0) + 1
            out.add(req)
    return out


def admitted(spark, events, per_window, per_day, window=60):
    df = spark.createDataFrame(events, REQUESTS)
    return {r["req"] for r in admission.admit(df, "ip", "ts", "req", per_window, per_day, window).collect()}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_minute_limit(spark):
    events = [("a", at(0), 0), ("a", at(0), 1), ("a", at(0), 2), ("a", at(0), 3), ("a", at(60), 4), ("a", at(61), 5), ("b", at(0), 6)]
    assert admitted(spark, events, 3, 100) == {0, 1, 2, 5, 6}


def test_day_limit(spark):
    events = [("a", at(120 * i), i) for i in range(6)] + [("a", at(25 * 3600), 6)]
    assert admitted(spark, events, 1000, 5) == {0, 1, 2, 3, 4, 6}


@pytest.mark.parametrize("per_window, per_day, window", [(2, 10, 60), (3, 40, 60), (1, 5, 600), (5, 8, 7)])
def test_admission_equals_plain_reading(spark, per_window, per_day, window):
    rng = random.Random(per_window * 100 + per_day)
    events, req = [], 0
    for ip, n, span in [("hot", 900, 2 * 86400), ("dense", 500, 7200), ("cold", 40, 3 * 86400)]:
        for _ in range(n):
            # Whole seconds make equal instants; the span crosses local midnight (15:00 UTC).
            events.append((ip, dt.datetime(2024, 1, 1, 14, 0) + dt.timedelta(seconds=rng.randrange(span)), req))
            req += 1
    assert admitted(spark, events, per_window, per_day, window) == plain_limiter(events, per_window, per_day, window)


def test_stream_admission_over_batches(spark):
    for k, v in stream_admission.STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(7)
    events = sorted((("ab"[i % 2], at(rng.randrange(4000)), i) for i in range(300)), key=lambda e: e[1])
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(3):
        spark.createDataFrame(events[i * 100:(i + 1) * 100], REQUESTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = stream_admission.admissions(stream, "ip", "ts", "req", 3, 100, expires=False)
    run = out.writeStream.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).format("parquet")
    query = run.start(f"{root}/out")
    assert query.awaitTermination(100)
    got = {r["req"] for r in spark.read.parquet(f"{root}/out").filter("admitted").collect()}
    assert got == plain_limiter(events, 3, 100, 60)


def test_stream_visits_over_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = [("s", at(3600 * i), i) for i in range(60)]
    for i in range(2):
        spark.createDataFrame(events[i::2], REQUESTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = stream_visits.keep_daily_counts(stream, f"{root}/days", f"{root}/cp", late="10 days", once=True)
    assert query.awaitTermination(100)
    batch = visits.daily_visits(spark.createDataFrame(events, REQUESTS))
    assert sorted(stream_visits.read_daily_counts(spark, f"{root}/days").collect()) == sorted(batch.collect())


# ---- order ---------------------------------------------------------------------------------
def test_keep_first_ignores_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("o"))
    results = [sorted(ordering.keep_first(df.repartition(n), ["k"], ["o"]).collect()) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 7


def test_keep_first_is_pruned_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    plan = ordering.keep_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_number_in_group_spreads_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), F.col("id").alias("p"))
    rows = ordering.number_in_group(df.repartition(5), ["k"], "p", "n", block=16).collect()
    for key in ("hot", "cold"):
        mine = sorted((r["p"], r["n"]) for r in rows if r["k"] == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_daily_slices_cover_each_id_once(spark):
    ids = spark.range(22).select(F.format_string("m%02d", "id").alias("id"))
    days = [{r["id"] for r in ordering.daily_slice(ids, "id", F.lit(f"2026-08-{24 + i}").cast("date")).collect()} for i in range(8)]
    assert all(3 <= len(x) <= 4 for x in days) and days[7] == days[0]
    assert len(set().union(*days[:7])) == 22 == sum(map(len, days[:7]))


def test_sessions_against_lag(spark):
    rng = random.Random(3)
    events = [("hot" if i % 3 else "cold", at(rng.randrange(200000)), i) for i in range(400)]
    got = {r["req"] for r in visits.first_of_session(spark.createDataFrame(events, REQUESTS), "ip", "ts", "req", 1800).collect()}
    want, last = set(), {}
    for ip, ts, req in sorted(events, key=lambda e: (e[1], e[2])):
        if ip not in last or (ts - last[ip]).total_seconds() > 1800:
            want.add(req)
        last[ip] = ts
    assert got == want


# ---- vectors -----------------------------------------------------------------------------------
def test_top_k_edges(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(20)] + [(99, [0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [4.0, 1.0])], "query_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.top_k(vecs, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 5), (1, 3, 10), (2, 1, 4), (2, 2, 9), (2, 3, 14)]
    assert vectors.top_k(vecs, q.limit(0), 3).count() == 0
    assert sorted(vectors.top_k(vecs, q, 3, max_inline=1, tile_bytes=8 * 64).collect()) == sorted(vectors.top_k(vecs, q, 3).collect())


def test_best_of_slices_is_the_best_of_all():
    rng = np.random.default_rng(5)
    q, v = rng.integers(-2, 3, (7, 4)).astype(float), rng.integers(-2, 3, (500, 4)).astype(float)
    v[::50] = np.nan
    ids = rng.permutation(500).astype(np.int64)
    for height in (1, 40, 1000):
        best = vectors._Best(np.arange(7, dtype=np.int64) * 10, q, 6)
        for start in range(0, 500, height):
            best.add(ids[start : start + height], v[start : start + height])
        got = best.batch().to_pydict()
        for i in range(7):
            distance = 1.0 - v @ q[i]
            want = sorted(range(500), key=lambda j: (np.inf if np.isnan(distance[j]) else distance[j], ids[j]))[:6]
            assert [x for x, of in zip(got["vec_id"], got["query_id"]) if of == 10 * i] == [ids[j] for j in want]


# ---- guard, publish, upsert ------------------------------------------------------------------------
def counted(spark, **n):
    return spark.createDataFrame([(k,) for k, c in n.items() for _ in range(c)], "region string")


def test_guard(spark):
    old = counted(spark, a=10, b=10, c=10)
    reasons = lambda new, low=1: publishing.guard_reasons(new, old, min_total=low).collect()
    assert reasons(counted(spark, a=8, b=12, c=10, d=500)) == []
    assert [r["key"] for r in reasons(counted(spark, a=7, b=10, c=10))] == ["a"]
    assert [r["key"] for r in reasons(counted(spark, a=10, b=10))] == ["c"]
    assert "31" in reasons(counted(spark, a=10, b=10, c=11), 50)[0]["reason"]


def test_stamps(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/stamps"
    assert tables.get_stamp(spark, root, "k") is None
    tables.put_stamp(spark, root, "k", "1")
    tables.put_stamp(spark, root, "k", "2")
    assert tables.get_stamp(spark, root, "k") == "2" and tables.get_stamp(spark, root, "other") is None


def folders(root):
    return {f for f in os.listdir(root) if f.startswith("v-")}


def test_publish_keeps_two_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for n in (10, 11, 12):
        assert tables.publish(counted(spark, a=n).withColumn("n", F.lit(1)), root, f"2026-01-{n}", min_total=1) == [] and tables.current(spark, root).count() == n
    assert len(folders(root)) == 2
    before = folders(root)
    assert tables.publish(counted(spark, a=2).withColumn("n", F.lit(1)), root, "2026-02-01", min_total=1) and folders(root) == before
    assert tables.current(spark, root).count() == 12 and tables.get_stamp(spark, f"{root}/pointer", "collected_on") in (None, "2026-01-12")


def test_chunks_without_vectors_are_refused(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    chunks = spark.createDataFrame([(str(i), "s", "x", "c", "u", None) for i in range(3)], "chunk_key string, source string, section string, content string, url string, collected_on string")
    vecs = spark.createDataFrame([(str(i), [1.0]) for i in range(3)], "chunk_key string, embedding array<float>")
    tables.replace_chunks(chunks, vecs, root)
    for c, v in ((chunks, vecs.limit(2)), (chunks.limit(2), vecs)):
        with pytest.raises(ValueError):
            tables.replace_chunks(c, v, root)
    assert tables.current(spark, root).count() == 3 and len(folders(root)) == 1


def test_missing_pages_are_faults(spark):
    page = '{"resCode": "%s", "data": {"totalCnt": 500, "totalPage": 3, "list": []}}'
    faults = lambda *pages: {(r["page_no"], r["reason"]) for r in landed.platform_page_faults(spark.createDataFrame(pages, "value string, page_no int")).collect()}
    good = page % fixed.OK_CODE
    assert faults((good, 1), (good, 2), (good, 3)) == set()
    assert faults((good, 1), (good, 3)) == {(2, "missing")}
    assert (1, "missing") in faults((good, 2))
    assert faults((good, 1), (page % "E1", 2), (good, 3)) == {(2, "resCode=E1")}


def test_district_with_only_bad_pages_is_listed(spark):
    pages = spark.createDataFrame([("no json", "A", "b", 1)], "value string, query_sido string, query_addr string, page_no int")
    none = spark.createDataFrame([], "district string")
    (r,) = reports.landed_vs_declared(none, landed.declared_counts(pages)).collect()
    assert (r["district"], r["declared"], r["landed"], r["differs"]) == ("A b", None, 0, True)


def test_long_documents_are_linear():
    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"# h{i}\nbody {i}" for i in range(n))
        start = time.process_time()
        found = corpus.sections_of(text)
        corpus.packed("\n\n".join(f"paragraph {i}" for i in range(n)))
        took.append(time.process_time() - start)
        assert len(found) == n
    assert took[1] < 12 * took[0] + 1


def test_reconcile_twice_changes_nothing_more(spark):
    store, feed = bindings.platforms(spark, SMALL), bindings.feed(spark, SMALL)
    day = F.lit("2024-02-01").cast("date")
    once = publishing.reconcile(store, feed, day, "s").cache()
    twice = publishing.reconcile(once.drop("action"), feed, day, "s")
    keep = [c for c in once.columns if c != "action"]
    assert sorted(map(str, once.select(keep).collect())) == sorted(map(str, twice.select(keep).collect()))
    counts = {r["action"]: r["count"] for r in twice.groupBy("action").count().collect()}
    assert "inserted" not in counts and "removed" not in counts
    curated = ["id", "note", "region_limited", "source_url"]
    kept = once.join(store.select("id"), "id", "left_semi").select(curated)
    assert sorted(map(str, kept.collect())) == sorted(map(str, store.select(curated).collect()))


# ---- places ---------------------------------------------------------------------------------------------
def test_cells_add_up_to_the_list_total(spark):
    rows = bindings.places(spark, SMALL).filter("lat IS NOT NULL")
    flt = PlaceFilter(region="ASIA", digital=True)
    assert grid.cluster_total(grid.clusters(rows, flt)).first()["total"] == search.total(rows, flt).first()["total"]


def test_filter_reaches_the_scan(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/p"
    bindings.places(spark, SMALL).write.partitionBy("region").parquet(path)
    found = search.page_of(spark.read.parquet(path), PlaceFilter(region="ASIA", cat="2-HIGH"), sort="name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "EqualTo(cat,2-HIGH)" in plan and "TakeOrderedAndProject" in plan


# ---- streams that go on ------------------------------------------------------------------------------
def landed_in_turn(spark, root, parts, schema):
    """One file per part, older files first; files are taken in the order of their times."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stamp = time.time() - 10_000 + 10 * i
        for name in os.listdir(f"{root}/in"):
            path = f"{root}/in/{name}"
            if os.path.getmtime(path) > time.time() - 1_000:
                os.utime(path, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_stream_admission_expires_and_marks_late_requests(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    day = 86_400
    parts = [
        [("a", at(0), 0), ("a", at(10), 1), ("a", at(20), 2), ("b", at(30), 3)],
        # Request 4 is older than the last one admitted for its key.
        [("a", at(5), 4), ("a", at(70), 5)],
        [("c", at(3 * day), 6)],
        # The state of a is gone by now; the watermark stands at request 6.
        [("a", at(3 * day + 1), 7), ("c", at(3 * day + 2), 8)],
    ]
    with stream_admission.state_store(spark):
        stream = landed_in_turn(spark, root, parts, REQUESTS)
        out = stream_admission.admissions(stream, "ip", "ts", "req", 2, 100)
        query = out.writeStream.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).format("parquet").start(f"{root}/out")
        assert query.awaitTermination(200)
    got = {r["req"]: (r["admitted"], r["late"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (False, False), 3: (True, False), 4: (False, True), 5: (True, False), 6: (True, False), 7: (True, False), 8: (True, False)}
    # Of the three keys' states the one of b was dropped by its timer, and a's was before it came again.
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert rows[-1] < max(rows)


def test_daily_counts_stay_in_few_folders(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = [("s", at(3600 * i), i) for i in range(104)]
    stream = landed_in_turn(spark, root, [events[2 * i : 2 * i + 2] for i in range(52)], REQUESTS)
    query = stream_visits.keep_daily_counts(stream, f"{root}/days", f"{root}/cp", late="10 days", once=True, compact_every=10)
    assert query.awaitTermination(300)
    assert len(os.listdir(f"{root}/days/batches")) <= 11 and len([f for f in os.listdir(f"{root}/days") if f.startswith("days-")]) == 1
    batch = visits.daily_visits(spark.createDataFrame(events, REQUESTS))
    assert sorted(stream_visits.read_daily_counts(spark, f"{root}/days").collect()) == sorted(batch.collect())


def test_session_starts_over_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    # A gap of exactly half an hour goes on; a microsecond more begins anew.
    times = [0, 600, 2400, 4200.000001, 9000]
    events = [("u", at(0) + dt.timedelta(seconds=t), i) for i, t in enumerate(times)] + [("v", at(100), 10)]
    stream = landed_in_turn(spark, root, [[events[0], events[2]], [events[1], events[5], events[3]], [events[4]], [("end", at(90_000), 99)]], REQUESTS)
    starts = stream_visits.session_starts(stream, "ip", "ts", "req")
    query = starts.writeStream.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).format("parquet").start(f"{root}/out")
    assert query.awaitTermination(200)
    got = sorted((r["ip"], r["req"], r["events"]) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [("u", 0, 3), ("u", 3, 1), ("u", 4, 1), ("v", 10, 1)]
    closed = spark.createDataFrame(events, REQUESTS)
    assert {(r["ip"], r["req"]) for r in visits.first_of_session(closed, "ip", "ts", "req").collect()} == {(a, b) for a, b, _ in got}


def test_snapshot_documents_do_not_need_a_file_each(spark):
    path = tempfile.mkdtemp(prefix="spark-snap-", dir="/tmp")
    places = bindings.places(spark, "/root/testdata/sf0.001")
    regions = {"AFRICA": "af", "AMERICA": "am", "ASIA": "as", "EUROPE": "eu", "MIDDLE EAST": "me"}
    snapshots.write_snapshot_documents(places, path, "2026-01-01", F.col("id").cast("bigint") % 200, regions)
    docs = snapshots.read_snapshots(spark, [path], regions, "name", by_line=True)
    n = docs.count()
    assert n > 400 and docs.select("file").distinct().count() < n / 4
    assert docs.select("file", "doc").distinct().count() == n
    back = snapshots.full_refresh(snapshots.snapshot_items(docs))
    assert sorted(map(str, back.collect())) == sorted(map(str, places.select(*back.columns).collect()))
