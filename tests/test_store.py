"""Stores, versions, patches, nested redaction and streams: crashes, damage and nulls that tables don't show."""

import datetime
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signet.functions import nested
from signet.functions import text as T
from signet.operators import merging, patches, views
from signet.sources import snapshots, store
from signet.streaming import stateful


def rows(spark, keys, payload="p"):
    made = [(f"{k}__1", k, f"{payload}{k}") for k in keys]
    return spark.createDataFrame(made, "key string, source string, payload string")


def kept(spark, path):
    return sorted(r.key for r in store.load(spark, path).collect())


def test_a_batch_is_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.put(rows(spark, ["a", "b"]), path, "one")
    files = len(os.listdir(tmp_path / "s/segments"))
    store.put(rows(spark, ["a", "b"]), path, "one")
    rows(spark, ["a", "b"]).write.format(store.NAME).mode("append").options(path=path, batch="one").save()
    assert len(os.listdir(tmp_path / "s/segments")) == files
    store.put(rows(spark, ["b", "c"], "new"), path, "two", segment=1)
    assert kept(spark, path) == ["a__1", "b__1", "b__1", "c__1"]
    asked = spark.createDataFrame([("b__1",), ("z__1",), (None,)], "key string")
    assert sorted(map(str, store.found(asked, path).collect())) == sorted(["Row(key='b__1', payload='newb')", "Row(key='z__1', payload=None)", "Row(key=None, payload=None)"])


def test_damage_is_a_miss(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for key in "abc":
        store.put(rows(spark, [key]), path, key)
    segment = {k: tmp_path / "s" / json.loads((tmp_path / f"s/lists/{k}.json").read_text())["segments"][0]["name"] for k in "abc"}
    segment["a"].write_bytes(segment["a"].read_bytes()[:-5])
    segment["b"].unlink()
    assert kept(spark, path) == ["c__1"]
    (tmp_path / "s/lists/c.json").write_text('{"segments": [')
    assert kept(spark, path) == []
    assert kept(spark, f"file://{tmp_path}/none") == []


def test_what_no_list_names_is_not_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    writer = store._Writer(path, "late", 1 << 20)
    batch = rows(spark, ["x"]).toArrow().to_batches()[0]
    wrote = writer.write(iter([batch]))
    assert kept(spark, path) == []  # written, not committed
    writer.commit([wrote, None])
    assert kept(spark, path) == ["x__1"]
    again = writer.write(iter([batch]))
    writer.abort([again])
    assert kept(spark, path) == ["x__1"] and len(os.listdir(tmp_path / "s/segments")) == 1


def test_names_nulls_and_drops(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(PySparkException):
        spark.createDataFrame([("other", "a", "p")], "key string, source string, payload string").write.format(store.NAME).mode("append").options(path=path, batch="bad").save()
    store.put(rows(spark, ["a1", "a2", "b"]).union(spark.createDataFrame([(None, "n", "p"), ("n", "n", None)], "key string, source string, payload string")), path, "one")
    assert kept(spark, path) == ["a1__1", "a2__1", "b__1"]
    store.drop(path, "a")
    assert kept(spark, path) == ["b__1"]
    store.put(rows(spark, ["a2"]), path, "two")
    assert kept(spark, path) == ["a2__1", "b__1"]
    store.drop(path)
    assert kept(spark, path) == []


def test_filters_leave_out_segments(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in range(6):
        store.put(rows(spark, [f"k{i}{j}" for j in range(3)]), path, f"b{i}")
    reader = store._Reader(path)
    assert len(list(reader.pushFilters([store.EqualTo(("key",), "k21__1")]))) == 1 and len(reader.partitions()) == 1
    reader = store._Reader(path)
    list(reader.pushFilters([store.StringStartsWith(("key",), "k3")]))
    assert len(reader.partitions()) == 1
    assert [r.key for r in store.load(spark, path).filter("key = 'k21__1'").collect()] == ["k21__1"]
    assert store.load(spark, path).filter("key in ('k00__1', 'k52__1', 'no')").count() == 2
    assert store.load(spark, path).filter("key like 'k3%'").count() == 3


def test_versions_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    root, frame = f"file://{tmp_path}/v", lambda x: spark.createDataFrame([(x,)], "x int")
    seen = lambda name="t", as_of=None: snapshots.read(spark, root, name, as_of).first().x
    with pytest.raises(LookupError):
        seen()
    assert snapshots.read(spark, root, "t", seed=frame(0)).first().x == 0
    assert snapshots.publish(spark, root, {"t": frame(1), "u": frame(10)}, after=0) == 1
    assert snapshots.publish(spark, root, {"t": frame(2)}, after=1) == 2
    assert (seen(), seen(as_of=1), seen("u")) == (2, 1, 10)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"t": frame(9)}, after=1)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # tables are written, the version isn't
        m.setattr(snapshots, "_appear", crash)
        with pytest.raises(KeyboardInterrupt):
            snapshots.publish(spark, root, {"t": frame(3), "u": frame(30)})
    assert (seen(), seen("u"), snapshots.versions(spark, root)) == (2, 10, [1, 2])
    assert not snapshots._appear(spark, root, 2, {}) and seen() == 2  # a number is never given twice
    assert snapshots.reset(spark, root, 1) == 3 and seen() == 1 and seen(as_of=2) == 2
    with pytest.raises(LookupError):
        snapshots.reset(spark, root, 7)
    with pytest.raises(LookupError):
        snapshots.read(spark, root, "none")


PAYLOAD = "struct<company:struct<name:string,normal:string,size:int>,reps:array<struct<id:string,mode:string>>,tags:array<string>>"


def test_patches_are_typed_and_known(spark):
    p = ({"name": "A", "normal": "a", "size": 3}, [{"id": "r1", "mode": "SOLE"}, {"id": None, "mode": "X"}], ["t"])
    docs = spark.createDataFrame([(1, p), (2, p), (3, None), (4, ({"name": None, "normal": None, "size": None}, None, None)), (None, p)], f"doc int, payload {PAYLOAD}")
    given = [(1, 2, "company.name", "İki"), (1, 1, "company.name", "Bir"), (1, 1, "reps[r1].mode", None), (1, 3, "company.size", "7"), (2, 1, "company.size", "many"), (2, 1, "reps[r2].mode", "x"), (2, 1, "tags", "x"), (2, 1, None, "x"), (3, 1, "company.name", "x"), (4, 1, "company.size", "5"), (4, 1, "reps[r1].mode", "x")]
    corrections = spark.createDataFrame(given, "doc int, seq int, path string, value string")
    derived = {"company.normal": ("name", T.tr_normalize)}
    got = {r.doc: r for r in patches.effective(docs, corrections, "doc", derived=derived, strict=False).collect()}
    assert got[1].payload.company.asDict() == {"name": "İki", "normal": "iki", "size": 7} and [r["mode"] for r in got[1].payload.reps] == [None, "X"] and got[1].refused == []
    assert got[2].refused == ["", "company.size", "reps[r2].mode", "tags"] and got[2].payload == got[None].payload
    assert got[3].payload is None and got[3].refused == ["company.name"]
    assert got[4].payload.company.size == 5 and got[4].refused == ["reps[r1].mode"]
    assert patches.effective(docs, corrections.filter("doc = 1"), "doc", derived=derived).count() == 5
    with pytest.raises(PySparkException, match="no such path"):
        patches.effective(docs, corrections, "doc").select("payload").collect()
    with pytest.raises(KeyError):
        patches.effective(docs, corrections, "doc", editable=["company.city"])
    schema = docs.schema["payload"].dataType
    at = lambda path: docs.filter("doc = 1").select(patches.value_at(F.col("payload"), schema, path)).first()[0]
    assert (at("company.size"), at("reps[r1].mode"), at("reps[r9].mode")) == (3, "SOLE", None)
    for path in ("company.city", "reps.mode", "company[x].name", "tags[0]"):
        with pytest.raises(KeyError):
            patches.value_at(F.col("payload"), schema, path)
    assert patches.effective(docs.limit(0), corrections, "doc").count() == 0


def test_redaction_walks_any_type(spark):
    kind = "struct<s:string,n:bigint,b:binary,m:map<string,array<struct<t:string>>>,x:array<array<string>>,e:struct<d:date>>"
    secret, day = "no 12345678901.", datetime.date(2026, 1, 1)
    df = spark.createDataFrame([(({"s": secret, "n": 12345678901, "b": b"12345678901", "m": {secret: [{"t": secret}, {"t": None}]}, "x": [[secret, None], None], "e": {"d": day}}),), (None,)], f"v {kind}")
    got = [r.v for r in nested.redact_columns(df, "v").collect()]
    clean = "no [REDACTED_TCKN]."
    assert got[1] is None
    assert got[0].asDict(True) == {"s": clean, "n": 12345678901, "b": "<11 bytes omitted>", "m": {secret: [{"t": clean}, {"t": None}]}, "x": [[clean, None], None], "e": {"d": day}}
    long = spark.createDataFrame([("x" * 600,)], "v string")
    assert nested.redact_columns(long, "v").first().v == "x" * 500 + "…[truncated]"


def plain_runs(events, deadline, watermark):
    found, by_key = [], {}
    for key, ms, seq, ends in events:
        by_key.setdefault(key, []).append((ms, seq, ends))
    for key, own in by_key.items():
        held = None
        for ms, _, ends in sorted(own):
            if held is not None and ms > held + deadline:
                found.append((key, held, held + deadline, stateful.FAILED))
                held = None
            if ends and held is not None:
                found.append((key, held, ms, stateful.DONE))
                held = None
            elif not ends and held is None:
                held = ms
        if held is not None and held + deadline < watermark:
            found.append((key, held, held + deadline, stateful.FAILED))
    return sorted(found)


@pytest.mark.parametrize("parts", [1, 4])
def test_runs_of_a_stream_equal_a_loop_and_a_batch(spark, tmp_path, parts):
    rng, minute = random.Random(parts), 60_000
    events = sorted((rng.randrange(5), minute * rng.randrange(2000) + rng.randrange(3), i, rng.random() < 0.3) for i in range(300))
    events.sort(key=lambda e: e[1])
    size = -(-len(events) // parts)
    for part in range(parts):
        some = [(k, datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC), i, e) for k, ms, i, e in events[part * size : (part + 1) * size]]
        spark.createDataFrame(some + [(None, None, 0, True)], "key long, at timestamp, seq long, ends boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{part:03d}")
    stream = spark.readStream.schema("key long, at timestamp, seq long, ends boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stateful.runs(stream, datetime.timedelta(minutes=90), "5 minutes")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    shown = lambda df: sorted((r.key, r.a, r.b, r.outcome) for r in df.select("key", F.unix_millis("started").alias("a"), F.unix_millis("ended").alias("b"), "outcome").collect())
    want = plain_runs(events, 90 * minute, events[-1][1] - 5 * minute)
    assert shown(stateful.runs_of(spark.read.parquet(f"{tmp_path}/in/*"), datetime.timedelta(minutes=90), datetime.timedelta(minutes=5))) == want
    assert shown(spark.read.schema(stateful.RUNS).parquet(f"{tmp_path}/out")) == want


def test_a_batch_and_its_audit_are_stored_once(spark, tmp_path, monkeypatch):
    """The driver dies after the tables are written, then after they are visible; the batch runs again each time."""
    for part in range(3):
        spark.createDataFrame([(10 * part + i, "ALLOWED") for i in range(4)], "id long, verdict string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    root = f"file://{tmp_path}/out"
    stream = spark.readStream.schema("id long, verdict string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    real, calls = snapshots._appear, []

    def fails(spark, root, version, tables):
        calls.append(version)
        if len(calls) == 2:
            raise OSError("lost before")
        done = real(spark, root, version, tables)
        if len(calls) == 4:
            raise OSError("lost after")
        return done

    monkeypatch.setattr(snapshots, "_appear", fails)
    for attempt in range(5):
        try:
            stateful.stored_once(stream, root, f"{tmp_path}/state", lambda b: stateful.with_audit(b, "id", "DECIDED"))
            break
        except PySparkException:
            continue
    assert attempt == 2 and snapshots.versions(spark, root) == [1, 2, 3]
    assert sorted(r.id for r in stateful.appended(spark, root, "decisions").collect()) == sorted(10 * p + i for p in range(3) for i in range(4))
    audit = stateful.appended(spark, root, "audit").collect()
    assert len(audit) == 12 and {(r.action, r.detail) for r in audit} == {("DECIDED", '{"verdict":"ALLOWED"}')}


def test_late_signatures_do_not_count(spark, tmp_path):
    at = lambda day: datetime.datetime(2026, 1, day, tzinfo=datetime.UTC)
    asked = [[(1, at(1)), (2, at(1)), (3, at(2))], [(4, at(28))], [(5, at(29))], [(6, at(29))]]
    signed = [[(1, at(3), "a"), (9, at(3), "x")], [(4, at(29), "b")], [(5, at(30), "c")], [(2, at(4), "late"), (6, at(30), "d")]]
    for i in range(4):
        spark.createDataFrame(asked[i], "id long, asked_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/a/{i}")
        spark.createDataFrame(signed[i], "id long, answered_at timestamp, by string").coalesce(1).write.parquet(f"{tmp_path}/b/{i}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    out = stateful.answered(read("a", "id long, asked_at timestamp"), read("b", "id long, answered_at timestamp, by string"), "5 DAYS", "1 day")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = sorted((r.id, r.by) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a"), (2, None), (3, None), (4, "b"), (5, "c"), (6, "d")]
    rows = spark.createDataFrame([(1, 10, at(1), None), (1, 11, at(2), None), (1, 12, at(3), at(4)), (2, 13, at(1), at(2))], "company long, id long, asked_at timestamp, answered_at timestamp")
    assert [(r.company, r.id) for r in stateful.first_pending(rows).collect()] == [(1, 11)]


def test_views_of_keys_without_parts_and_parts_without_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, name string")
    part = spark.createDataFrame([(1, 5, "x"), (1, 7, None), (3, None, "n"), (9, 1, "z"), (None, 1, "z")], "k int, o int, v string")
    got = {r.k: r for r in views.assembled(base, "k", {"last": views.Part(part, "o"), "all": views.Part(part, "o", many=True)}).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].last.v is None and got[1].last.o == 7 and [r.v for r in got[1].all] == ["x", None] and got[1].all_count == 2
    assert got[2].last is None and got[2].all == [] and got[2].last_count == 0 and got[2].name is None
    assert got[3].last.v == "n"
    plan = views.assembled(base, "k", {"last": views.Part(part, "o")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_companies_without_readings_or_evidence(spark):
    e = "array<struct<page:int,quote:string>>"
    readings = spark.createDataFrame([
        (1, 2, ("Two", "2"), [(1, "a"), (2, "b")], ("N2", "01.02.2026"), [(5, "n")]), (1, 1, (None, "1"), [(2, "b"), (2, None)], None, None), (1, 3, ("Three", "3"), None, ("N3", "x"), [(6, "m")]), (2, 1, ("Solo", None), None, ("N", None), None),
    ], f"doc int, ordinal int, company struct<legal_name:string,vkn:string>, company_evidence {e}, notary struct<name:string,date:string>, notary_evidence {e}")
    pages = spark.createDataFrame([(1, "ignored"), (3, "Line"), (4, None)], "doc int, company_line string")
    got = {r.doc: r for r in merging.companies(readings, pages).collect()}
    assert tuple(got[1].company) == (None, "1") and [tuple(x) for x in got[1].company_evidence] == [(2, "b"), (2, None), (1, "a")]
    assert got[1].notary.name == "N2" and got[1].notary.date == datetime.date(2026, 2, 1) and [tuple(x) for x in got[1].notary_evidence] == [(5, "n")]
    assert got[2].notary.date is None and got[2].company_evidence == [] == got[2].notary_evidence
    assert got[3].company.legal_name == "Line" and got[3].notary is None and got[4].company.legal_name == "UNREADABLE"
    assert merging.companies(readings.limit(0), pages.limit(0)).count() == 0
