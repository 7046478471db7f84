"""The bucketed store: touched buckets, replays, steps that die, old versions; ingest over it."""

import pytest
from pyspark.sql import functions as F

from offermill.sources.store import Store
from offermill.streaming import stored
from test_jobs import DEAL, LISTING, empty

NOW = "2024-06-05 12:00:00"


def written(store, name, version):
    return {n for n in store._children(f"{store.root}/{name}/version={version}") if n.startswith("_bucket=")}


def listing(spark, *rows):
    full = [(i, key, title, url, None, None, None, 10.0, price, None, None) for i, (key, title, url, price) in enumerate(rows)]
    return spark.createDataFrame(full, LISTING)


def deals(store, version=None):
    return {r.source_deal_id: (r.title, r.deal_price, r.is_active) for r in store.read("deals", version).collect()}


def test_buckets_versions_and_logs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(500).select("id", F.lit(0).alias("v"))
    store.create({"t": (rows, ["id"])}, buckets=32)
    first = spark.range(3).select("id", F.lit(1).alias("v"))
    touched = store.buckets_of("t", first)
    inside = store.read("t", 0, touched).join(first.select("id"), "id", "left_anti").unionByName(first)
    commit = store.write(1, {"t": (inside, touched)}, {"log": first}, {"log": {"most": F.max("id")}})
    assert commit["counts"] == {"t": inside.count(), "log": {"rows": 3, "most": 2}}
    assert len(touched) <= 3 and written(store, "t", 1) == {f"_bucket={b}" for b in touched}
    assert store.read("t").filter("v = 1").count() == 3 and store.read("t").count() == 500
    assert store.read("t", 0).filter("v = 0").count() == 500
    assert [tuple(r) for r in store.log("log").orderBy("id").collect()] == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]

    emptied = store.buckets_of("t", spark.createDataFrame([(7,)], "id long"))
    store.write(2, {"t": (empty(spark, "id long, v int"), emptied)}, {})
    gone = 500 - store.read("t").count()
    assert gone == store.read("t", 1, emptied).count() > 0 and store.read("t", 2, emptied).count() == 0

    before = {v: store.read("t", v).count() for v in (1, 2)}
    store.forget(1)
    assert store.versions() == [1, 2] and {v: store.read("t", v).count() for v in (1, 2)} == before
    assert len(written(store, "t", 0)) == 32 - len(touched)


def test_a_step_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.create({"t": (spark.range(10).select("id", F.lit(0).alias("v")), ["id"])}, buckets=4)
    change = spark.range(20).select("id", F.lit(1).alias("v"))
    broken = change.select("id", F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.write(1, {"t": (change, set(range(4)))}, {"a": change, "b": broken})
    assert store.versions() == [0] and store.read("t").filter("v = 0").count() == 10
    store.write(1, {"t": (change, set(range(4)))}, {"a": change, "b": change})
    store.write(1, {"t": (change.limit(1), set(range(4)))}, {"a": change.limit(1)})  # a replay after the commit
    assert store.read("t").count() == 20 and store.log("a").count() == 20 and store.log("b").count() == 20


def test_ingest_dies_between_outputs_and_is_replayed(spark, tmp_path, monkeypatch):
    root, folder = str(tmp_path / "store"), str(tmp_path / "in")
    store = Store(spark, root)
    store.create({"deals": (empty(spark, DEAL), ["source_id", "source_deal_id"])}, buckets=8)
    clock = [NOW, "2024-06-06 12:00:00"]

    def run():
        stored.stream_ingest(spark.readStream.schema(LISTING).parquet(folder), root, 1, lambda b: clock[b]).awaitTermination()

    listing(spark, ("a", "Happy hour", "http://x/a", 5.0), ("b", "Lunch", "http://x/b", 6.0)).coalesce(1).write.parquet(folder)
    whole = Store._commit
    monkeypatch.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died before the commit")))
    with pytest.raises(Exception, match="died before the commit"):
        run()
    assert store.versions() == [0] and store.read("deals").count() == 0
    monkeypatch.setattr(Store, "_commit", whole)
    run()
    assert store.versions() == [0, 1] and store.log("actions").count() == 2 == store.log("deals_raw").count()
    listing(spark, ("a", "Happy hour", "http://x/a", 4.0)).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert deals(store) == {"a": ("Happy hour", 4.0, True), "b": ("Lunch", 6.0, True)}
    assert deals(store, 1)["a"] == ("Happy hour", 5.0, True)
    assert len(written(store, "deals", 2)) == 1
    assert store.commit_of(2)["counts"]["actions"] == {"rows": 1, "inserted": 0, "updated": 1}


def test_url_duplicates_in_other_buckets_and_sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    old = listing(spark, *[(f"o{i}", "Old", f"http://x/{i}", 5.0) for i in range(30)])
    rows = old.select(
        F.col("seq").alias("id"), F.lit(2).cast("long").alias("source_id"), "source_deal_id", "title", "url", F.lit(0.1).alias("quality_score"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit("2024-01-01").cast("timestamp").alias("last_seen_at"), F.lit(True).alias("is_active"),
    )
    schema = empty(spark, DEAL).schema
    full = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    store.create({"deals": (full, ["source_id", "source_deal_id"])}, buckets=16)
    stored.ingest_step(store, listing(spark, ("n", "New", "http://x/3?utm=1", 4.0)), 1, 1, NOW)
    active = {k for k, v in deals(store).items() if v[2]}
    assert active == {f"o{i}" for i in range(30)} - {"o3"} | {"n"}
    assert len(written(store, "deals", 1)) <= 2
    stored.ingest_step(store, listing(spark, ("m", "New", "http://x/99", 4.0)), 2, 1, NOW, swept=True)
    assert {k for k, v in deals(store).items() if v[2]} == {"n", "m"}  # the old ones were last seen too long ago
    assert store.read("deals").filter("rank_score IS NULL AND is_active").count() == 0


def test_what_a_step_sets_aside(spark, tmp_path):
    """Rows set aside are read back as they were, a replay overwrites them, and nothing of them stays (F6, F7)."""
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, None, 2.5), (2, "x", None)], "id long, name string, price double")
    for wanted in (rows, rows.filter("id = 2")):
        kept = store.set_aside("deals", 3, wanted)
        assert kept.schema == rows.schema and sorted(kept.collect()) == sorted(wanted.collect())
    assert (tmp_path / "_aside" / "version=3" / "deals").exists()
    store.clear(3)
    assert not (tmp_path / "_aside" / "version=3").exists()
    assert store.versions() == []
