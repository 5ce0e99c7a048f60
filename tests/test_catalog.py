"""Catalog changes, path resolution, and the change stream."""

import itertools
import os
import shutil

from pyspark.sql import functions as F

from loupe.operators import catalog, skew, tree
from loupe.streaming import changes
from loupe.streaming.store import next_offsets

ENTRY = "drive string, file_ref long, path string, name string, size long, modified double, is_dir boolean, seq long"


def entry(ref, path, seq, drive="C"):
    return (drive, ref, path, path.rsplit("/", 1)[-1] if path else None, 1, 1.0, False, seq)


def paths_of(rows):
    return sorted((r["drive"], r["file_ref"], r["path"]) for r in rows.collect())


def test_populate(spark):
    rows = [entry(1, "C:/a", 1), entry(1, "C:/b", 2), entry(2, "C:/B", 3), entry(3, "C:/$x", 4), entry(4, None, 5), entry(1, "D:/a", 1, "D")]
    made = catalog.populate(spark.createDataFrame(rows, ENTRY))
    assert paths_of(made) == [("C", 2, "C:/B"), ("D", 1, "D:/a")] and made.where("name_lower = 'b'").count() == 1


def test_upsert_evicts_and_moves(spark):
    base = catalog.populate(spark.createDataFrame([entry(1, "C:/a", 1), entry(2, "C:/b", 2)], ENTRY))
    moved = catalog.upsert(base, spark.createDataFrame([entry(1, "C:/B", 5), entry(9, "C:/$sys", 6)], ENTRY))
    assert paths_of(moved) == [("C", 1, "C:/B")]
    assert paths_of(catalog.remove_refs(moved, moved)) == []


def test_snapshot(spark, tmp_path):
    base = catalog.populate(spark.createDataFrame([entry(1, "C:/a", 1), entry(2, "x", 2, "?")], ENTRY))
    catalog.save_snapshot(base, str(tmp_path / "s"))
    assert paths_of(catalog.load_snapshot(spark, str(tmp_path / "s"))) == paths_of(base)


FILES = "id long, path string, name string, extension string, size long, modified double, has_content boolean, file_ref long"


def test_files_and_contents(spark):
    files = spark.createDataFrame([(1, "C:/a.txt", "a.txt", ".txt", 1, 10.0, True, 5), (2, "C:/b.txt", "b.txt", ".txt", 1, 10.0, True, 6), (3, "C:/q/c.txt", "c.txt", ".txt", 1, 10.0, False, 7)], FILES)
    new = spark.createDataFrame([("C:/a.txt", 2, 10.0005, 50), ("C:/b.txt", 2, 11.0, None), ("C:/d.MD", 4, 1.0, 9)], "path string, size long, modified double, file_ref long")
    after = {r["path"]: r for r in catalog.upsert_files(files, new).collect()}
    assert (after["C:/a.txt"]["size"], after["C:/a.txt"]["file_ref"]) == (1, 50) and (after["C:/b.txt"]["size"], after["C:/b.txt"]["file_ref"]) == (2, 6)
    assert (after["C:/d.MD"]["name"], after["C:/d.MD"]["extension"], after["C:/d.MD"]["has_content"]) == ("d.MD", ".md", False) and len(after) == 4
    assert {r["path"]: r["action"] for r in catalog.diff_files(files, new).collect()} == {"C:/a.txt": "skip", "C:/b.txt": "update", "C:/d.MD": "insert"}
    assert sorted(r["path"] for r in catalog.needs_reindex(files, new).collect()) == ["C:/b.txt", "C:/d.MD"]
    contents = spark.createDataFrame([(1, "old"), (2, "old2")], "file_id long, content string")
    f, c = catalog.upsert_contents(files, contents, spark.createDataFrame([(1, "new"), (2, None)], contents.schema))
    assert sorted(map(tuple, c.collect())) == [(1, "new")] and {r["id"]: r["has_content"] for r in f.collect()} == {1: True, 2: False, 3: False}
    assert [r[0] for r in catalog.content_by_path(files, contents, "C:/a.txt").collect()] == ["old"]
    folders = spark.createDataFrame([("C:/q", 1.0)], "path string, indexed_at double")
    folders = catalog.add_folder(catalog.add_folder(folders, "C:/q"), "C:/Q/sub")
    assert folders.count() == 2 and [tuple(r) for r in catalog.nested_folders(folders).select("outer", "inner").collect()] == [("C:/q", "C:/Q/sub")]
    kept, texts, left = catalog.remove_folder(files, contents, folders, "c:/Q")
    assert kept.count() == 2 and texts.count() == 2 and catalog.remove_folder(files, contents, folders, "C:/q")[2].count() == 1 and left.count() == 2
    assert catalog.stamp_folder(folders, "C:/Q/sub", 5.0).where("indexed_at = 5.0").count() == 1


def test_resolve_paths(spark):
    rows = [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 4, "root"), (5, 4, "under"), (6, 7, "x"), (7, 6, "y"), (8, 99, "orphan"), (9, 2, "skip"), (10, 9, "below"), (11, 10, "deep")]
    chain = [(1000 + k, 999 + k if k else 0, f"d{k}") for k in range(300)]
    entries = spark.createDataFrame([("C", *r) for r in rows + chain], "drive string, file_ref long, parent_ref long, name string")
    got = {r["file_ref"]: r["path"] for r in tree.resolve_paths(entries, "C:/").collect()}
    cycle = {6: "C:/x", 7: "C:/x/y"}  # cut at its smallest reference
    assert {k: v for k, v in got.items() if k < 100} == cycle | {1: "C:/a", 2: "C:/a/b", 3: "C:/a/b/c", 5: "C:/under", 8: "C:/orphan", 9: "C:/a/b/skip", 10: "C:/a/b/skip/below", 11: "C:/a/b/skip/below/deep"}
    assert all(got[1000 + n] == "C:/" + "/".join(f"d{k}" for k in range(n + 1)) for n in (0, 255, 256, 299))
    pruned = {r["file_ref"] for r in tree.resolve_paths(entries.where("file_ref < 100"), "C:/", exclude=lambda p: F.endswith(p, F.lit("skip"))).collect()}
    assert pruned == {1, 2, 3, 5, 6, 7, 8}
    assert [tuple(r) for r in tree.refs_to_paths(spark.createDataFrame([("C", 5), ("C", 77)], "drive string, file_ref long"), tree.resolve_paths(entries, "C:/")).select("file_ref", "path").collect()] == [(5, "C:/under")]


PRESENT = "drive string, file_ref long, path string, name string, size long, modified double, is_dir boolean"


def test_apply_changes(spark):
    base = catalog.populate(spark.createDataFrame([entry(1, "C:/a", 1), entry(2, "C:/b", 2), entry(3, "C:/c", 3), entry(4, "C:/d", 4)], ENTRY))
    log = [(1, 10, 0x100), (1, 11, 0x200), (2, 12, 0x200), (2, 13, 0x100), (3, 14, 0x2000), (4, 15, 0x2000), (5, 16, 0x100), (6, 17, 0x8), (7, 18, 0x1)]
    records = spark.createDataFrame([("C", 1, u, r, w) for r, u, w in log], changes.RECORD)
    present = spark.createDataFrame([("C", 2, "C:/b2", "b2", 5, 2.0, False), ("C", 3, "C:/D", "D", None, None, None), ("C", 4, "C:/.hid/d", "d", 1, 1.0, False), ("C", 5, "C:/e", "e", 1, 1.0, True)], PRESENT)
    out = changes.apply_changes(base, records, present, lambda p: F.contains(p, F.lit("/.")))
    assert paths_of(out) == [("C", 2, "C:/b2"), ("C", 3, "C:/D"), ("C", 5, "C:/e")]
    again = changes.apply_changes(out, records, present, lambda p: F.contains(p, F.lit("/.")))
    assert paths_of(again) == paths_of(out)
    assert [tuple(r) for r in changes.change_counts(records).collect()] == [("C", 6, 1)]


def test_offsets(spark):
    table = lambda rows, schema="drive string, journal_id long, next_usn long": spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in changes.catchup_ranges(table([("C", 1, 5), ("D", 1, 9), ("E", 2, 1)]), table([("C", 1, 8), ("D", 1, 9), ("E", 3, 4)])).collect()] == [("C", 5, 8)]
    journals = table([("C", 1, 3), ("D", 1, 10), ("E", 9, 0)], "drive string, journal_id long, lowest_usn long")
    assert sorted(r[0] for r in changes.expired(table([("C", 1, 5), ("D", 1, 9), ("E", 2, 1)]), journals).collect()) == ["D", "E"]


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    log = [("C", 1, u, u * 7 % 5, [0x100, 0x200, 0x1][u % 3]) for u in range(30)]
    present = spark.createDataFrame([("C", r, f"C:/f{r}", f"f{r}", r, 1.0, False) for r in range(5)], PRESENT)
    empty = catalog.populate(spark.createDataFrame([], ENTRY))
    once = changes.apply_changes(empty, spark.createDataFrame(log, changes.RECORD), present)
    results = []
    for n, _ in itertools.product((3,), (0, 1)):
        root = tmp_path / f"s{len(results)}"
        store = changes.CatalogStore(spark, str(root / "catalog"))
        store.start(empty)
        for k in range(n):
            spark.createDataFrame(log[k * 10 : k * 10 + 10], changes.RECORD).coalesce(1).write.mode("append").parquet(str(root / "log"))
            stream = spark.readStream.schema(changes.RECORD).parquet(str(root / "log"))
            query = changes.follow(stream, store, lambda: present, str(root / "state"), available_now=True)
            query.awaitTermination()
        results.append(paths_of(store.read(n - 1)))
    assert results == [paths_of(once)] * 2


def test_pending(spark, tmp_path):
    folders = spark.createDataFrame([("C:/a", None), ("C:/a/b", 1.0), ("C:/z", 2.0)], "path string, indexed_at double")
    moved = spark.createDataFrame([("C:/A/b/x",), ("C:/a/y",), ("C:/a/y",), ("D:/q",)], "path string")
    pending = changes.pending_by_folder(moved, folders)
    assert {r["folder"]: r["n_pending"] for r in pending.collect()} == {"C:/a": 2, "C:/a/b": 1}
    status = {r["path"]: r["status"] for r in catalog.folder_status(folders, pending.withColumnRenamed("folder", "path")).collect()}
    assert status == {"C:/a": "pending", "C:/a/b": "changed", "C:/z": "done"}
    moved.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    query = changes.running_pending(stream, folders).writeStream.outputMode("complete").format("memory").queryName("pending_now").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["folder"]: r["n_pending"] for r in spark.table("pending_now").collect()} == {"C:/a": 2, "C:/a/b": 1}


def buckets_of(store, table, version):
    root = f"{store.path}/{table}/version={version}"
    return {int(d.split("=")[1]) for d in os.listdir(root) if d.startswith("bucket=")} if os.path.isdir(root) else set()


def small_store(spark, root, n=400, buckets=64):
    store = changes.CatalogStore(spark, str(root), buckets)
    base = catalog.populate(spark.createDataFrame([entry(r, f"C:/f{r}", r) for r in range(n)], ENTRY))
    store.start(base, spark.createDataFrame([("C", 1, 0)], "drive string, journal_id long, next_usn long"))
    return store, base


def batch_of(spark, rows):
    """(ref, usn, reason, path or None) -> records and what their files are now."""
    records = spark.createDataFrame([("C", 1, u, r, w) for r, u, w, _ in rows], changes.RECORD)
    present = spark.createDataFrame([("C", r, p, p.rsplit("/", 1)[-1], 7, 2.0, False) for r, _, _, p in rows if p], PRESENT)
    return records, present


def put(store, version, records, present):
    gone, updates = changes.batch_changes(records, present)
    return store.apply(version, gone, updates, next_offsets(records))


def test_a_batch_rewrites_its_buckets_only_with_the_offsets(spark, tmp_path):
    store, base = small_store(spark, tmp_path / "s")
    rows = [(1, 10, 0x200, None), (2, 11, 0x2000, "C:/moved"), (3, 12, 0x2000, "C:/F4"), (500, 13, 0x100, "C:/new"), (6, 14, 0x1, "C:/f6"), (7, 15, 0x200, None), (8, 16, 0x2000, "C:/moved"), (9, 17, 0x100, "C:/$x"), (10, 18, 0x2000, "C:/f11"), (11, 19, 0x2000, "C:/f10")]
    records, present = batch_of(spark, rows)
    now = put(store, 0, records, present)
    want = changes.apply_changes(base, records, present)
    assert paths_of(store.read()) == paths_of(want) and paths_of(store.read(-1)) == paths_of(base)
    assert 0 < len(buckets_of(store, "rows", 0)) <= 10 and len(buckets_of(store, "owners", 0)) <= 10 and len(buckets_of(store, "rows", -1)) > 50
    assert now.offsets == [("C", 1, 20)] and [tuple(r) for r in store.offsets().collect()] == [("C", 1, 20)]
    put(store, 0, records, present)  # replayed
    assert paths_of(store.read()) == paths_of(want) and store.offsets().count() == 1
    # later batches: the one that was evicted comes back elsewhere, the evictor leaves
    more, present = batch_of(spark, [(4, 30, 0x2000, "C:/four"), (3, 31, 0x200, None), (12, 32, 0x2000, "C:/F4")])
    put(store, 1, more, present)
    put(store, 2, *batch_of(spark, [(12, 40, 0x2000, "C:/else")]))
    want = changes.apply_changes(changes.apply_changes(want, more, present), *batch_of(spark, [(12, 40, 0x2000, "C:/else")]))
    assert paths_of(store.read()) == paths_of(want)
    assert len(store.manifest().rows) == 64 or set(store.manifest().rows) <= set(range(64))


def test_a_crash_before_the_manifest_leaves_catalog_and_offsets(spark, tmp_path):
    store, base = small_store(spark, tmp_path / "s", 60, 8)
    put(store, 0, *batch_of(spark, [(1, 10, 0x2000, "C:/a")]))
    before, offsets = paths_of(store.read()), store.manifest().offsets
    put(store, 1, *batch_of(spark, [(1, 20, 0x200, None), (2, 21, 0x2000, "C:/b")]))
    shutil.rmtree(tmp_path / "s" / "manifest" / "at=1")
    assert paths_of(store.read()) == before and store.manifest().offsets == offsets == [("C", 1, 11)]
    put(store, 1, *batch_of(spark, [(1, 20, 0x200, None), (2, 21, 0x2000, "C:/b")]))
    assert ("C", 2, "C:/b") in paths_of(store.read()) and store.manifest().offsets == [("C", 1, 22)]


def test_buckets_without_rows(spark, tmp_path):
    store, _ = small_store(spark, tmp_path / "s", 3, 4)
    put(store, 0, *batch_of(spark, [(r, 10 + r, 0x200, None) for r in range(3)]))
    assert store.read().count() == 0 and store.manifest().rows == {}
    put(store, 1, *batch_of(spark, [(1, 20, 0x100, "C:/again")]))
    assert paths_of(store.read()) == [("C", 1, "C:/again")]


def test_catch_up_merges_a_listing_with_the_changes_since(spark):
    rows = [entry(r, f"{d}:/old{r}", 1, d) for d in "CDEF" for r in (1, 2, 3)]
    base = catalog.populate(spark.createDataFrame(rows, ENTRY))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    offsets = table([("C", 1, 100), ("D", 1, 100), ("E", 1, 900), ("F", 1, 5)], "drive string, journal_id long, next_usn long")
    journals = table([("C", 1, 50, 900), ("D", 2, 0, 900), ("E", 1, 50, 900), ("F", 1, 50, 900)], "drive string, journal_id long, lowest_usn long, next_usn long")
    listing = table([("D", 1, "D:/l1", "l1", "", 1, 1.0, False, 500), ("D", 5, "D:/l5", "l5", "", 1, 1.0, False, 500)], "drive string, file_ref long, path string, name string, extension string, size long, modified double, is_dir boolean, since_usn long")
    log = [("C", 1, 99, 1, 0x200), ("C", 1, 150, 2, 0x200), ("C", 9, 160, 3, 0x200), ("D", 2, 400, 1, 0x200), ("D", 2, 500, 5, 0x200), ("D", 2, 600, 6, 0x100), ("E", 1, 950, 1, 0x200), ("F", 1, 60, 1, 0x200)]
    present = table([("D", 6, "D:/n6", "n6", 1, 1.0, False)], PRESENT)
    found, plan = changes.catch_up(base, offsets, journals, table(log, changes.RECORD), listing, present)
    assert {r["drive"]: (r["action"], r["first_usn"]) for r in plan.collect()} == {"C": ("caught up", 100), "D": ("rescanned", 500), "E": ("current", None), "F": ("left", None)}
    assert paths_of(found) == [("C", 1, "C:/old1"), ("C", 3, "C:/old3"), ("D", 1, "D:/l1"), ("D", 6, "D:/n6"), *[(d, r, f"{d}:/old{r}") for d in "EF" for r in (1, 2, 3)]]


def test_a_drained_folder_has_nothing_pending(spark, tmp_path):
    folders = spark.createDataFrame([("C:/a",), ("C:/a/b",), ("C:/z",)], "path string")
    schema = "usn long, path string, drained string"
    batches = [[(1, "C:/a/b/x", None), (2, "C:/a/y", None), (3, "C:/a/y", None), (4, "D:/q", None)], [(5, None, "C:/a"), (6, "C:/a/k", None), (7, "C:/a/y", None)], [(8, None, "C:/a/b"), (9, None, "C:/a")]]
    last, sizes = {}, []
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

            def take(batch, _):
                last.update({(r["folder"], r["part"]): r["n_pending"] for r in batch.collect()})

            query = changes.drained_pending(stream, folders, parts=3).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append({f: sum(n for (g, _), n in last.items() if g == f) for f in ("C:/a", "C:/a/b")})
            held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "paths").load().count()
            assert held == sum(sizes[-1].values())  # the state holds what is pending and nothing else
    finally:
        spark.conf.unset(conf)
    assert sizes == [{"C:/a": 2, "C:/a/b": 1}, {"C:/a": 2, "C:/a/b": 1}, {"C:/a": 0, "C:/a/b": 0}]


def test_paths_below_one_huge_folder(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    rows = [(1, 0, "root"), (2, 1, "big")] + [(10 + k, 2, f"f{k}") for k in range(1500)] + [(5000 + k, 10 + k % 40, f"g{k}") for k in range(120)] + [(9000, 9001, "x"), (9001, 9000, "y")]
    entries = spark.createDataFrame([("C", *r) for r in rows], "drive string, file_ref long, parent_ref long, name string")
    found = tree.resolve_paths(entries, "C:/")
    got = {r["file_ref"]: r["path"] for r in found.collect()}
    assert len(got) == len(rows) and got[10] == "C:/root/big/f0" and got[1509] == "C:/root/big/f1499" and got[5041] == "C:/root/big/f1/g41" and got[9001] == "C:/x/y"
    joined = skew.join_facts(entries.where("file_ref < 5000"), ["parent_ref"], entries.select(F.col("file_ref").alias("p")), ["p"])
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1502


def test_small_rules(spark):
    folders = spark.createDataFrame([("C:/b", None), ("C:/B", 1.0), ("C:/a", 2.0)], "path string, indexed_at double")
    assert [r["path"] for r in catalog.folder_list(folders).collect()] == ["C:/B", "C:/a", "C:/b"]
    status = catalog.folder_status(folders, spark.createDataFrame([("C:/a", 3)], "path string, n_pending long"), indexing=["C:/b"])
    assert {r["path"]: r["status"] for r in status.collect()} == {"C:/b": "indexing", "C:/B": "done", "C:/a": "changed"}
    some = spark.range(5).selectExpr("concat('p', id) AS path")
    assert catalog.needs_scan(some) and not catalog.needs_scan(some, 5) and catalog.needs_scan(some.limit(0), 1)
    records = spark.createDataFrame([("C", 1, 5, 1, 1), ("C", 1, 9, 1, 1), ("C", 2, 3, 1, 1), ("D", 1, 4, 1, 1)], changes.RECORD)
    assert sorted(tuple(r) for r in changes.journal_metadata(records).select("drive", "journal_id", "lowest_usn", "next_usn").collect()) == [("C", 2, 3, 4), ("D", 1, 4, 5)]


def test_paths_are_dealt_by_their_bytes(spark, monkeypatch):
    """Chains deeper than usual, some below another's end, and one below a cycle; no partition holds a large part of the paths."""
    monkeypatch.setattr(skew, "TASK_BYTES", 64 << 10, raising=False)
    monkeypatch.setattr(tree, "_USUAL_DEPTH", 16)
    parents = {i: i - 1 if i % 100 else -1 for i in range(1, 401)} | {5000: 5002, 5001: 5000, 5002: 5001} | {i: i - 1 for i in range(5003, 5063)}
    parents |= {6000 + i: 20 for i in range(50)}
    name = lambda i: f"n{i}" + "x" * 40
    entries = spark.createDataFrame([("C", i, p, name(i)) for i, p in parents.items()], "drive string, file_ref long, parent_ref long, name string")
    want: dict[int, str] = {}
    for i in sorted(parents):
        want[i] = want.get(-1 if i == 5000 else 5000 if i == 5001 else parents[i], "C:") + f"/{name(i)}"
    want[5002] = f"{want[5001]}/{name(5002)}"
    for i in range(5003, 5063):
        want[i] = f"{want[i - 1]}/{name(i)}"
    rows = tree.resolve_paths(entries, "C:/").select("file_ref", "path", F.spark_partition_id().alias("part")).collect()
    assert {r["file_ref"]: r["path"] for r in rows} == want
    held = {p: sum(len(r["path"]) for r in rows if r["part"] == p) for p in {r["part"] for r in rows}}
    assert max(held.values()) <= 4 * (64 << 10) < sum(held.values()) / 3
