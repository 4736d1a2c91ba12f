"""Fingerprints that open few files, and scans through the derived tables."""

import os

from pyspark.sql import functions as F

from corpusloom.operators import changes, scan
from corpusloom.session import fresh_path
from corpusloom.sources.files import enumerate_files
from corpusloom.streaming import streams


def tree(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{root}/{name}", (1_700_000_000, 1_700_000_000))


def listed(spark, root):
    rel = F.expr(f"substring(path, length('file:{root}/') + 1)")
    return enumerate_files(spark, str(root)).select(F.lit("p").alias("project"), rel.alias("rel_path"), "path", "size", "mtime")


def test_only_moved_files_are_opened(spark, tmp_path):
    root = tmp_path / "tree"
    files = {f"d{i % 3}/f{i}.md": f"text {i} " * 20 for i in range(12)} | {"odd [1]{a}*?.md": "odd name"}
    tree(root, files)
    opened = []

    def reader(session, paths):
        opened.append(sorted(r["path"] for r in paths.collect()))
        return scan.open_files(session, paths, batch=5)

    none = spark.createDataFrame([], scan.FILES)
    first = scan.fingerprints(spark, listed(spark, root), none, read=reader)
    known = spark.createDataFrame(first.collect(), first.schema).withColumn("deleted", F.lit(False))
    assert len(opened[0]) == 13
    plain = {r["rel_path"]: r["sha256"] for r in listed(spark, root).join(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", changes.content_sha256(F.col("content")).alias("sha256")), "path").collect()}
    assert {r["rel_path"]: r["sha256"] for r in known.collect()} == plain
    # one changes its size, one its time only, one is new, one changes its content only
    tree(root, {"d0/f0.md": "longer " * 30, "new.md": "new", "d2/f2.md": "TEXT 2 " * 20})
    os.utime(root / "d1/f1.md", (1_700_000_500, 1_700_000_500))
    again = {r["rel_path"]: r for r in scan.fingerprints(spark, listed(spark, root), known, read=reader).collect()}
    assert [os.path.basename(p) for p in opened[1]] == ["f0.md", "f1.md", "new.md"]
    assert again["d1/f1.md"]["sha256"] == plain["d1/f1.md"] and again["d2/f2.md"]["sha256"] == plain["d2/f2.md"] and again["d0/f0.md"]["sha256"] != plain["d0/f0.md"]
    # signatures see the content; a full scan opens all
    signed = {r["rel_path"]: r["sha256"] for r in scan.fingerprints(spark, listed(spark, root), known, signatures=True, read=reader).collect()}
    assert signed["d2/f2.md"] != plain["d2/f2.md"] and signed["d2/f5.md"] == plain["d2/f5.md"]
    scan.fingerprints(spark, listed(spark, root), known, mode="FULL", read=reader)
    assert [len(x) for x in opened[2:]] == [14, 14]
    # nothing moved: nothing is opened
    assert scan.open_files(spark, known.limit(0)).collect() == []


def listing(spark, files):
    rows = [("p", path, None if text is None else len(text), 1, text) for path, text in files.items()]
    df = spark.createDataFrame(rows, "project string, rel_path string, size long, mtime long, text string")
    return df.withColumns({"sha256": changes.content_sha256(F.col("text")), "content_signature": changes.sampled_signature(F.col("text"))})


def shape(store):
    """All tables by their rows, without the scan numbers of paths."""
    cols = {"files": ["rel_path", "sha256", "parse_status", "first_seen_scan", "last_seen_scan", "content_scan", "deleted"]}
    out = {n: sorted(map(tuple, store.table(n).filter(F.col("scan_id") == store.last_scan()).select(cols.get(n, "*")).collect()), key=str) for n in ("files", "nodes", "edges", "report", "log")}
    out["chunks"] = sorted(map(tuple, store.current("chunks").select("rel_path", "seq", "heading", "content").collect()))
    out["items"] = sorted(map(tuple, store.items().select("rel_path", "key_type", "key_value", "review_status").collect()))
    return out


ONE = {"a/keep.md": "# K\nsee https://one.corp/api\n", "a/change.md": "old https://two.corp/api and redis://r.corp:1/x", "a/gone.md": "gone https://gone.corp/x", "b/old name.md": "moved text https://moved.corp/x", "pic.png": "https://no.corp/x", "unread.md": "was https://read.corp/x"}
TWO = {"a/keep.md": ONE["a/keep.md"], "a/change.md": "new https://two.corp/api and https://three.corp/api", "b/new name.md": ONE["b/old name.md"], "pic.png": ONE["pic.png"], "unread.md": None, "fresh.md": "https://fresh.corp/x"}


def test_two_scans_keep_reviews_and_replays_change_nothing(spark):
    store = scan.ScanStore(spark, fresh_path(spark, "store"))
    assert store.last_scan() is None
    store.scan(listing(spark, ONE), 1)
    ids = {r["rel_path"]: r["file_id"] for r in store.files().collect()}
    store.review(spark.createDataFrame([(ids["a/change.md"], "URL", "https://two.corp/api", "CONFIRMED"), (ids["b/old name.md"], "URL", "https://moved.corp/x", "REJECTED")], "file_id long, key_type string, key_value string, review_status string"))
    got = store.scan(listing(spark, TWO), 2)
    assert {r["rel_path"]: r["change_type"] for r in got.collect()} == {"a/keep.md": "UNCHANGED", "a/change.md": "MODIFIED", "a/gone.md": "DELETED", "b/new name.md": "RENAMED", "pic.png": "UNCHANGED", "fresh.md": "ADDED"}
    files = {r["rel_path"]: r for r in store.files().collect()}
    assert files["b/new name.md"]["file_id"] == ids["b/old name.md"] and files["b/new name.md"]["content_scan"] == 1
    assert files["a/gone.md"]["deleted"] and files["unread.md"]["last_seen_scan"] == 1 and not files["unread.md"]["deleted"]
    assert files["pic.png"]["parse_status"] == "SKIPPED" and files["fresh.md"]["parse_status"] == "PARSED"
    state = shape(store)
    assert state["items"] == [("a/change.md", "URL", "https://three.corp/api", "PENDING"), ("a/change.md", "URL", "https://two.corp/api", "CONFIRMED"), ("a/keep.md", "URL", "https://one.corp/api", "PENDING"), ("b/new name.md", "URL", "https://moved.corp/x", "REJECTED"), ("fresh.md", "URL", "https://fresh.corp/x", "PENDING"), ("unread.md", "URL", "https://read.corp/x", "PENDING")]
    assert [c[:3] for c in state["chunks"]] == [("a/change.md", 0, None), ("a/keep.md", 0, "K"), ("b/new name.md", 0, None), ("fresh.md", 0, None), ("unread.md", 0, None)]
    assert ("file:b/new name.md", "FILE") in {(n[1], n[2]) for n in state["nodes"]} and not any("moved.corp" in str(n) for n in state["nodes"])
    # the same scan again
    store.scan(listing(spark, TWO), 2)
    assert shape(store) == state
    # a path that is used again is another file; nothing else is made anew
    store.scan(listing(spark, {**TWO, "a/gone.md": "back https://back.corp/x"}), 3)
    back = [r for r in store.files().collect() if r["rel_path"] == "a/gone.md"]
    assert sorted(r["deleted"] for r in back) == [False, True] and len({r["file_id"] for r in back}) == 2
    assert [r["content"] for r in store.table("chunks").filter("scan_id = 3").collect()] == ["back https://back.corp/x"]
    assert [i for i in shape(store)["items"] if i[0] != "a/gone.md"] == state["items"]


def test_stream_gives_the_batch_tables(spark):
    manifests, check = fresh_path(spark, "manifests"), fresh_path(spark, "stream")
    streamed, plain = (scan.ScanStore(spark, fresh_path(spark, "store")) for _ in range(2))
    seen = []
    for n, files in enumerate((ONE, TWO), 1):
        at = fresh_path(spark, "listing")
        listing(spark, files).repartition(3).write.parquet(at)
        spark.createDataFrame([(n, at)], streams.MANIFEST).coalesce(1).write.mode("append").parquet(manifests)
        streams.incremental_scan_stream(spark, manifests, streamed, check, on_changes=lambda c, k: seen.append((k, c.count()))).awaitTermination()
        plain.scan(spark.read.parquet(at), n)
    assert shape(streamed) == shape(plain)
    assert [k for k, _ in seen] == [1, 2]
