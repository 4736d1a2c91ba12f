"""Cases with known results for operators that the given tables do not exercise."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.rules import QUERY_SUFFIXES, STOP_WORDS
from corpusloom.operators import changes, chunks, classify, diff, endpoints, evaluate, evidence, families, graph, quality, reports, retrieval
from corpusloom.sources import files as src


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("one")]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, tx.normalize_query(F.col("q"), QUERY_SUFFIXES), q="合同外变更有哪些？") == "合同外变更"
    assert one(spark, tx.tokenize_question(F.col("q"), STOP_WORDS), q="What is the 数据库 URL?") == ["what", "数据库", "url", "数据", "据库"]
    assert one(spark, tx.lines(F.col("t")), t="a\n\nb\n\n") == ["a", "", "b"]
    found = one(spark, tx.match_offsets(F.col("t"), "[0-9]+"), t="a12b3")
    assert [(r.match, r.start) for r in found] == [("12", 1), ("3", 4)]
    assert one(spark, tx.grams(F.col("t")), t="abab") == ["ab", "ba"]
    v = one(spark, tx.char_hash_embedding(F.col("t")), t="ab")
    assert [round(x, 6) for x in v[:2]] == [round(4 / 41**0.5, 6), round(5 / 41**0.5, 6)]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x" * 10)
    (tmp_path / "b.md").write_text("y")
    found = src.enumerate_files(spark, str(tmp_path))
    assert src.file_totals(found, large=5).first().asDict() == {"n_files": 2, "n_bytes": 11, "n_large": 1}
    paths = spark.createDataFrame([(p,) for p in ("a/node_modules/x.js", "dist/x", "a/~$b.docx", "a/c.TMP", "a/thumbs.db", "ok/a.md", "ok/a.png")], "rel_path string")
    kept = src.ignore_filter(paths, src.ignore_rules(spark, ["*.png", "# note"]))
    assert sorted(r.rel_path for r in kept.collect()) == ["ok/a.md", "ok/a.png"]
    assert one(spark, src.file_ext(F.col("n")), n="A.Tar.GZ") == "gz" and one(spark, src.file_ext(F.col("n")), n=".env") == ""
    assert [src.column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    rows = spark.createDataFrame([(1, "Name", "Value"), (2, None, None), (3, "a", "b")], "i int, a string, b string")
    got = [r.content for r in src.rows_to_evidence(rows, ["a", "b"], "Data", ["i"]).orderBy("row_no").collect()]
    assert got == ["[Data!A1:B1] Name | Value", "[Data!A3:B3] a | b"]
    assert one(spark, src.cell_range_of(F.col("t")), t=got[0]) == "Data!A1:B1"
    h = one(spark, src.html_sanitize(F.col("h")), h='<html><head></head><body onload="x()"><script>1</script><a href="javascript:y">z</a></body></html>')
    assert "script>" not in h and "onload" not in h and "javascript:" not in h and "Content-Security-Policy" in h
    assert one(spark, src.html_page_text(F.col("h")), h="<h2>T &amp; U</h2><p>a<b>b</b></p><script>x</script>") == "## T & U\nab"
    noisy = "word " * 12 + "\nword/media/image1.png\n" + "A" * 90 + "\nkeep  this\ndocProps/app.xml rest"
    assert one(spark, src.clean_text_noise(F.col("t")), t=noisy) == "word " * 12 + "\nkeep this\n"
    df = spark.createDataFrame([("p", 1), ("q", 2)], "project string, v int")
    path = str(tmp_path / "t")
    src.write_project_tables(df, path)
    src.write_project_tables(df.filter("project = 'p'").withColumn("v", F.lit(9)), path)
    assert sorted((r.project, r.v) for r in spark.read.parquet(path).collect()) == [("p", 9), ("q", 2)]


def test_changes(spark):
    prev = spark.createDataFrame([("p", "a", 1, "h1"), ("p", "b", 1, "h2"), ("p", "c", 1, "h3"), ("p", "u", 1, "h9")], "project string, rel_path string, size long, sha256 string")
    cur = spark.createDataFrame([("p", "a", 1, "h1x"), ("p", "z", 1, "h2"), ("p", "n", 1, "h4"), ("p", "u", None, None)], "project string, rel_path string, size long, sha256 string")
    got = {r.rel_path: (r.change_type, r.old_rel_path) for r in changes.snapshot_diff(prev, cur).collect()}
    assert got == {"a": ("MODIFIED", None), "z": ("RENAMED", "b"), "n": ("ADDED", None), "c": ("DELETED", None)}
    big = spark.range(1).select(F.repeat(F.lit("A"), 80_000).alias("x"), F.concat(F.lit("B"), F.repeat(F.lit("A"), 79_999)).alias("y"))
    r = big.select(changes.sampled_signature(F.col("x")).alias("a"), changes.sampled_signature(F.col("y")).alias("b")).first()
    assert r.a != r.b
    f = spark.createDataFrame([(1, "p", "x", "h", 0.9, False), (2, "p", "y", "h", 0.7, False), (3, "p", "z", None, None, False)], "file_id long, project string, rel_path string, sha256 string, relevance_score double, deleted boolean")
    assert sorted(r.file_id for r in changes.canonical_files(f).collect()) == [1, 3]


def test_chunks(spark):
    t = spark.createDataFrame([(1, "# A\nx\n## B\n" + "y" * 30 + "\nz\n\n")], "file_id long, text string")
    got = [(r.seq, r.heading, r.content) for r in chunks.line_chunks(t, limit=20).orderBy("seq").collect()]
    assert got == [(0, "A", "# A\nx\n## B\n" + "y" * 30), (1, "B", "z")]
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "de"), (1, 3, " ")], "f long, p int, text string")
    assert [(r.page_no, r.heading) for r in chunks.fixed_chunks(pages, "f", "p").orderBy("page_no").collect()] == [(1, "第 1 页"), (2, "第 2 页")]
    s = spark.createDataFrame([(1, "intro\n# One\na\n```\nb\n# Two\n\n# Three\nc")], "file_id long, text string")
    assert [(r.title, r.content) for r in chunks.split_sections(s).orderBy("section").collect()] == [("Document", "intro"), ("One", "a\nb"), ("Three", "c")]


def test_endpoints(spark):
    text = "# API 示例\njdbc:mysql://10.0.0.1:3306/demo\n\n```yaml\napi example\nhost: 10.9.9.9:80\n```\n\n# 正式环境\n数据库 jdbc:mysql://192.168.30.11:3306/prod\nhost=db.prod.local:5432\n地址10.1.1.1\n"
    t = spark.createDataFrame([(1, text)], "file_id long, text string")
    got = {(r.key_type, r.key_value) for r in endpoints.extract_endpoints(t).collect()}
    assert ("JDBC_URL", "jdbc:mysql://192.168.30.11:3306/prod") in got and ("HOST_PORT", "db.prod.local:5432") in got
    assert not any("demo" in v or v.startswith(("10.9", "10.1.1.1")) for _, v in got)


def test_relevance(spark):
    p = spark.createDataFrame([("p", "XM01", "智慧园区管理平台", "/data/01智慧园区")], "project string, code string, name string, root_path string")
    a = classify.project_anchors(p)
    f = spark.createDataFrame([(1, "p", "智慧园区/a.md", "a.md", ""), (2, "p", "x/远程医疗监测系统.md", "远程医疗监测系统.md", ""), (3, "p", "模板/b.md", "b.md", ""), (4, "p", "x/c.md", "c.md", "")], "file_id long, project string, rel_path string, name string, text string")
    got = {r.file_id: (r.status, r.scope_type) for r in classify.relevance(f, a).collect()}
    assert got == {1: ("IN_SCOPE", "PROJECT_CORE"), 2: ("OUT_OF_SCOPE", "OTHER_PROJECT"), 3: ("REFERENCE", "REFERENCE_MATERIAL"), 4: ("IN_SCOPE", "PROJECT_ASSUMED")}


def test_label_propagation(spark):
    cliques = [(f"a{i}", f"a{j}") for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(3) for j in range(i)] + [("x", "y")]
    e = spark.createDataFrame(cliques, "source string, target string")
    groups = {}
    for r in graph.label_propagation(e).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2"], ["x", "y"]]


def test_families(spark):
    assert one(spark, families.normalize_doc_name(F.col("n")), n="设计方案_V1.2(3)_终版.docx") == "设计方案"
    assert one(spark, families.normalize_doc_name(F.col("n")), n="合同20240101.docx") == "合同20240101"
    assert one(spark, families.version_label(F.col("n")), n="a 20240101.docx") == "20240101"


def test_rerank(spark):
    q = spark.createDataFrame([(1, "incremental snapshot")], "question_id long, question string")
    t = spark.createDataFrame([(i, 7, f"incremental snapshot {i}") for i in range(6)], "chunk_id long, file_id long, text string")
    lex = spark.createDataFrame([(1, i, 1.0) for i in range(6)], "question_id long, chunk_id long, score double")
    assert retrieval.hybrid_rerank(q, t, lex, retrieval.bigram_similarity(q, t), top_k=10).count() == 3
    literal = spark.createDataFrame([(1, "a_b 100%x")], "question_id long, question string")
    c = spark.createDataFrame([(1, 1, 0, "axb 100yx"), (2, 1, 1, "100 b")], "chunk_id long, file_id long, seq int, content string")
    assert {(r.keyword, r.chunk_id) for r in retrieval.keyword_hits(literal, c).collect()} == {("100", 1), ("100", 2)}


def test_history_and_answers(spark):
    cites = '[{"file_name":"a.md","chunk_id":1,"score":1.0},{"file_name":"b.md","chunk_id":2,"score":0.6},{"file_name":"c.md","chunk_id":3,"score":0.2},{"file_name":"c.md","chunk_id":4,"score":0.1}]'
    h = spark.createDataFrame([(1, "p", "nothing", True, cites, 1), (2, "p", "see c.md", True, cites, 2), (3, "p", "", False, cites, 3), (4, "p", "x", True, "not json", 4)], "id long, project_id string, answer string, grounded boolean, citations_json string, created_at int")
    assert {r.id: r.citation_count for r in evidence.ask_history_view(h, "p").collect()} == {1: 1, 2: 2, 3: 0, 4: 0}
    golden = spark.createDataFrame([(1, "甲,乙；丙", "x;y")], "question_id long, expected_keywords string, expected_source_patterns string")
    a = spark.createDataFrame([(1, "甲乙丙", True, [("dx",), ("ey",)])], "question_id long, answer string, grounded boolean, citations array<struct<file_name:string>>")
    r = evaluate.score_answers(golden, a).first()
    assert r.passed and abs(r.score - 1) < 1e-9


def test_global_contexts_of_every_question(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "question_id long, chunk_id long, rank int")
    got = [tuple(r) for r in evidence.global_contexts(ranked, spark.createDataFrame([(0,), (1,)], "community_no int")).collect()]
    assert sorted(got) == [(1, "chunk", "10", 1), (1, "chunk", "11", 2), (1, "community", "0", 0), (1, "community", "1", 1), (2, "chunk", "10", 1), (2, "community", "0", 0), (2, "community", "1", 1)]


def test_quality(spark):
    body = "项目合同金额为100万元，签订日期2024-05-01。" + "正文" * 60
    d = spark.createDataFrame([(1, "t", "", body), (2, "t", "", body.replace("100万元", "999万元")), (3, "t", "", "Ã©Ã¨Ã¼ï¼" + "x" * 200)], "artifact_id long, title string, instructions string, content string")
    e = spark.createDataFrame([(i, body) for i in (1, 2, 3)], "artifact_id long, excerpt string")
    got = {r.artifact_id: (r.status, r.coverage) for r in quality.quality_score(d, e).collect()}
    assert got[1] == ("PASSED", 100) and got[2][0] == "WARNING" and got[3][0] == "FAILED"
    p = spark.createDataFrame([(1, "标题\n旧内容\n保留内容", "标题\n新内容\n保留内容")], "pair_id long, base string, target string")
    assert diff.version_diff(p).first().asDict() == {"pair_id": 1, "added": 1, "removed": 1, "unchanged": 2}


def test_scope_and_routes(spark):
    d = spark.createDataFrame([(1, "仅使用18、19号文件。"), (2, "仅使用77号文件。"), (3, "all")], "artifact_id long, instructions string")
    f = spark.createDataFrame([(i, f"d/{i}号会议.md") for i in (17, 18, 19)], "file_id long, rel_path string")
    assert sorted(((r.artifact_id, r.file_id) for r in evidence.evidence_scope(d, f).collect()), key=str) == [(1, 18), (1, 19), (2, None)]
    log = spark.createDataFrame([("GET", "/v1/drafts/10/preview", 200, 12), ("GET", "/v1/drafts/11/preview", 500, 30)], "method string, route string, status int, duration_ms long")
    r = reports.route_metrics(log).collect()
    assert [(x.route, x.requests, x.errors, x.average_ms) for x in r] == [("GET /v1/drafts/{id}/preview", 2, 1, 21)]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
