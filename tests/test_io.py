import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.operators import coverage, graph, orphans, ranking, reports
from weftline.plans import discovery
from weftline.sources import readers, writers
from weftline.streaming import incremental


def test_texts_and_chunks(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("日本語\n\nok".encode() + b"\xff\xfe" + b" end")
    (tmp_path / "empty.txt").write_text("")
    rows = {r.source_id: r for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert rows["a_b"].text == "日本語\n\nok end" and rows["a_b"].source_file == "a b.txt"
    (tmp_path / "p.html").write_text("<html><script>x<y</script><p>Hello &amp; bye</p></html>")
    assert readers.read_html(spark, str(tmp_path)).first().text == "Hello & bye"
    for i in range(2):
        d = tmp_path / "chunks" / "s1"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"chunk_{i:04d}.json").write_text(json.dumps({"source_id": "s1", "chunk_index": i, "char_count": 3, "text": "abc", "more": 1}, indent=1))
    c = readers.read_chunks(spark, str(tmp_path / "chunks"))
    assert coverage.chunk_counts(c).first().chunks == 2
    writers.write_chunks(c, str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out" / "source_id=s1")


def test_concept_files(spark, tmp_path):
    for folder, name, body in (("s1", "concepts.json", '{"concepts":[{"en_name":"A","jp_name":"あ"}]}'), ("s1", "part.json", '{"concepts":[{"en_name":"B"}]}'), ("s2", "x.json", '{"source_id":"S2","concepts":[{"en_name":" a ","jp_name":"あ"}]}'), ("s2", "y.json", '{"concepts":[')):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    good, bad = readers.read_concept_files(spark, str(tmp_path))
    assert {(r.source_id, r.en_name) for r in good.collect()} == {("s1", "A"), ("S2", " a ")}
    assert [r.reason for r in bad.collect()] == ["malformed"]
    ex = {(r.jp, r.en): r.sources for r in readers.read_extractions(spark, str(tmp_path)).collect()}
    assert ex[("あ", "a")] == ["S2", "s1"]


def test_documents(spark, tmp_path):
    c, r = readers.read_concept_db(spark, str(tmp_path / "none.json"))
    assert c.count() == 0 and r.count() == 0
    (tmp_path / "db.json").write_text(json.dumps({"concepts": [{"concept_id": "SCS-0001", "jp_name": "x", "four_axis": ["官民関係"]}], "relationships": [{"source": "SCS-0001", "target": "SCS-0002"}]}))
    c, r = readers.read_concept_db(spark, str(tmp_path / "db.json"))
    n, e, counts = graph.build_graph(c, r)
    assert tuple(counts.first()) == (1, 1) and n.first().color == "#9b59b6" and e.first().width == 1
    (tmp_path / "m.json").write_text(json.dumps({"relationships": [{"category": "k", "edges": [{"source": "a", "target": "b", "type": "t"}]}]}))
    assert tuple(readers.read_manual_edges(spark, str(tmp_path / "m.json")).first()) == ("k", "a", "b", "t")
    assert readers.read_inferred(spark, str(tmp_path / "none.json")).count() == 0
    writers.write_document(r, str(tmp_path / "doc"), "rows", task="x")
    assert spark.read.json(str(tmp_path / "doc" / "metadata")).first()["count"] == 1
    path = writers.write_version(r, str(tmp_path / "v"), "1")
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "t.html").write_text("<html><head><title>old</title></head><body>/* data:begin */fetch()/* data:end */</body></html>")
    writers.export_html(str(tmp_path / "t.html"), str(tmp_path / "o.html"), "new", nodes=n)
    page = (tmp_path / "o.html").read_text()
    assert "<title>new</title>" in page and "fetch()" not in page and "SCS-0001" in page
    # A page that fetches its documents keeps its code; the calls are answered from the page.
    (tmp_path / "f.html").write_text("<html><head><title>Graph</title></head><body><script>fetch('../graph.json').then(show)</script></body></html>")
    writers.export_html(str(tmp_path / "f.html"), str(tmp_path / "g.html"), graph={"nodes": n, "edges": r.limit(0)})
    page = (tmp_path / "g.html").read_text()
    assert "<title>Graph (Standalone)</title>" in page and "fetch('../graph.json').then(show)" in page
    assert page.index("window.fetch =") < page.index("</head>") and '"graph": {"nodes": [' in page and '"edges": []' in page


def test_texts_by_a_program(spark, tmp_path):
    tool = tmp_path / "tool.sh"
    tool.write_text("#!/bin/sh\ngrep -q broken \"$1\" && { echo no good >&2; exit 3; }\ntr a-z A-Z < \"$1\"\n")
    tool.chmod(0o755)
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, content in (("a b.pdf", "hello"), ("c.pdf", "broken"), ("d.txt", "other"), ("e.pdf", "")):
        (docs / name).write_text(content)
    good, bad = readers.extract_texts(spark, str(docs), command=(str(tool), "{}"))
    assert {tuple(r) for r in good.collect()} == {("a_b", "a b.pdf", "HELLO")}
    assert {tuple(r) for r in bad.collect()} == {("c.pdf", "no good\n")}
    writers.write_failures(bad, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.extract_texts(spark, str(docs), command=("no-such-program", "{}"))


def test_reports(spark, small):
    con = discovery.concepts(spark, small)
    axes = discovery.axis_scores(spark, small).join(con.select("id", F.coalesce("jp_name", "en_name").alias("name")), "id")
    assert "# RQ1" in reports.axis_report(axes.select("id", "name", "dominant_axis", "score"))
    lab = con.select("id", F.coalesce("jp_name", "en_name").alias("name"), "definition", F.lit("便益_市場秩序").alias("label"))
    assert "他" in reports.impact_report(lab)
    tr = discovery.transfer_score_tiers(spark, small).join(con.select("id", F.coalesce("jp_name", "en_name").alias("name"), "country_tag"), "id")
    assert "# RQ3" in reports.transfer_report(tr.withColumn("score", F.col("transferability_score")))
    assert "# Hypotheses" in reports.hypothesis_report(discovery.gap_hypotheses(spark, small))
    assert reports.gap_report(graph.score_gaps(graph.with_labels(discovery.part_gaps(spark, small, 15), discovery.parts(spark, small), columns=("label", "country", "type")))).count("\n") == 20
    cov = discovery.coverage_density(spark, small)
    text = reports.validation_report(coverage.coverage_summary(cov), cov, discovery.country_distribution(spark, small), discovery.isolated_nodes(spark, small))
    assert "# Validation" in text
    assert ranking.diversity(discovery.scored_part_gaps(spark, small)).first().gaps > 0


def test_reports_list_all(spark, tmp_path):
    n = reports.SHOWN + 500
    con = spark.range(n).select(F.format_string("C%05d", "id").alias("id"), F.lit("x").alias("name"), F.lit("JP").alias("country_tag"), F.lit("").alias("recommendation"), F.lit(0.5).alias("score"))
    text = reports.transfer_report(con)
    assert all(f"| C{i:05d} |" in text for i in range(n))
    text = reports.transfer_report(con, home_path=str(tmp_path / "jp"))
    assert f"{n} rows" in text and spark.read.json(str(tmp_path / "jp")).select("id").distinct().count() == n
    priority = F.when(F.col("id") < n, "high").when(F.col("id") < n + 30, "medium").otherwise("low")
    hyp = spark.range(n + 70).select(priority.alias("priority"), (1 / (F.col("id") + 1)).alias("score"), F.format_string("h%05d", "id").alias("statement"), *[F.col("id").alias(c) for c in "abc"], *[F.lit("t").alias(c) for c in ("hypothesis_type", "axes", "rq")])
    text = reports.hypothesis_report(hyp)
    assert f"| high | {n} |" in text and "| medium | 30 |" in text and "| low | 40 |" in text
    assert [line.split()[-1] for line in text.split("\n") if line.startswith("###")] == [f"h{i:05d}" for i in range(n + 5)]
    text = reports.hypothesis_report(hyp, high_path=str(tmp_path / "high"))
    assert f"{n} rows" in text and spark.read.json(str(tmp_path / "high")).count() == n and f"### {n + 1}. h{n:05d}" in text


def test_streams(spark, small, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(2).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = incremental.windowed_counts(stream, "ts", "event_type", "value", late="3650 days").writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = incremental.windowed_counts(spark.read.parquet(str(src)), "ts", "event_type", "value")
    last = spark.sql("select start, event_type, max(n) n from windows group by 1, 2")
    assert last.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]

    edges = tmp_path / "edges"
    rows = spark.read.parquet(f"{small}/edges.parquet")
    rows.unionByName(rows).repartition(3).write.parquet(str(edges))  # every row is delivered twice, in any batch
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(edges))

    def refs(df):
        return orphans.references(orphans.ReferenceSet("edges", df, "id", "created_at", ("source", "target")))

    base = str(tmp_path / "orphans")
    q = s.writeStream.foreachBatch(incremental.orphan_state_writer(base, refs)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    whole = orphans.apply_deltas(orphans.reference_deltas(refs(rows)))
    assert {tuple(r) for r in incremental.latest_state(spark, base).collect()} == {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in incremental.known_references(spark, base).collect()} == {tuple(r) for r in refs(rows).select(*orphans.REFERENCE, "ref_time").collect()}
    concept = spark.read.parquet(f"{small}/concept.parquet").select(F.col("concept_id").alias("key"), F.col("loaded_at").alias("loaded"), F.col("deleted_at").alias("deleted"))
    write = incremental.orphan_state_writer(base, records=lambda df: df)
    for n in (3, 4, 4):  # the last is tried again
        write(concept.where(f"deleted IS {'NOT' if n == 4 else ''} NULL"), n)
    state = incremental.latest_state(spark, base)
    full = orphans.apply_deltas(whole, orphans.existence(concept, "key", "loaded", "deleted"))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in full.collect()}
