"""Sequential operators against plain Python, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import sequential as sq
from folioscope.sources import json_io
from folioscope.sources.tables import attempts
from folioscope.streaming import attempts as st

SF = "/root/testdata/sf0.001"


def test_html():
    html = "<head><title>t</title></head><h2>A &amp; B</h2><p>x <b>y</b><br>z</p><ul><li>one<ul><li>two</li></ul></li></ul><table><tr><th>a|b</th><th>c</th></tr><tr><td> 1 \n 2 </td><td>3</td></tr></table><pre>\ncode <b>\n</pre><script>no()</script>"
    assert sq.markdown_of(html) == "## A & B\n\nx **y**\nz\n\n- one\n\n  - two\n\n| a\\|b | c |\n| --- | --- |\n| 1 2 | 3 |\n\n```\ncode **\n```"
    assert sq.markdown_of("") == "" and sq.markdown_of("<p>open") == "open"


def test_chunks():
    text = "---\nt: 1\n---\n" + "\n\n".join("p" * 50 for _ in range(20)) + "\n```\n\n" + "c" * 300 + "\n\n```\n\nend"
    parts = sq.chunks_of(text, 200)
    assert parts[0] == "---\nt: 1\n---\n" and len(parts) > 4
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(p.count("```") % 2 == 0 for p in parts) and sq.chunks_of(" \n", 5) == [] and sq.chunks_of("ab", 5) == ["ab"]


@pytest.mark.parametrize("cut, want", [('{"a": [1, 2', {"a": [1, 2]}), ('x {"a": "b', {"a": "b"}), ('{"a": 1, "b": ', {"a": 1}), ('{"a": {"c": 1}} tail', {"a": {"c": 1}}), ("none", None), ('{"a": "x\\', {"a": "x\\"})])
def test_mended_json(cut, want):
    got = sq.mended_json(cut)
    assert (json.loads(got) if got else None) == want


def test_greedy(spark):
    rnd = random.Random(1)
    rows = [(d, rnd.randint(0, 5), rnd.randint(0, 5), float(rnd.randint(0, 9))) for d in range(40) for _ in range(12)]
    want = []
    for d in range(40):
        used_i, used_j = set(), set()
        for _, i, j, s in sorted((r for r in rows if r[0] == d and r[3] >= 3), key=lambda r: (-r[3], r[1], r[2])):
            if i not in used_i and j not in used_j:
                used_i.add(i), used_j.add(j), want.append((d, i, j, s))
    got = sq.assign(spark.createDataFrame(rows, "doc long, i long, j long, score double"), 3.0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    spans = spark.createDataFrame([(1, 0, 5, 1.0), (1, 4, 9, 3.0), (1, 9, 12, 2.0), (2, 0, 5, 1.0)], "doc long, start long, end long, score double")
    assert sorted((r.doc, r.start) for r in sq.non_overlapping(spans).collect()) == [(1, 4), (1, 9), (2, 0)]


def test_similarity(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "", ""), (3, "q", None)], "doc_id long, a string, b string")
    got = {r.doc_id: (round(r.ratio, 3), r.distance) for r in sq.similarity(pairs).collect()}
    assert got == {1: (0.667, 2), 2: (1.0, 0), 3: (0.0, 1)}


def test_replay_sees_no_outcome_ahead(spark):
    log = attempts(spark, SF)
    out = sq.adaptive_replay(log)
    assert out.join(log, ["doc", "ord"]).groupBy("doc").agg(F.sum("seconds").alias("s")).where("s > 300").count() == 0
    flipped = log.withColumn("accepted", F.when(F.col("ord") == 1, F.col("accepted")).otherwise(~F.col("accepted")))
    first = lambda d: sorted((r.doc, r.step, r.ord) for r in sq.adaptive_replay(d).where("step <= 3").collect())
    assert first(log) == first(flipped)


def test_json_sources(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"source": "s", "extra": 1, "blocks": [{"id": "b", "type": "text", "content": "x", "odd": 2}]}, indent=1))
    docs = json_io.read_json(spark, str(tmp_path / "doc.json"), json_io.DOCUMENT)
    assert json_io.blocks(docs).select("id", "content").collect() == [("b", "x")]
    json_io.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().schema_version == "1.0"
    (tmp_path / "cat.json").write_text(json.dumps({"cases": [{"id": "a", "suite": "scan", "tags": ["table", "zzz"]}, {"id": "b"}]}))
    assert [tuple(r) for r in json_io.catalog(spark, str(tmp_path / "cat.json")).select("id", "suite", "tags", "expect_status").collect()] == [("a", "scan", ["table"], "DONE_VERIFIED"), ("b", "academic", [], "DONE_VERIFIED")]
    (tmp_path / "bad.json").write_text('{"a": 1}\n\n{oops\n')
    assert sorted((r.a, r._corrupt_record is None) for r in json_io.read_lines(spark, str(tmp_path / "bad.json"), "a int").collect() if r.a) == [(1, True)]
    man = {"schema": "1", "batches": [{"id": 2, "status": "accepted", "text": "b"}, {"id": 1, "status": "accepted", "text": "a"}]}
    (tmp_path / "m.json").write_text(json.dumps(man))
    found = json_io.batches(spark, str(tmp_path / "m.json"))
    assert json_io.accepted_text(found).first().text == "a\n\nb" and json_io.next_pending(found).count() == 0
    with pytest.raises(Exception, match="not accepted"):
        json_io.accepted_text(found.withColumn("status", F.lit("failed"))).collect()
    base = spark.createDataFrame([("a", [1], ["x"])], "id string, p array<int>, q array<string>")
    over = spark.createDataFrame([("a", [], ["y"])], "id string, p array<int>, q array<string>")
    assert tuple(json_io.overlay(base, over, "id", ("p", "q")).first()) == ("a", [1], ["y"])


@pytest.fixture
def stream(spark, tmp_path):
    log = attempts(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = log.where("ord <= 20")
    for part in range(3):
        rows.where(f"ord > {part * 7} and ord <= {part * 7 + 7}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_running_state_equals_batch(spark, stream):
    from folioscope.operators.attempts import clipped_average

    rows, live = stream
    q = st.running_state(live).writeStream.format("memory").queryName("running").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT doc, max_by(struct(n_accepted, average, most), n) AS x, max(n) AS n FROM running GROUP BY doc").collect()
    batch = {r.doc: r for r in rows.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("int")).alias("won"), F.max("seconds").alias("most")).collect()}
    average = {r.doc: r.average for r in clipped_average(rows).collect()}
    assert len(last) == len(batch)
    for r in last:
        assert r.n == batch[r.doc].n and r.x.n_accepted == batch[r.doc].won and r.x.most == batch[r.doc].most and abs(r.x.average - average.get(r.doc, 2.65)) < 1e-9


def test_distinct_and_merge(spark, stream, tmp_path):
    rows, live = stream
    q = st.distinct(live, ["event_id"], "60 days").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == rows.select("event_id").distinct().count()
    q = st.merged(live, str(tmp_path / "table"), ["doc", "class"]).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "table"))
    assert got.count() == got.select("doc", "class").distinct().count() == rows.select("doc", "class").distinct().count()


def test_windows(spark, stream):
    rows, live = stream
    q = st.windowed(live, "1 day", "60 days").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == rows.count()


def test_tables():
    from folioscope.operators.rewriting import tables_of

    assert tables_of("a\tb\n1\t2\nx") == "| a | b |\n| --- | --- |\n| 1 | 2 |\nx"
    assert tables_of("| a | b |\n| 1 | 2 |") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    done = "| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\nq\tr\n```"
    assert tables_of(done) == done


def test_bold(spark):
    from folioscope.operators.rewriting import bold

    docs = spark.createDataFrame([(1, "# LEAP\nLEAP leap LEAP `deep net` deep nets deep net **deep net** deep net deep net")], "doc_id long, text string")
    assert bold(docs, ("LEAP", "deep net")).first().text == "# LEAP\n**LEAP** leap LEAP `deep net` deep nets **deep net** **deep net** **deep net** deep net"


def test_outside_code(spark):
    from folioscope.operators.rewriting import math_delimiters

    row = spark.createDataFrame([(r"`\(a\)` \(b\) ```" + "\n\\[c\\]\n```",)], "t string").select(math_delimiters(F.col("t"))).first()
    assert row[0] == "`\\(a\\)` $b$ ```\n\\[c\\]\n```"


def test_corruption(spark):
    from folioscope.functions import gates

    rows = [("ok", "\\frac{a}{b} = c"), ("quads", "\\quad " * 9 + "x"), ("braces", "x = {y"), ("env", "\\begin{align} a \\end{cases}"), ("letters", "a b c d e f"), ("empty", "")]
    got = {r.k: r.q for r in spark.createDataFrame(rows, "k string, t string").select("k", gates.corruption(F.col("t")).alias("q")).collect()}
    assert got["ok"].valid and got["ok"].corruption == 0 and got["ok"].reasons == "" and got["empty"].reasons == "empty_brace_garbage"
    assert not got["quads"].valid and "quad_run" in got["quads"].reasons and "spacing_only_ratio" in got["quads"].reasons
    assert got["braces"].syntax == 0.4 and not got["braces"].valid and got["env"].syntax == 0.3 and got["letters"].corruption == 0.85


def test_best_transcript(spark):
    from folioscope.operators.pages import best_transcript

    long, head = "plain words here. " * 30, "# Title\n" + "plain words here. " * 20
    rows = [(1, "b", long), (1, "a", head), (2, "a", "short"), (3, "a", long + "k" * 50), (3, "b", long)]
    got = {r.doc_id: r.source for r in best_transcript(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {1: "a", 3: "b"}


def test_renumbered(spark):
    docs = spark.createDataFrame([(1, "<!-- i0001:f01 --> and i0009:f02, not xi0001:f01")], "doc_id long, text string")
    assert sq.renumbered(docs, 6).first().text == "<!-- i0007:f01 --> and i0015:f02, not xi0001:f01"
