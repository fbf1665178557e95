import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspark.operators import ops
from loomspark.sources import connector, files
from loomspark.sources.html import to_markdown
from loomspark.streaming import jobs


def test_catalogue(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MD").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"caf\xff\xc3\xa9")
    (tmp_path / "c.html").write_text("<h2>T</h2><p>p <b>q</b></p><script>no</script>")
    (tmp_path / "d.exe").write_text("no")
    (tmp_path / "e.txt").write_text("x" * 100)
    cat = files.catalogue(spark, str(tmp_path), max_bytes=80)
    assert sorted(r["external_ref"] for r in cat.select("external_ref").collect()) == ["a/x.MD", "b.txt", "c.html"]
    md = {r["external_ref"]: r["markdown"] for r in files.as_markdown(cat).collect()}
    assert md == {"a/x.MD": "hello", "b.txt": "café", "c.html": "## T\n\np q"}
    s = files.scan_summary(spark, str(tmp_path), max_bytes=80).first()
    assert (s["scanned"], s["accepted"], s["skipped"]) == (5, 3, 2)


def test_html():
    page = "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td></tr></table><pre>x  y</pre><a href='u'>l</a>"
    assert to_markdown(page) == "- a\n  1. b\n- c\n\n| h | i |\n| --- | --- |\n| 1 |  |\n\n```\nx  y\n```\n\n[l](u)"
    assert to_markdown(None) == ""


def test_connector_source(spark):
    class Wiki(connector.Connector):
        def __init__(self, options):
            self.space = options.get("space")

        def configured(self):
            return None if self.space else "space"

        def pages(self):
            return 3

        def fetch_page(self, page):
            for i in range(2):
                yield (f"{self.space}{page}-{i}", f"title {i}", "text", None, None, None)

    connector.register(spark, "wiki", Wiki)
    assert connector.registered() == ["wiki"]
    df = spark.read.format("wiki").option("space", "s").load()
    assert sorted(r["external_ref"] for r in df.collect()) == [f"s{p}-{i}" for p in range(3) for i in range(2)] and df.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="isn't configured: space"):
        spark.read.format("wiki").load().count()


def test_windowed_metrics_match_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    s = jobs.windowed_metrics(jobs.stream_table(spark, str(tmp_path / "in")), "ts", "event_type", "value")
    got = {(r["start"], r["kind"]): r["n"] for r in jobs.run_to_memory(s, "metrics", "complete").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n").collect()}
    assert got == want


def test_sync_stream_keeps_the_newest(spark, tmp_path):
    day = lambda d: dt.datetime(2025, 1, d)
    src, base, ck = (str(tmp_path / x) for x in ("src", "base", "ck"))
    schema = "k string, item bigint, at timestamp"
    spark.createDataFrame([("a", 1, day(1)), ("b", 2, day(2)), ("a", 3, day(3))], schema).coalesce(1).write.parquet(src)
    jobs.sync_stream(spark, jobs.stream_table(spark, src), base, ck, ["k"], "at", "item").awaitTermination()
    spark.createDataFrame([("b", 4, day(1)), ("c", 5, day(1)), ("a", 6, day(9))], schema).coalesce(1).write.mode("append").parquet(src)
    jobs.sync_stream(spark, jobs.stream_table(spark, src), base, ck, ["k"], "at", "item").awaitTermination()
    assert sorted((r["k"], r["item"]) for r in spark.read.parquet(f"{base}/v2").collect()) == [("a", 6), ("b", 2), ("c", 5)]


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    rows = [(i, f"u{i % 2}", i * 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user string, ts double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = jobs.rate_limit_stream(jobs.stream_table(spark, str(tmp_path / "in")))
    got = {r["event_id"]: r["allowed"] for r in jobs.run_to_memory(s, "limited").collect()}
    assert got == {r["event_id"]: r["allowed"] for r in ops.rate_limited(df).collect()}


def test_html_tables_with_spans_and_within_cells():
    page = "<table><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><td>c<td>d</tr><tr><td colspan=x>e</td><td><table><tr><td>f</td><td>g</td></tr></table>h</td></tr></table>"
    assert to_markdown(page) == "| a | b | b |\n| --- | --- | --- |\n| a | c | d |\n| e | f g h |  |"
    assert to_markdown("<table><tr><td>1</td><td rowspan=9>2</td></tr><tr><td>3</td></tr></table>").split("\n") == ["| Column 1 | Column 2 |", "| --- | --- |", "| 1 | 2 |", "| 3 | 2 |"]
    assert to_markdown("<p>x</p><table><tr><th>open") == "x\n\n| open |\n| --- |"
    assert to_markdown("<table></table>y</td>") == "y"


def test_html_macros_and_code_languages():
    code = "<ac:structured-macro ac:name='code'><ac:parameter ac:name='language'>py</ac:parameter><ac:plain-text-body><![CDATA[if a < b:\n  c > d]]></ac:plain-text-body></ac:structured-macro>"
    assert to_markdown(code) == "```py\nif a < b:\n  c > d\n```"
    note = "<ac:structured-macro ac:name='note'><ac:rich-text-body><p>one</p><p>two</p></ac:rich-text-body></ac:structured-macro>"
    assert to_markdown(f"<p>x</p>{note}<p>y</p>") == "x\n\n> **NOTE:** one\n> two\n\ny"
    more = "<ac:structured-macro ac:name='expand'><ac:parameter ac:name='title'>T</ac:parameter><ac:rich-text-body><p>in</p></ac:rich-text-body></ac:structured-macro>"
    assert to_markdown(more) == "#### T\n\nin"
    assert to_markdown("<ac:structured-macro ac:name='toc'/>z") == "[macro:toc]\n\nz"
    assert to_markdown("<pre><code class='language-sql'>SELECT  1</code></pre>") == "```sql\nSELECT  1\n```"


def test_sync_stream_of_a_batch_delivered_again(spark, tmp_path):
    src, base, ck = (str(tmp_path / x) for x in ("src", "base", "ck"))
    rows = spark.createDataFrame([("a", 1, dt.datetime(2025, 1, 1))], "k string, item bigint, at timestamp")
    rows.write.parquet(src)
    jobs.sync_stream(spark, jobs.stream_table(spark, src), base, ck, ["k"], "at", "item").awaitTermination()
    # the stream without its commit of the batch runs it once more
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()
    jobs.sync_stream(spark, jobs.stream_table(spark, src), base, ck, ["k"], "at", "item").awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{base}/v1").collect()] == [("a", 1)] and not (tmp_path / "base" / "v2").exists()
