import json

from pyspark.sql import functions as F

from proselens.operators import config, normalize
from proselens.sources import readers
from proselens.streaming import lint


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo\rthree \xff")
    (tmp_path / "b.HTML").write_text("<p>ok</p>\n<script>x<y\n</script><p>caf&eacute; &amp; game-changer</p>")
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.text_files(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.HTML"), str(tmp_path / "a.md")]).collect()}
    assert rows["a.md"] == "one\ntwo\nthree �" and len(rows) == 2
    assert rows["b.HTML"].split("\n")[2].strip() == "café & game-changer" and "x<y" not in rows["b.HTML"]
    bad = readers.text_files(spark, str(tmp_path / "a.md"), strict=True).first()
    assert bad["text"] is None and bad["error"]


def test_html(spark):
    d = spark.createDataFrame([("<p>ok</p>\n<p>This is &lt;b&gt;.</p>",), ("<STYLE>a\nb</style>x<!-- c\nd -->y",), (None,)], "t string")
    got = [r[0] for r in d.select(normalize.strip_html(F.col("t"))).collect()]
    assert got[0].split("\n")[1].strip() == "This is <b>." and got[1].count("\n") == 2 and got[1].split() == ["x", "y"] and got[2] is None


def test_manifest_and_ratings(spark, tmp_path):
    item = {"blind_id": "item-1", "target": "a", "brief": "b", "condition": "none", "profile": None, "kind": "authored", "draft": "d"}
    (tmp_path / "m.json").write_text(json.dumps({"run": "r", "brief": "b", "writers": ["a"], "conditions": ["none"], "anchor": False, "seed": 1, "items": [item]}, indent=2))
    m = readers.manifest(spark, str(tmp_path / "m.json")).first()
    assert m["run"] == "r" and m["target"] == "a" and m["profile"] is None and m["source"] is None
    (tmp_path / "r.csv").write_text("blind_id,writer,candidate,rating,fidelity_flag,forced_choice_pick\nitem-1,a,a,4,,\n")
    assert readers.ratings(spark, str(tmp_path / "r.csv")).first()["rating"] == "4"
    (tmp_path / "w/a/samples").mkdir(parents=True)
    (tmp_path / "w/a/samples/2.md").write_text("x")
    assert readers.samples(spark, str(tmp_path / "w")).first()["writer"] == "a"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "A game-changer."), (2, "None of them wrong. None of them ours."), (3, "clean")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = lint.findings_stream(stream, config.resolve()).writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["doc_id"], r["rule"]) for r in spark.table("found").collect()} == {(1, "banned-phrase"), (2, "two-beat")}
