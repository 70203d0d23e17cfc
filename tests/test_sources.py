from pyspark.sql import functions as F

from chartmill.sources import files, sinks
from chartmill.streaming import incremental


def test_pdf_discovery_skips_hidden_and_finds_copies(spark, tmp_path):
    for name in ("NXP/a.pdf", "NXP/a.pdf.q.pdf", "rohm/b.pdf", "_samples/c.pdf", ".git/d.pdf", "e.pdf", "rohm/x.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    got = {r["relative"]: r for r in files.discover_pdfs(spark, str(tmp_path)).collect()}
    assert set(got) == {"NXP/a.pdf", "NXP/a.pdf.q.pdf", "rohm/b.pdf", "e.pdf"}
    assert got["NXP/a.pdf.q.pdf"]["canonical"] == "a.pdf" and got["NXP/a.pdf.q.pdf"]["transforms"] == ["q"]
    assert got["e.pdf"]["vendor"] == "_root" and not got["e.pdf"]["is_copy"]
    assert files.discover_pdfs(spark, str(tmp_path), vendors=["nxp"]).count() == 2


def test_spec_rows_keep_quotes_and_raggedness(spark, tmp_path):
    (tmp_path / "P1.pdf.nop.csv").write_text('50,Input capacitance,Ciss,-,2900 3770,pF,"VGS=0 V,VDS=40 V",,\n51,x\n')
    rows = files.spec_rows(spark, str(tmp_path)).orderBy("line_no").collect()
    assert rows[0]["part"] == "P1" and rows[0]["cells"][6] == "VGS=0 V,VDS=40 V" and len(rows[0]["cells"]) == 9
    assert rows[1]["cells"] == ["51", "x"]


def test_points_tell_withheld_from_missing(spark, tmp_path):
    head = "trace,x_px,y_px,x_norm,y_norm_log_axis,vds_V,cap_pF,shared_collapsed\n"
    (tmp_path / "a.points.csv").write_text(head + "Coss,1,2,0.1,0.2,,,False\nCoss,2,2,0.1,0.2,,,False\n")
    (tmp_path / "b.points.csv").write_text(head + "Ciss,1,2,0.1,0.2,1,5,False\n")
    (tmp_path / "c.points.csv").write_text(head + "Coss,1,2,0.1,0.2,1,5,False\nCoss,1,2,0.1,0.2,2,x,False\nCoss,1,2,0.1,0.2,3,4,False\n")
    got = {r["panel"]: r["status"] for r in files.panel_points_status(files.read_points(spark, str(tmp_path))).collect()}
    assert got == {"a": "withheld", "b": "missing", "c": "ok"}


def test_anchor_json_and_jobs(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"P": {"anchors": {"Ciss": {"value_pf": 5.0, "vds_v": 40.0}}}, "Q": {}}')
    got = {(r["part"], r["quantity"]): r["value_pf"] for r in files.read_anchor_json(spark, str(p)).collect()}
    assert got == {("P", "Ciss"): 5.0, ("Q", None): None}
    m = spark.createDataFrame([(1, "a b", "x", True), (2, "a-b", "y", True), (3, "c", "z", False), (4, "", "w", True)], "seq int, name string, points string, trusted boolean")
    assert [r["job"] for r in files.export_jobs(m).orderBy("seq").collect()] == ["a_b", "a_b_2", "unnamed"]


def test_page_text_choice_overprint_and_lines(spark):
    bad = [("d", 1, "primary", "\x01\x02")] * 25 + [("d", 1, "fallback", "Gate")] * 9 + [("d", 2, "primary", "Drain")] * 5
    got = {r["page"]: r["origin"] for r in files.choose_page_text(spark.createDataFrame(bad, "pdf string, page int, origin string, text string")).collect()}
    assert got == {1: "fallback", 2: "primary"}
    w = spark.createDataFrame([(1, 1, "A", 0.0, 0.0, 5.0, 5.0), (1, 2, "A", 0.5, 0.2, 5.3, 5.0), (1, 3, "A", 1.2, 0.0, 6.2, 5.0), (1, 4, "B", 9.0, 1.0, 12.0, 6.0), (1, 5, "C", 0.0, 40.0, 5.0, 45.0)], "page long, seq long, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["seq"] for r in files.drop_overprinted(w).collect()) == [1, 3, 4, 5]
    assert [r["text"] for r in files.text_lines(w).orderBy("line").collect()] == ["A A A B", "C"]


def test_sinks(spark, tmp_path):
    k = spark.createDataFrame([(1, 1, 2.0, 5.0, 0.1, 0.01), (1, 0, 0.0, 9.0, 0.1, 0.01)], "curve long, knot long, x double, y double, scale double, achieved double")
    model = sinks.model_json(k).first()["model"]
    assert model.index('"coss":9.0') < model.index('"coss":5.0')
    sinks.write_manifest(k.withColumn("r", F.array(F.lit("a"))), str(tmp_path / "m"), "csv", ("knot",))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).count() == 2
    v = spark.createDataFrame([(2, "rejected", "x"), (1, "accepted", "")], "entity long, status string, reasons string")
    assert sinks.closure_markdown(v).first()["report"].splitlines()[2] == "| 1 | accepted |  |"


def test_streams(spark, tmp_path):
    for n, c in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.pdf", b"2")):
        (tmp_path / n).write_bytes(c)
    q = incremental.first_of_content(incremental.arriving_pdfs(spark, str(tmp_path))).writeStream.format("memory").queryName("pdfs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pdfs").count() == 2
