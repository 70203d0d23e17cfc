"""Commands read folders, write tables and answer by exit code."""

from pyspark.sql import functions as F

from chartmill.cli import main


def test_export_writes_netlists_and_reports_refusals(spark, tmp_path):
    rows = [(1, "Coss", float(v), 800 / (1 + v) ** 0.5, v) for v in range(80)] + [(2, "Coss", 1.0, 5.0, 0)]
    spark.createDataFrame(rows, "curve long, trace string, x double, y double, seq int").write.parquet(f"{tmp_path}/in")
    assert main(["export-coss-spice", "--points", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--vmax", "40", "--samples", "128"], spark) == 1
    net = spark.read.json(f"{tmp_path}/out/netlists").collect()
    assert [r["curve"] for r in net] == [1] and net[0]["netlist"].startswith(".func qoss_c1(v) {table(max(v,0), 0,0.0")
    charge = spark.read.option("header", "true").csv(f"{tmp_path}/out/charges").agg(F.max(F.col("q").cast("double")), F.count(F.lit(1))).first()
    assert abs(charge[0] / (1600 * (41**0.5 - 1)) - 1) < 0.01 and charge[1] == 128
    assert {r["curve"]: r["status"] for r in spark.read.json(f"{tmp_path}/out/status").collect()}[2] != "ok"


def test_anchors_from_specification_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "M7.pdf.nop.csv").write_text('96,Input capacitance 7),Ciss,-,2800,3600,pF,"VGS=0 V,VDS=50 V,f=1 MHz",,\n97,Output capacitance 7),Coss,1170,1520,,,,,\n98,Reverse transfer capacitance 7),Crss,13,23,,,,,\n')
    (tmp_path / "in" / "AMBIG.pdf.nop.csv").write_text('96,Input capacitance,Ciss,-,2800,3600,pF,"VGS=0 V,VDS=50 V,f=1 MHz",,\n97,Output capacitance,Coss,1170,1520,,"VDS=25 V",,,\n98,Reverse transfer capacitance,Crss,13,23,,,,,\n')
    assert main(["anchors", "--tables", f"{tmp_path}/in", "--out", f"{tmp_path}/out"], spark) == 0
    got = {(r["part"], r["name"]): (r["value_pf"], r["vds_v"]) for r in spark.read.json(f"{tmp_path}/out/anchors").collect()}
    assert got == {("M7", "Ciss"): (2800, 50), ("M7", "Coss"): (1170, 50), ("M7", "Crss"): (13, 50), ("AMBIG", "Ciss"): (2800, 50), ("AMBIG", "Coss"): (1170, 25)}


def test_layouts_find_and_transfer(spark, tmp_path):
    pages = [("a", "p1", "chart", "native", ["x", "y", "z"]), ("b", "p1", "chart", "native", ["x", "y", "z"]), ("c", "p2", "chart", "native", [])]
    spark.createDataFrame(pages, "id string, pdf string, role string, mode string, tokens array<string>").write.parquet(f"{tmp_path}/pages")
    run = ["cluster-layouts", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/l"]
    assert main(run, spark) == 0 and main([*run, "--fail-on-errors"], spark) == 1 and main([*run, "--fail-on-errors", "--max-pdfs", "1"], spark) == 0
    assert {r["id"]: r["cluster"] for r in spark.read.json(f"{tmp_path}/l/clusters").collect()} == {"a": 1, "b": 1}
    spark.createDataFrame([(1, "Figure 3. Typ. gate charge", "VGS"), (2, None, None)], "id long, title string, text string").write.parquet(f"{tmp_path}/captions")
    assert main(["find", "--captions", f"{tmp_path}/captions", "--out", f"{tmp_path}/f"], spark) == 0
    assert {r["id"]: r["kind"] for r in spark.read.json(f"{tmp_path}/f/panels").collect()}[1] == "gate_charge"
    pts = [(1, 4 + n / 40, 50 / 2.25 * (n / 40) ** 2) for n in range(200)]
    spark.createDataFrame(pts, "curve long, v double, i double").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, 5.5, 50.0)], "curve long, vpl double, id_pl double").write.parquet(f"{tmp_path}/p")
    assert main(["digitize-transfer", "--points", f"{tmp_path}/t", "--pivots", f"{tmp_path}/p", "--out", f"{tmp_path}/o"], spark) == 0
