"""Sources: PDF files as rows, spec-table CSVs with ragged rows, point CSVs, anchor JSON, export jobs.

Paths are read by Spark's own readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHORS = T.MapType(T.StringType(), T.StructType([T.StructField("value_pf", T.DoubleType()), T.StructField("vds_v", T.DoubleType())]))
CHARGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("qoss_pc", "vint_v", "coer_pf", "cotr_pf", "coer_vint_v", "cotr_vint_v")])
POINTS = "trace string, x_px int, y_px int, x_norm double, y_norm_log_axis double, vds_V string, cap_pF string, shared_collapsed string"


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return F.ltrim(F.regexp_replace(plain, "^" + "".join("\\" + c if not c.isalnum() else c for c in "/" + root.split("://")[-1].strip("/")), ""), F.lit("/"))


def discover_pdfs(spark: SparkSession, root: str, vendors: list[str] | None = None, excluded: tuple[str, ...] = ("_samples",), content: bool = False) -> DataFrame:
    """path, relative, vendor, is_copy, canonical, transforms, modificationTime, length (and content): hidden and excluded folders are skipped.

    A vendor is the first folder, case-folded; x.pdf.<transform>.pdf is a generated copy of x.pdf."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    rel = _relative(F.col("path"), root)
    parts = F.split("relative", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    keep = ~F.exists(folders, lambda p: p.startswith(".") | p.isin(*excluded))
    out = files.withColumn("relative", rel).where(keep).withColumn("vendor", F.when(F.size(parts) > 1, F.lower(F.get(parts, 0))).otherwise("_root"))
    if vendors:
        out = out.where(F.col("vendor").isin(*[v.lower() for v in vendors]))
    name = F.element_at(F.split("relative", "/"), -1)
    out = out.withColumns(variant(name))
    cols = ["path", "relative", "vendor", "is_copy", "canonical", "transforms", "modificationTime", "length"]
    return out.select(*cols, *(["content"] if content else []))


def variant(name: Column) -> dict[str, Column]:
    """is_copy, canonical name and transform chain of a file name."""
    is_copy = F.lower(name).rlike(r"\.pdf\..+\.pdf$")
    canonical = F.when(is_copy, F.regexp_replace(name, r"(?i)^(.*?\.pdf)\..*$", "$1")).otherwise(name)
    chain = F.when(is_copy, F.split(F.regexp_replace(name, r"(?i)^.*?\.pdf\.(.*)\.pdf$", "$1"), r"\.pdf\."))
    return {"is_copy": is_copy, "canonical": canonical, "transforms": F.coalesce(chain, F.array().cast("array<string>"))}


def spec_rows(spark: SparkSession, path: str) -> DataFrame:
    """part, line_no, cells of <part>.pdf.nop.csv files: ragged rows, quoted commas kept, line numbers in file order."""
    lines = spark.read.option("wholetext", "true").text(path).select("value", F.element_at(F.split(F.col("_metadata.file_name"), r"\.pdf"), 1).alias("part"))
    each = lines.select("part", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.length("line") > 0)
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.regexp_replace(F.substring(c, 2, F.length(c) - 2), '""', '"')).otherwise(c))
    return each.select("part", "line_no", cells.alias("cells"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """panel and the digitizer's point columns; unparsable numbers are null, withheld panels keep their rows."""
    raw = spark.read.option("header", "true").schema(POINTS).csv(path).withColumn("panel", F.regexp_replace(F.col("_metadata.file_name"), r"\.points\.csv$", ""))
    return raw.withColumns({c: F.col(c).try_cast("double") for c in ("vds_V", "cap_pF")})


def panel_points_status(points: DataFrame, trace: str = "Coss") -> DataFrame:
    """panel, n_rows, n_usable, status: withheld (points without physical values) is told from missing."""
    p = points.groupBy("panel").agg(F.count_if(F.col("trace") == trace).alias("n_rows"), F.count_if((F.col("trace") == trace) & F.col("vds_V").isNotNull() & (F.col("cap_pF") > 0)).alias("n_usable"), F.count_if((F.col("trace") == trace) & (F.col("vds_V").isNull() | F.col("cap_pF").isNull())).alias("_blank"))
    status = F.when(F.col("n_rows") == 0, "missing").when(F.col("_blank") == F.col("n_rows"), "withheld").when(F.col("n_usable") < 2, "too_few_samples").otherwise("ok")
    return p.select("panel", "n_rows", "n_usable", status.alias("status"))


def read_anchor_json(spark: SparkSession, path: str) -> DataFrame:
    """part, quantity, value_pf, vds_v from {part: {anchors: {...}}}: it replaces scraping, and absent parts have no anchors."""
    doc = spark.read.option("wholetext", "true").text(path)
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("anchors", ANCHORS), T.StructField("output_charge", CHARGE)]))
    m = doc.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})).alias("part", "x"))
    return m.select("part", F.explode_outer("x.anchors").alias("quantity", "a")).select("part", "quantity", "a.value_pf", "a.vds_v")


def export_jobs(manifest: DataFrame) -> DataFrame:
    """manifest (seq, name, points, trusted) -> jobs of trusted rows; repeated safe names get _2, _3 in order of seq."""
    from pyspark.sql import Window

    from ..functions.text import safe_name

    ok = manifest.where(F.coalesce("trusted", F.lit(False)) & F.col("points").isNotNull()).withColumn("base", safe_name(F.col("name")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    return ok.withColumn("job", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("_", "base", k.cast("string")))).drop("base")


def choose_page_text(words: DataFrame) -> DataFrame:
    """words (pdf, page, origin, text) of a primary and a fallback reader -> pdf, page, origin chosen.

    A page's primary text is corrupt with 20 words or more of which under 12 % are readable; the fallback needs 8
    readable words, twice the primary's, and 18 %."""
    good = F.col("text").rlike(r"^[A-Za-z0-9(),.;:/%+=°µΩ-]{2,}$")
    c = words.groupBy("pdf", "page", "origin").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"))
    one = lambda o, p: c.where(F.col("origin") == o).select("pdf", "page", F.col("n").alias(f"n_{p}"), F.col("g").alias(f"g_{p}"))
    j = one("primary", "p").join(one("fallback", "f"), ["pdf", "page"], "full")
    corrupt = (F.coalesce("n_p", F.lit(0)) == 0) | ((F.col("n_p") >= 20) & (F.col("g_p") < 0.12 * F.col("n_p")))
    better = (F.col("g_f") >= 8) & (F.col("g_f") >= 2 * F.coalesce("g_p", F.lit(0))) & (F.col("g_f") >= 0.18 * F.col("n_f"))
    return j.select("pdf", "page", F.when(F.coalesce(corrupt & better, F.lit(False)), "fallback").otherwise("primary").alias("origin"))


def drop_overprinted(words: DataFrame, within: float = 0.8) -> DataFrame:
    """words (page, seq, text, x0, y0, x1, y1): a word printed over an earlier kept one (same text, all edges within 0.8) goes; first wins, page by page."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        kept: dict[str, list] = {}
        flags = []
        for r in pdf.itertuples():
            twin = any(max(abs(r.x0 - k.x0), abs(r.y0 - k.y0), abs(r.x1 - k.x1), abs(r.y1 - k.y1)) <= within for k in kept.get(r.text, ()))
            flags.append(not twin)
            if not twin:
                kept.setdefault(r.text, []).append(r)
        return pdf[flags]

    return words.groupBy("page").applyInPandas(run, words.schema)


def text_lines(words: DataFrame, within: float = 3.5, last: int = 8) -> DataFrame:
    """words (page, seq, text, x0, y0, x1, y1) -> page, line, text: a word joins the nearest of the last 8 lines whose running centre is within 3.5."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []  # centre, words
        for r in pdf.sort_values(["y0", "x0", "seq"]).itertuples():
            c = (r.y0 + r.y1) / 2
            near = [x for x in lines[-last:] if abs(x[0] - c) <= within]
            if near:
                x = min(near, key=lambda x: abs(x[0] - c))
                x[1].append(r)
                x[0] += (c - x[0]) / len(x[1])
            else:
                lines.append([c, [r]])
        rows = [(pdf["page"].iloc[0], k, " ".join(w.text for w in sorted(ws, key=lambda w: (w.x0, w.seq)))) for k, (_, ws) in enumerate(lines)]
        return pd.DataFrame(rows, columns=["page", "line", "text"])

    return words.groupBy("page").applyInPandas(run, "page long, line long, text string")
