"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and works on all that
its predecessor kept; all but the last return these columns again. Between stages the rows are written as
Parquet in the shared folder and read again. Extra columns, whatever their names, are dropped by every stage.
An empty table gives an empty table; other cases are stated by stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm.common import made_so_far, release, written
from chartmill.llm.packing_gga import pack
from chartmill.llm.pareto_mix import mix
from chartmill.llm.parity_join import one_of_each
from chartmill.llm.quality_mcd import judge
from chartmill.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Scratch tables of stages that have run. A stage's rows are written before the next stage begins, so these can go
#: then, unless that stage's input still reads them.
_scratch: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _scratch, docs)
        before = set(made_so_far())
        out = f(spark, docs, sf_dir)
        made = [p for p in made_so_far() if p not in before] if f is not packing_rows else []  # the result itself may be read later
        _scratch[:] = [p for p in _scratch if p in made_so_far()] + made
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go.

    Null, empty and wordless texts have fewer than 20 words and go; a null lang or source is a group of its own, a null doc_id is
    kept like any other; very long texts are counted whole; rows with equal text, lang and source (repeated rows too) share a verdict.
    """
    return judge(docs, keep=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of those linked, the least doc_id, nulls before all.

    Rows without a word are linked with nothing and stay, one of identical ones; repeated rows are one document; texts of fewer than
    five words are compared whole; very long texts by all their shingles; null lang, source and n_chars don't matter.
    """
    return one_of_each(docs.select(*COLUMNS))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur elsewhere too, in whatever document, are cut out everywhere; n_chars follows the text.

    Null texts stay null (n_chars null), texts of 50 words or fewer stay as they are; a document that loses every word goes, so do
    repeated rows of over 50 words; null ids, lang and source are kept; passages are found in whole texts of any length.
    """
    return without_repeats(docs.select(*COLUMNS), window=51, unit="words").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes it, three times at most.

    Null, empty and wordless texts have size 0 and aren't taken; a null source is a source of its own; repeated rows are documents of
    their own; ties in the ranking are settled by doc_id and size; a very long document is passed over where it doesn't fit.
    """
    mixed = mix(docs, keep=("text", "lang", "n_chars")).where("taken > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one token; copies and repeated rows are packed each; null doc_ids are kept; longer texts are cut.
    """
    return pack(docs, capacity=2048)


packing = _stage(packing_rows)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Stages count hashes, iterate and tokenise: SQL doesn't express them; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
