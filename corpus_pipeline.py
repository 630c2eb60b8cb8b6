"""Documents to a training mix: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from atrium.llm.common import Shared, shared_dir, table
from atrium.llm.decontaminate import clean_documents
from atrium.llm.mixing import mix_sources
from atrium.llm.near_dup import drop_near_duplicates
from atrium.llm.quality_model import score, train
from atrium.llm.span_dup import span_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_made: dict[str, list[Shared]] = {}


def stage(f: Callable) -> Callable:
    """A stage begins when the one before is written, so it first drops that one's working tables of the same session."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _made.setdefault(f"{spark.sparkContext.applicationId}/{id(spark)}", [])
        while made:
            made.pop().drop("")
        with Shared.owned(made):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Without labels for them nothing is; null and empty texts are scored like any other; repeated rows stay or go together.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id's, a null id before all; of repeated rows one.

    Documents without words, null texts included, are near nothing and all stay.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that another document, or an earlier place, has first; n_chars follows.

    Every row stays, with an empty text if all of it was repeated; null texts stay null. Of ids that tie, null ones
    included (they come last), it isn't fixed which has a span first.
    """
    return span_dedup(docs, COLUMNS).selectExpr("doc_id", "text", "lang", "source", "if(n_removed > 0, cast(char_length(text) as bigint), n_chars) as n_chars")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts have none; an empty benchmark removes nothing; repeated rows go together."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix: all rows, with copies and taken, 0 for those left out.

    A null text has size 0, a null source is a source of its own, rows that tie in the order go together.
    """
    return mix_sources(docs, COLUMNS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("mix", mix)]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, of which only COLUMNS are used. Very long texts are handled whole; an empty table gives an empty mix."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{i}-{name}")
    return docs
