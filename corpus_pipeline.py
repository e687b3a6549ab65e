"""The corpus pipeline: filter by quality, drop near copies, cut repeated passages, mix sources, pack into windows.

Each stage takes the rows that the stage before it has written and decides over all of them. A stage's own working tables
go to the shared folder that the session names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawbook.llm.gramjoin import keep_one
from drawbook.llm.mixing import emit_copies, mix
from drawbook.llm.packing import pack
from drawbook.llm.quality import fit, score
from drawbook.llm.queries import WINDOW, read
from drawbook.llm.repeats import remove_repeats
from drawbook.llm.rows import free_name
from drawbook.session import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
REJECTED_BELOW = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own rows and their labels, does not reject.

    Null and empty texts get the model's prior and so stand or fall together; repeated rows do too. Columns of any name
    pass through, and an empty table gives an empty one.
    """
    model, mark = fit(docs, read(spark, sf_dir, "labels")), free_name(docs, "__score")
    return score(docs, model, score_col=mark).where(F.col(mark) >= REJECTED_BELOW).drop(mark)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    That with the smallest id stays, of rows equal in id and text one. Texts without words, null ones too, all stay. Columns
    of any name pass through, and an empty table gives an empty one.
    """
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start more than once; ``n_chars`` follows the text.

    A null text becomes empty. Repeated rows cut each other. No row goes; columns of any name pass through, but those that
    begin with ``rep_`` and bear a result's name; an empty table gives an empty one.
    """
    cut = remove_repeats(docs)
    new = {"text": F.col("rep_text"), "n_chars": F.length("rep_text").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, one row each time.

    A source without words gives nothing; a null source is one of its own. Rows equal in id and size are interchangeable.
    Columns of any name pass through (those named like a result of the mix under a free name); an empty table gives an empty one.
    """
    return emit_copies(mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in windows.

    Null and empty texts are one end token; repeated rows are packed each. An empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mixing), ("packing", packing)]

# The classifier's training, the suffix sort and the tokenizer have no SQL form; the tests hold the stages against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
