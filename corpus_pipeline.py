"""Corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last return
the columns of ``documents``; further columns of the input stay, whatever their names. Documents whose words are
all removed as copies leave with them; null texts do not pass the first stage. Repeated rows of one id pass or go
together; a table without rows gives none. A stage deletes the intermediate tables of those before it, which its input, written and read
again, does not need.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm import best_fit_packing, chosen_path_join, fuzzy_lines, quality_repetition, substring_dedup
from lakequill.llm.common import Scratch, opened, table
from lakequill.llm.queries import PACKING_TOKENIZER

#: Words of a repeated passage that the substring stage removes.
PASSAGE_WORDS = 50

#: No SQL expresses the stages; tests hold each against brute force.
ORACLE_SQL = None


#: Intermediate tables of the stages so far.
_scratches: list[Scratch] = []


def _stage(function):
    """Delete what earlier stages wrote for themselves, unless ``docs`` still reads it."""

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scratch in [s for s in _scratches if not s.read_by(docs)]:
            _scratches.remove(scratch)
            scratch.close()
        before = opened()
        out = function(spark, docs, sf_dir)
        _scratches.extend(s for s in opened() if s not in before)
        return out

    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality_repetition.keep_good(docs)


def _with_new_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs`` from an operator's (doc_id, text, n_removed, rest); emptied documents go."""
    size = F.length("text").cast("long")
    columns = []
    for name in docs.columns:
        if name == "doc_id" or name == "text":
            columns.append(F.col(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, size).otherwise(F.col("rest.`n_chars`")).alias(name))
        else:
            columns.append(F.col(f"rest.`{name}`").alias(name))
    return out.where("n_removed = 0 or text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'").select(*columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of nearly equal lines stays."""
    return _with_new_text(docs, fuzzy_lines.dedup_lines(spark, docs, carry=True))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    groups = chosen_path_join.near_dedup(spark, docs)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more stay where they stand first."""
    return _with_new_text(docs, substring_dedup.dedup_substrings(spark, docs, min_words=PASSAGE_WORDS, carry=True))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return best_fit_packing.pack_documents(spark, docs, public_tokenizers.path(PACKING_TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
