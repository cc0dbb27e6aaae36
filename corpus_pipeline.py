"""A training set from raw documents, in five stages.

Each stage gets the whole of what the stage before it kept.  All but the last
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import mixing, near_dup, packing, quality_classifier, substring_dedup
from tracklake.llm.common import materialise
from tracklake.llm.queries import WORD_BPE, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are.

    Null and empty texts are scored by their shape; repeated rows fare alike;
    without labels of two grades, and on an empty table, nothing goes.
    """
    model = quality_classifier.train(docs, quality_classifier.ratings(table(spark, sf_dir, "labels")))
    return quality_classifier.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, as it is; that with the smallest id, null ids last.

    Rows are told by id and text, so a row whose id stands beside another text
    fares by its own text; texts without words go only if they repeat under
    one id; an empty table stays empty.
    """
    return near_dup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; emptied ones go.

    Null texts and those that were empty before stay; of rows equal in id and
    text, all are cut alike.
    """
    cut = substring_dedup.without_passages(docs, substring_dedup.repeated_passages(docs))
    # what was empty before has no passage; only a cut can leave a text blank
    return cut.where(F.col("text").isNull() | (F.length("text") == 0) | F.col("text").rlike(r"\S"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask; none is dropped.

    Null and empty texts have no tokens and stay by their rate of 1 or more;
    without labels all domains are equally likely for every text.
    """
    mixed = mixing.mix(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), least=1.0)
    return mixing.apply_copies(docs, mixed.rows)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in the packed sequences.

    A null or empty text is one piece with the end id alone; repeated rows are
    packed each; an empty table gives no piece.
    """
    pieces = packing.token_pieces(docs, WORD_BPE)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express these stages. Near duplicates are tested against brute force, the
#: classifier on held-out rows, the others and the whole on small cases and invariants only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
