"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import bpe, exact, mixing, neardup, toxicity
from quaymark.llm.common import remove, shared_folder, table
from quaymark.llm.queries import vocabulary
from quaymark.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or over 0.7 go; all columns stay as they are.

    A null or empty text gets the score of a text without words, a text of any length is read whole; equal texts and repeated
    rows share their fate; null ids are scored like others.  Without labels of both kinds nothing is known and nothing goes.
    An empty table gives an empty one; a column called score is kept as it is.
    """
    net = toxicity.learn(docs, table(ship(spark), sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"
    return toxicity.score(docs, net, to=score).filter(toxicity.predicted(score) == 0).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest, then the one with the smallest id stays; all columns stay.

    Null, empty and white-space texts are one group; a null id comes after all others; of repeated rows one stays; texts of
    any length are compared whole.  An empty table gives an empty one; other columns may have any names.
    """
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity from 0.8) the smallest id stays; all columns stay.

    Texts without words are near to nothing and stay, and so do rows without an id; rows that share an id stay or go together; texts
    of any length are read whole; ids are distinct, so there are no ties.  An empty table gives an empty one; other columns may have any names.
    """
    ship(spark)
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come zero, one or two times, so that sources meet their target weights; all columns stay.

    A null source is one of its own; a null or empty text has no words and comes or goes by its place alone; rows equal in id and text have
    one place, so ties and repeated rows come equally often; texts of any length are counted whole.  An empty table gives an empty one; other
    columns may have any names.
    """
    return mixing.mix_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, with doc_id, lang and source.

    A null or empty text has no ids and decodes to an empty text; a text of any length is encoded whole; repeated rows are encoded alike, and
    null ids, languages and sources pass.  An empty table gives an empty one; other columns of any name are ignored.
    """
    ship(spark)
    own = docs.select("doc_id", "lang", "source", "text")
    return bpe.round_trip(own, vocabulary(), keep_text=False).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A trained classifier decides in the first stage, so SQL cannot express the result; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder of the session.

    A stage's table goes once the next one is written; the last one stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, written = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        written.append(f"{folder}/{k}-{name}")
        out.write.parquet(written[-1])
        docs = spark.read.parquet(written[-1])
        if k:
            remove(spark, written[-2])
    return docs
