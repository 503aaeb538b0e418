"""Search index: the inverted index of a table of texts, written so that a search reads only the ranges of its words.

Every text is read whole and cut into words; lists of postings go to folders by first letter, in ranges of word and id, with one row
of statistics beside them. ``quillstone.operators.index`` searches the result (``StoredIndex``). A run replaces what an
earlier run has written, so a run that failed is simply run again.

    python -m jobs.search_index --documents DIR --target DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from quillstone import ship
from quillstone.operators.index import StoredIndex, token_table, write_index

NAME = "search_index"


def read_index(spark: SparkSession, target: str) -> StoredIndex:
    return StoredIndex(spark, target)


def claims(documents: DataFrame, config: dict) -> DataFrame:
    """(id, text, why, entities, refs) of each document; null texts and lists have no words, null entries of a list are left out."""
    fields = {c: F.expr(config[c]) for c in ("id", "text", "why", "entities", "refs")}
    lists = {c: F.coalesce(F.array_compact(fields[c]), F.array().cast("array<string>")) for c in ("entities", "refs")}
    return documents.select(*[(lists.get(c, fields[c])).alias(c) for c in fields])


def run(spark: SparkSession, documents: str, target: str, config: dict) -> dict:
    """Index all ``documents``; how many were read, and how many postings written. Ids must be unique."""
    ship(spark)
    texts = spark.read.parquet(documents)
    index = write_index(token_table(claims(texts, config), config["stemmed"]), target)
    done = {"documents": texts.count(), "postings": index.size}  # neither reads a text
    log.info("%s: read %d documents of %s, wrote %d postings to %s", NAME, done["documents"], documents, done["postings"], target)
    return done


if __name__ == "__main__":
    main(NAME, __doc__.split("\n")[0], run, {"documents": "folder of documents, Parquet", "target": "folder of the index"})
