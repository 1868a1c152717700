"""From raw documents to packed sequences: quality, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import mixing, packing, pii, quality, similar
from folio.llm.common import table, written
from folio.llm.tokens import load, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, doesn't reject.

    Null, empty and blank texts are scored as one passage without words; very long texts by all their
    passages. Repeated rows are kept or go together. Columns stay, whatever their names; an
    empty table stays empty, and without labels all documents stay.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of 0.8 or more of five-word shingles.

    Texts without words, null ones too, are one group. Of a group the smallest doc_id stays, a null
    one only where there is no other; repeated rows are one. Long texts are compared whole. Columns
    stay, whatever their names; an empty table stays empty.
    """
    return similar.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked.

    Null and empty texts stay as they are, and so do repeated rows and ties; long texts are matched
    whole. n_chars follows the text; other columns stay, whatever their names; an empty table stays
    empty.
    """
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated or cut as it takes them.

    Documents without words, null ones too, go, as no word of them is taken. A null source is a
    source, the last one; ties of the seeded order go by doc_id and size; a long text may be cut like
    any other. n_chars follows the text; other columns stay, whatever their names; an empty table
    stays empty.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Each row is a document of its own, with repeated and null doc_ids too; null and empty texts are
    their end id. Long texts fill windows of their own. Other columns aren't read; an empty table has
    no pieces.
    """
    return packing.pack(docs, load(vocabulary(VOCABULARY)), END_ID)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the library's token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
