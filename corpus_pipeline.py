"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row the one before
it kept. All but the last return documents with their columns; each result
is written to the shared folder before the next stage reads it.
"""

from tidemark.llm import decontam, exact_dedup, ngram_join, packing, quality
from tidemark.llm.common import ready, staged, table

#: Model weights and alignments are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_classifier(spark, docs, sf_dir):
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    ready(spark)
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs, sf_dir):
    return ngram_join.one_of_each(docs)


def decontaminate(spark, docs, sf_dir):
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
