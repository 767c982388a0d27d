"""The corpus pipeline: quality classifier, near-dedup, decontamination, PII redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of docs, whatever others docs has.

Cases, of every stage: null texts count as empty and stay null, null ids are rows like others; repeated rows are rows of their own (but for near-dedup, where they are copies); an empty table
gives an empty one; texts of any length are read whole; extra columns pass through whatever they are called, but for the last stage, which has columns of its own. Ties are the operators': see their modules.
"""

from __future__ import annotations

from haystrata.llm import decontaminate, mixing, pii, quality_classifier, simhash_vptree
from haystrata.llm.common import clear_staged, staged, staged_paths, table


def classify(spark, docs, sf_dir):
    """Documents that the ordinal classifier rejects go. It is fitted on the labelled rows of docs."""
    return quality_classifier.select_quality(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return simhash_vptree.one_of_each(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark, docs, sf_dir):
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def mixed(spark, docs, sf_dir):
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mixing.mix_sources(docs)


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", dedup), ("decontamination", decontaminated), ("pii", redacted), ("source_mixing", mixed)]

#: Fitted models and chance decide rows, so SQL cannot express the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What a stage has staged goes when the next one's input is written, so one copy of the corpus stays at a time."""
    docs = table(spark, sf_dir, "documents")
    since = len(staged_paths(spark))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
            clear_staged(spark, since, (staged_paths(spark)[-1],))
    return docs
