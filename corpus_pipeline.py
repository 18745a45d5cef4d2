"""Corpus preparation: five stages over ``documents``.

Each stage takes what the one before it kept, written as Parquet and read again;
all but the last return the columns of ``documents``:

1. *toxicity*: documents whose score reaches 0.7 go;
2. *line_dedup*: later copies of repeated passages are cut out of the texts; what makes a document a copy of
   another one as a whole stays, so that the next stage finds them alike and doesn't meet their empty rests;
3. *near_dedup*: of each class of near copies the document with the smallest id stays;
4. *decontamination*: documents that hold a passage of ``benchmark`` go;
5. *packing*: the rest is tokenized and packed into sequences.

Defined cases are those of the operators; an empty table gives an empty result.
"""
from __future__ import annotations

from harrow.llm.common import read, staged
from harrow.llm.decontaminate import drop_leaks
from harrow.llm.linededup import dedup_lines
from harrow.llm.minhash import drop_near_duplicates
from harrow.llm.packing import packed
from harrow.llm.toxicity import reject_toxic


#: Share of equal words at which two documents of one length have the next stage's similarity of 0.8.
COPIES = 8 / 9


def toxicity(spark, docs, sf_dir):
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    return dedup_lines(docs, copies=COPIES)


def near_dedup(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    return packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: The grammar's learnt weights, chunk hashes and tokens have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages in turn to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
