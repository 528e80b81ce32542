"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` applies them in order,
each written as Parquet in the shared folder and read again. All stages but the last return the columns of
``documents``; the last returns the index of the token files.

What a stage decides takes effect: rejected, duplicate and contaminated documents go; the mix repeats a document
as often as its source's target says, so one doc_id may come several times in the last two stages.

Defined results of odd input, in every stage:
* Null, empty and blank texts fail the quality rules. Fed to a later stage they are one near-duplicate group, are never contaminated, have no
  share in the mix, and are the end id alone as tokens.
* A null doc_id is a document like any other; documents that share an id are told apart by their texts. Null lang, source and n_chars pass through; a null
  source is a source of its own in the mix.
* Of repeated rows near-dedup keeps one; a tie between ids and texts goes to the smallest id, a known one before null.
* Texts are taken whole, whatever their length.
* Other columns pass through under any name, also names that differ by case only or that operators use themselves.
* Without labels only the base rule rejects; an empty benchmark leaves all; empty documents give an empty result.
* A document that quotes one benchmark window goes (``op7`` itself calls two items contaminated).
* The mix is made of whole documents: the one that the budget cuts comes once more if at least half of it is taken, so each source differs from
  op8's budget by less than a document.
"""

from __future__ import annotations

from tallyloom.llm import decontam, mixing, quality, simhash, token_ids
from tallyloom.llm.common import materialize, table


def quality_rules(spark, docs, sf_dir):
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    return simhash.first_of_each(docs)


def decontamination(spark, docs, sf_dir):
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark, docs, sf_dir):
    return mixing.copies(docs)


def token_output(spark, docs, sf_dir):
    return token_ids.read_index(token_ids.write_ids(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_ids", token_output),
]

#: XXH64 fingerprints, a learned decision list and a subword tokenizer have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
