"""One query per operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from corpus_pipeline import run
from firmloom.llm.checks import CHECKS
from firmloom.llm.common import table
from firmloom.llm.decontamination import decontaminate
from firmloom.llm.exact_dedup import exact_dedup
from firmloom.llm.hard_negatives import mine
from firmloom.llm.jaccard_join import jaccard_join
from firmloom.llm.language_model import train_and_score
from firmloom.llm.lexical_search import search
from firmloom.llm.mixing import mix
from firmloom.llm.pseudonyms import pseudonym_report, pseudonymise
from firmloom.llm.quality import quality_scores
from firmloom.llm.secrets import find_secrets, secret_report
from firmloom.llm.sharding import shard_rows
from firmloom.llm.simhash import simhash_groups
from firmloom.llm.warc import REPORT_FIELDS, assemble, capture_report, read_archive, write_archive

SHARDS = 16
KEY = b"firmloom"  # a deployment passes its own secret


def op1_feistel_pseudonyms(spark, sf_dir):
    return pseudonym_report(pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY))


def op2_secret_scan(spark, sf_dir):
    return secret_report(find_secrets(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc_transactions(spark, sf_dir):
    manifest = write_archive(table(spark, sf_dir, "pages"))
    return capture_report(assemble(read_archive(spark, manifest), REPORT_FIELDS))


def op6_rendezvous_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_weighted_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_kneser_ney_scores(spark, sf_dir):
    return train_and_score(table(spark, sf_dir, "documents"), order=3)


def op11_simhash_near_dedup(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark, sf_dir):
    return mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f for f in (
        op1_feistel_pseudonyms, op2_secret_scan, op3_ngram_jaccard_join, op4_exact_dedup, op5_warc_transactions, op6_rendezvous_sharding,
        op7_benchmark_decontamination, op8_weighted_mix, op9_quality_classifier, op10_kneser_ney_scores, op11_simhash_near_dedup,
        op12_lexical_search, op13_hard_negatives)
}
QUERIES["pipeline"] = run

__all__ = ["CHECKS", "QUERIES"]
