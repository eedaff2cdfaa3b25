"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import collocations, decontaminate, fingerprint, htmltext, importance, katz, linededup, mixing, neardup, quality, simhash, substrings, toxicity
from .common import table


def op7_mix_sources(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark, sf_dir):
    return linededup.digest(table(spark, sf_dir, "documents"))


def op5_fingerprint(spark, sf_dir):
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark, sf_dir):
    return neardup.components_of(table(spark, sf_dir, "documents"))


def op1_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark, sf_dir):
    return htmltext.digest(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op6_substring_dedup(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op3_katz_score(spark, sf_dir):
    return katz.digest(table(spark, sf_dir, "documents"))


def op11_simhash(spark, sf_dir):
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op13_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark, sf_dir):
    return collocations.digest(spark, sf_dir)


QUERIES = {"op12_collocations": op12_collocations, "op13_importance": op13_importance, "op11_simhash": op11_simhash, "op3_katz_score": op3_katz_score, "op6_substring_dedup": op6_substring_dedup, "pipeline": pipeline, "op9_html_text": op9_html_text, "op2_toxicity": op2_toxicity, "op1_quality": op1_quality, "op4_near_duplicates": op4_near_duplicates, "op5_fingerprint": op5_fingerprint, "op10_line_dedup": op10_line_dedup, "op7_mix_sources": op7_mix_sources, "op8_decontaminate": op8_decontaminate}
ORACLES = {"op12_collocations": collocations.ORACLE, "op6_substring_dedup": substrings.ORACLE, "op4_near_duplicates": neardup.ORACLE, "op10_line_dedup": linededup.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
