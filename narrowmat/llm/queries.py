"""The thin queries ``(spark, folder) -> DataFrame`` over the text operators."""

from __future__ import annotations

import public_tokenizers

from narrowmat.llm import (
    bpe, decontamination, exact_dedup, filter_audit, importance, language, licenses, lm, mixing, near_dedup, neighbours, rans, warc,
)
from narrowmat.llm.common import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark, sf_dir):
    return warc.captures(table(spark, sf_dir, "pages"))


@query
def op3_rans(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return rans.write_and_read(table(spark, sf_dir, "documents"), path)


@query
def op6_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(table(spark, sf_dir, "documents"), path)


@query
def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op10_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_importance(spark, sf_dir):
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
