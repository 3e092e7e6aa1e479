"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from ledgerkit.llm import decontaminate, exact_dedup, fill_middle, fingerprints, html_wrapper, jaccard_join, langid, line_dedup, packing, token_files, url_filter, warc_revisit, whitening
from ledgerkit.llm.common import table


def op1_char_lm_ratio(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_warc_revisit(spark, sf_dir):
    return warc_revisit.revisit_report(table(spark, sf_dir, "pages"))


def op3_block_naming_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op4_wrapper_extraction(spark, sf_dir):
    return html_wrapper.main_text(table(spark, sf_dir, "pages"))


def op5_context_mixing_coder(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_line_set_join(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_nearest_centroid_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bm25_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bottom_k_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_middle.fill_middle_report(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_char_lm_ratio": op1_char_lm_ratio,
    "op2_warc_revisit": op2_warc_revisit,
    "op3_block_naming_dedup": op3_block_naming_dedup,
    "op4_wrapper_extraction": op4_wrapper_extraction,
    "op5_context_mixing_coder": op5_context_mixing_coder,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_line_set_join": op8_line_set_join,
    "op9_nearest_centroid_langid": op9_nearest_centroid_langid,
    "op10_bm25_decontamination": op10_bm25_decontamination,
    "op11_bottom_k_fingerprints": op11_bottom_k_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {
    "op2_warc_revisit": warc_revisit.ORACLE_SQL,
    "op3_block_naming_dedup": exact_dedup.ORACLE_SQL,
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
}
