"""The queries of this package and their SQL."""

from corpusmill.llm import decontamination, html_extraction, license_scan, merkle, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, url_filters, vector_codes, warc_zip

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "quality_rule_ablation": quality_rules.quality_rule_ablation,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_token_packing": packing.op8_token_packing,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_warc_zip": warc_zip.op10_warc_zip,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_vector_code_compression": vector_codes.op13_vector_code_compression,
}
SQL = {
    "op5_mix_sources": mixing.OP5_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "quality_rule_ablation": quality_rules.ABLATION_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op10_warc_zip": warc_zip.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_vector_code_compression": vector_codes.OP13_SQL,
}
