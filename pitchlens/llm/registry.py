"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pitchlens.llm import op1_licenses, op10_rollup, op11_toxicity, op12_spelling, op13_manifest, op2_pack, op3_lines, op4_near, op5_quality, op6_suffixes, op7_hmm, op8_simhash, op9_decontaminate


def queries() -> dict:
    found = [op1_licenses.op1_license_scan, op2_pack.op2_pack, op3_lines.op3_line_dedup, op4_near.op4_near_dedup, op5_quality.op5_quality, op6_suffixes.op6_suffix_dedup, op7_hmm.op7_hmm_score, op8_simhash.op8_simhash, op9_decontaminate.op9_decontaminate, op10_rollup.op10_token_counts,
             op11_toxicity.op11_toxicity, op12_spelling.op12_spelling_variants, op13_manifest.op13_merkle_manifest]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op1_license_scan": op1_licenses.oracle(), "op3_line_dedup": op3_lines.ORACLE, "op9_decontaminate": op9_decontaminate.ORACLE,
            "op12_spelling_variants": op12_spelling.ORACLE, "op13_merkle_manifest": op13_manifest.oracle()}
