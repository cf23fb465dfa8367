"""Queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from modelgraph.llm import bpe, decontaminate, fillmiddle, filteraudit, langid, lattice, lmscore, minhash, pii, quality, suffixes, tokenfiles, warc

QUERIES = {
    "op1_revisit_resolution": warc.op1_revisit_resolution,
    "op2_cross_entropy_difference": lmscore.op2_cross_entropy_difference,
    "op3_lattice_near_duplicates": lattice.op3_lattice_near_duplicates,
    "op4_template_contamination": decontaminate.op4_template_contamination,
    "op5_pii_boosting": pii.op5_pii_boosting,
    "op6_bpe_prefix": bpe.op6_bpe_prefix,
    "op7_language_unigrams": langid.op7_language_unigrams,
    "op8_minhash_near_duplicates": minhash.op8_minhash_near_duplicates,
    "op9_suffix_sort_dedup": suffixes.op9_suffix_sort_dedup,
    "op10_quality_neighbours": quality.op10_quality_neighbours,
    "op11_fill_in_middle": fillmiddle.op11_fill_in_middle,
    "op12_filter_audit": filteraudit.op12_filter_audit,
    "op13_token_files": tokenfiles.op13_token_files,
}

ORACLES = {
    "op1_revisit_resolution": warc.OP1_SQL,
    "op2_cross_entropy_difference": lmscore.OP2_SQL,
    "op4_template_contamination": decontaminate.OP4_SQL,
    "op11_fill_in_middle": fillmiddle.OP11_SQL,
    "op12_filter_audit": filteraudit.OP12_SQL,
}
