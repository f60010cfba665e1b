"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import exact_dedup, language, licenses, mixing, pieces, quality_model, quality_rules, simhash, suffix_dedup, token_files

QUERIES = {
    f.__name__: f
    for f in (
        quality_model.op1_quality_model, mixing.op2_mixing, token_files.op3_token_files, licenses.op4_licenses, exact_dedup.op5_exact_dedup,
        quality_rules.op6_quality_rules, language.op7_language, pieces.op8_pieces, simhash.op9_simhash, suffix_dedup.op10_suffix_dedup,
    )
}
ORACLES = {"op2_mixing": mixing.ORACLE, "op4_licenses": licenses.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op6_quality_rules": quality_rules.ORACLE}
