"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from sigmill.llm import decontaminate, html, jaccard, languages, lexical, licenses, lm, negatives, packing, quality, substrings, tokens, urls


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_lm": lm.op2_lm,
        "op3_html": html.op3_html,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_token_files": tokens.op5_token_files,
        "op6_quality": quality.op6_quality,
        "op7_pack": packing.op7_pack,
        "op8_urls": urls.op8_urls,
        "op9_licenses": licenses.op9_licenses,
        "op10_language": languages.op10_language,
        "op11_negatives": negatives.op11_negatives,
        "op12_lexical": lexical.op12_lexical,
        "op13_substrings": substrings.op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE_SQL, "op4_jaccard": jaccard.ORACLE_SQL, "op6_quality": quality.ORACLE_SQL, "op11_negatives": negatives.ORACLE_SQL, "op12_lexical": lexical.ORACLE_SQL, "op13_substrings": substrings.ORACLE_SQL}
