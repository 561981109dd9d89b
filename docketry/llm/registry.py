"""The queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from docketry.llm import chat, decontam, fingerprint, html_text, langid, line_dedup, mixing, phrases, secrets, simhash, suffix_dedup, variants, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_decontaminate": decontam.op2_decontaminate,
        "op3_language_id": langid.op3_language_id,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_html_extract": html_text.op5_html_extract,
        "op6_warc": warc.op6_warc,
        "op7_winnow": fingerprint.op7_winnow,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_mixing": mixing.op10_mixing,
        "op11_chat_format": chat.op11_chat_format,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontam.ORACLE,
        "op4_secret_scan": secrets.ORACLE,
        "op6_warc": warc.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op10_mixing": mixing.ORACLE,
        "op11_chat_format": chat.ORACLE,
        "op13_phrases": phrases.ORACLE,
    }
