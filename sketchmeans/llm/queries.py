"""The queries by name, and DuckDB SQL for those that SQL can express."""

from sketchmeans.llm import chat_format, decontaminate, importance, infill, language_model, line_dedup, minhash, mixing, quality, substring_dedup, suffix_array, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_language_model": language_model.op7_language_model,
    "op8_near_dedup": minhash.op8_near_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_warc": warc.op10_warc,
    "op11_importance": importance.op11_importance,
    "op12_suffix_dedup": suffix_array.op12_suffix_dedup,
    "op13_infill": infill.op13_infill,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op8_near_dedup": minhash.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_suffix_dedup": suffix_array.ORACLE,
    "op13_infill": infill.ORACLE,
}
