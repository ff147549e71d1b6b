"""Registered queries of this subpackage and their DuckDB statements."""

from reviewlake.llm import align, chat, decontaminate, language, lines, mixing, pages, personal, quality, repair, secret_scan, simhash, substrings

QUERIES = {
    "op1_mix": mixing.op1_mix, "op2_language": language.op2_language, "op3_lines": lines.op3_lines, "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate, "op6_html": pages.op6_html, "op7_secrets": secret_scan.op7_secrets,
    "op8_chat": chat.op8_chat, "op9_simhash": simhash.op9_simhash, "op10_substrings": substrings.op10_substrings,
    "op11_personal": personal.op11_personal, "op12_align": align.op12_align, "op13_repair": repair.op13_repair,
}
ORACLE = {"op3_lines": lines.OP3_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op8_chat": chat.OP8_SQL,
          "op11_personal": personal.OP11_SQL, "op13_repair": repair.OP13_SQL}
