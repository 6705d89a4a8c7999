"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from granary.llm import ann, chat, decontaminate, filter_audit, html_text, language, mixing, neardup, passages, quality, repair, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_warc": warc.op3_warc,
    "op4_passages": passages.op4_passages,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_nearest": ann.op6_nearest,
    "op7_html": html_text.op7_html,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_neardup": neardup.op10_neardup,
    "op11_repair": repair.op11_repair,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_language": language.op13_language,
    "pipeline": corpus_pipeline.run,
}
#: No SQL for op2, op9 and op13 (trained models), op4, op6 and op10 (searches whose brute force is too slow in SQL on whole
#: tables), op7 (an extractor) and the pipeline: their tests hold them against held-out rows, brute force and marked articles.
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_repair": repair.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
