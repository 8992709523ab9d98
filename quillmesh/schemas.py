"""Explicit schemas of the documents and of what the stages hand on."""

LAYOUT = "STRUCT<layout_id INT, page_id INT, modality STRING, text STRING, ocr_text STRING, vlm_text STRING, caption STRING, topic STRING, image_path STRING>"
CORPUS = f"doc_id INT, doc_name STRING, layouts ARRAY<{LAYOUT}>"
TRACE = "ARRAY<STRUCT<hop INT, source_modality STRING, source_page INT, source_layout INT, sub_question STRING, result STRING>>"
EVIDENCE = "ARRAY<STRUCT<modality STRING, layout_id INT, page_id INT>>"
POINTS = "ARRAY<STRUCT<fact_id STRING, source_layout INT, source_page INT, source_modality STRING, fact STRING, data_points ARRAY<STRING>>>"
BENCHMARK = (
    "doc_id INT, mh_id STRING, sq_id STRING, sh_id STRING, question_type STRING, question STRING, final_answer STRING, "
    f"answer STRUCT<evidence_points {POINTS}, synthesis_conclusion STRING, key_data_cited ARRAY<STRING>>, "
    f"bridge_entities ARRAY<STRING>, hop_path STRING, num_hops INT, cross_modal BOOLEAN, reasoning_trace {TRACE}, evidence_sources {EVIDENCE}"
)
ANSWERS = (
    "results ARRAY<STRUCT<question_id STRING, query STRING, response STRING, retrieved_context STRING, gt_answer STRING, "
    "question_type STRING, modality_type STRING, num_hops INT, assigned_type STRING, hop_path STRING>>"
)
