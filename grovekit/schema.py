"""Schemas of the engine's tables (DDL strings)."""

CHUNK = "hash_code string, text string, doc_id bigint, chunk_index int"
EVIDENCE_CHUNK = "hash_code string, text string, modality string, page int, asset_path string, summary string, source_pdf string, chunk_order_index int"
MM_CHUNK = "chunk_id string, hash_code string, doc_id string, text string, modality string, page_start int, page_end int, section_title string, source_path string, bbox array<double>, order int, attached_media_ids array<string>"
MM_MEDIA = (
    "media_id string, doc_id string, modality string, page int, path string, caption string, ocr_text string, summary string, table_html string, table_markdown string, "
    "bbox array<double>, nearby_chunk_ids array<string>, attached_entity_names array<string>, attach_scores map<string, double>"
)
TRIPLE = "head string, relation string, tail string, doc_name string, source_id string"
DESCRIBED_TRIPLE = "head string, head_desc string, head_type string, relation string, relation_desc string, tail string, tail_desc string, tail_type string"
ENTITY = "entity_name string, entity_type string, description string, source_ids array<string>, degree int"
RELATION = "src string, dst string, description string, weight int, source_id string"
LEVELED_NODE = "entity_name string, description string, source_ids array<string>, degree int, embedding array<float>, level int, parent string"
AGGREGATE_RELATION = "src string, dst string, description string, weight int, level int"
COMMUNITY = "entity_name string, entity_description string, findings array<struct<summary: string, explanation: string>>, level int, children array<string>, source_id string"
ENTITY_MEDIA = "entity_name string, media_ids array<string>"
QA = "doc_id string, pdf_path string, question_id string, question string, answer string, metadata map<string, string>"
PREDICTION = (
    "doc_id string, question_id string, question string, gold_answer string, prediction string, text_evidence array<struct<page: int, page_start: int, page_end: int>>, "
    "visual_evidence array<struct<page: int, page_start: int, page_end: int>>, table_evidence array<struct<page: int, page_start: int, page_end: int>>, trace_error string"
)
MANIFEST = "doc_id string, graph_status string, qa_count int, reused boolean"
TRIPLE_SCORE = "score double, rationale string"
JUDGED = "map<string, struct<score: double, explanation: string>>"
