"""Schemas of the entities that files bring in."""

from __future__ import annotations

MANIFEST = "item_id string, source_path string, display_name_zh string, category string, has_text_expected boolean, review_status string, source string, source_file_name string, source_format string, source_group_id string, page_number int, page_count int, search_enabled boolean"
OCR_PAYLOAD = "item_id string, rec_texts array<string>, rec_scores array<double>"
OCR_SUMMARY = "item_id string, display_name_zh string, category string, source_path string, status string, text_box_count int, character_count int, mean_confidence double, min_confidence double, elapsed_seconds double, error string"
CHUNK = "chunk_id string, item_id string, display_name_zh string, category string, source_path string, box_start int, box_end int, mean_ocr_confidence double, text string"
QUERY = "query_id string, query string, expected_item_id string, relevant_item_ids string, query_type string, split string, is_no_answer string, review_status string"
SCORES = "query string, branch string, library_revision string, item_ids array<string>, scores array<double>"
JUDGMENT = "query_id string, task_id string, split string, reviewer_id string, reviewer_type string, candidate_relevance map<string,boolean>, confidence string"
