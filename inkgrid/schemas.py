"""Schemas of the engine's tables and messages; readers never infer."""

from __future__ import annotations

DOCUMENTS = "id string, tenant_id string, name string, description string, file_key string, file_size bigint, content_type string, checksum string, status string, created_at timestamp, updated_at timestamp"
LINES = "document_id string, line_no int, page int, text string"
UNITS = "document_id string, unit_no int, text string, start_page int, end_page int, tokens int"
METADATA = "struct<document_id:string, tenant_id:string, start_page:int, end_page:int, section_heading:string, language:string, parser_version:string, extraction_timestamp:timestamp, start_char_offset:int, end_char_offset:int, token_count:int, entities:array<string>, keywords:array<string>>"
CHUNKS = f"id string, document_id string, vector_id string, chunk_index int, content string, hash string, metadata {METADATA}, created_at timestamp"
VECTORS = "id string, hash string, embedding array<float>, model_version string, dimensions int, created_at timestamp"
EVENTS = "event_id string, event_type string, document_id string, tenant_id string, name string, file_key string, file_size bigint, content_type string, timestamp timestamp, traceparent string, tracestate string, _corrupt_record string"
DEAD_LETTERS = "event_id string, document_id string, file_key string, attempt_count bigint, error_reason string, failed_timestamp timestamp, raw_payload string"
STRUCTURE = "doc_id string, element_no int, type string, text string, section_heading string, heading_level int, line_number int"
