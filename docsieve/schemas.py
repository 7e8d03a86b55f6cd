"""Types of the document-review tables."""

from __future__ import annotations

BLOCKS = "array<struct<text: string, page_number: int, block_index: int>>"
POSITION = "struct<block_start: int, block_end: int, page_start: int, page_end: int>"
FACT = f"struct<value: string, source_text: string, position: {POSITION}, extract_status: string, extract_method: string>"
CANDIDATE = f"struct<value: string, source_text: string, position: {POSITION}>"
HIT = (
    "struct<rule_id: bigint, rule_code: string, rule_name: string, risk_level: string, rule_version: string, evidence_text: string, "
    f"evidence_position: {POSITION}, evidence_type: string, actual_value: string, expected_value: string, hit_message: string, suggestion: string>"
)
RULES = "rule_id bigint, rule_code string, rule_name string, risk_level string, rule_status string, match_mode string, match_text string, suggestion_text string, rule_version string"
TASKS = "instance_id string, approval_code string, title string, applicant string, applied_at timestamp, task_status string, write_status string"

# fixed values: closed domains
RISK_WEIGHT = {"low": 1, "medium": 2, "high": 3}
TRANSITIONS = {"pending": ["parsing"], "parsing": ["reviewing", "blocked"], "reviewing": ["blocked", "done"], "blocked": ["parsing", "reviewing"], "done": []}
WORKFLOW_EVENTS = (
    "start_parsing", "start_reviewing", "block@parsing", "block@document_reading", "block@reviewing", "retry", "resume_for_ocr", "start_write", "complete_write", "fail_write", "block_write", "resume_writeback",
)
