"""Explicit schemas of the review documents, as Spark DDL; nothing is inferred."""

from __future__ import annotations

USAGE = "STRUCT<input_tokens BIGINT, output_tokens BIGINT, tool_calls BIGINT, cost_usd DOUBLE>"
VALIDATION = "STRUCT<kind STRING, paths ARRAY<STRING>, description STRING>"
EVIDENCE = "STRUCT<file STRING, start_line INT, end_line INT, excerpt STRING>"

RUN = f"schema_version STRING, run_id STRING, case_id STRING, protocol_version STRING, created_at TIMESTAMP, sealed_at TIMESTAMP, status STRING, invalidation_reason STRING, stage_order ARRAY<STRING>, fingerprints STRUCT<protocol_hash STRING, engine_commit STRING, agent_config_hashes MAP<STRING,STRING>, schema_versions MAP<STRING,STRING>, prompt_hashes MAP<STRING,STRING>, adapter_versions MAP<STRING,STRING>, container_digests MAP<STRING,STRING>, input_checksums MAP<STRING,STRING>, bundle_schema_versions MAP<STRING,STRING>, tool_sets MAP<STRING,ARRAY<STRING>>, boundary_waivers ARRAY<STRING>>, stages ARRAY<STRUCT<stage STRING, adapter STRING, attempts INT, final_exit_code INT, started_at TIMESTAMP, finished_at TIMESTAMP, duration_ms BIGINT, vendor_duration_ms BIGINT, vendor_api_duration_ms BIGINT, usage {USAGE}, final_attempt_usage {USAGE}>>"
TELEMETRY = f"stage STRING, attempts ARRAY<STRUCT<attempt INT, error STRING, request STRUCT<budget STRUCT<max_input_tokens BIGINT, max_output_tokens BIGINT, max_tool_calls BIGINT, max_wall_clock_seconds BIGINT, max_cost_usd DOUBLE>>, result STRUCT<exit_code INT, started_at TIMESTAMP, finished_at TIMESTAMP, vendor_duration_ms BIGINT, vendor_api_duration_ms BIGINT, usage {USAGE}>>>"
EVENTS = "time TIMESTAMP, type STRING, stage STRING, attempt INT, detail STRING"
REVIEW_A = f"schema_version STRING, summary STRING, empty_reason STRING, findings ARRAY<STRUCT<id STRING, title STRING, description STRING, severity STRING, confidence DOUBLE, file STRING, line INT, mechanism STRING, class STRING, recommended_validation {VALIDATION}, evidence ARRAY<{EVIDENCE}>, uncertainty STRING>>"
REVIEW_B = f"schema_version STRING, assessments ARRAY<STRUCT<finding_id STRING, discovery_mechanism STRING, disposition STRING, mechanism STRING, rejection_reason STRING, causal_chain ARRAY<{EVIDENCE}>, recommended_validation {VALIDATION}, proposed_test STRING>>"
REVIEW_C = f"schema_version STRING, verdicts ARRAY<STRUCT<finding_id STRING, disposition STRING, rationale STRING, narrowed_description STRING, falsification_attempt {EVIDENCE}>>, new_findings ARRAY<STRUCT<id STRING, title STRING, description STRING, discovered_via STRING, severity STRING, confidence DOUBLE, evidence ARRAY<{EVIDENCE}>>>"
LABELS = "schema_version STRING, cohort_manifest_sha256 STRING, cases ARRAY<STRUCT<case_id STRING, label STRING, pair_id STRING, class STRING, followup_days INT, admission STRUCT<title STRING, description STRING>, subsystem STRING, match_key_used ARRAY<STRING>, fallback_pair BOOLEAN, source STRING, source_window STRING, fix_before_cutoff BOOLEAN>>"
HISTORY = "schema_version STRING, case_id STRING, risky BOOLEAN, reason STRING, score DOUBLE, subsystem STRING, tercile INT, rule MAP<STRING,STRING>"
FIXING_PATHS = "schema_version STRING, case_id STRING, paths ARRAY<STRING>"
KEYS = "schema_version STRING, case_id STRING, fixing_shas ARRAY<STRING>, fixing_pr_numbers ARRAY<INT>, cve_ids ARRAY<STRING>, discussion ARRAY<STRUCT<source STRING, body STRING>>"
ORACLE = "schema_version STRING, original STRUCT<number INT, repository STRING>, stateful STRUCT<score DOUBLE, category STRING, matched_symbols ARRAY<STRING>>, retrospective STRUCT<summary_rank_score DOUBLE, strong_signals ARRAY<STRUCT<signal_type STRING, source_ref STRING, confidence DOUBLE, changed_paths ARRAY<STRING>>>, medium_signals ARRAY<STRUCT<signal_type STRING, source_ref STRING, function_or_path STRING, changed_paths ARRAY<STRING>>>, weak_signals ARRAY<STRUCT<signal_type STRING, source_ref STRING, file_path STRING>>, reversal STRUCT<reversal_type STRING, path_overlaps ARRAY<STRUCT<path STRING, lineage_supported_removed_overlap_count INT>>>>"
JUDGE = "schema_version STRING, case_id STRING, judge_model STRING, in_family BOOLEAN, verdicts MAP<STRING, STRUCT<arm STRING, run_id STRING, finding_id STRING, opaque_id STRING, agreement STRING, fix_id STRING, rationale STRING>>"
VERIFY = "unit STRUCT<case_id STRING, arm STRING, run_id STRING, finding_id STRING, severity STRING, mechanism STRING, file STRING, rank INT>, disposition STRING, unparseable_first_response BOOLEAN, error STRING"
PROBE = "schema_version STRING, case_id STRING, void BOOLEAN, responses ARRAY<STRUCT<probe STRING, answer STRING, model STRING, cost_usd_estimate DOUBLE, error STRING>>"
GATE = "schema_version STRING, records_sha256 STRING, cases MAP<STRING,STRING>"
