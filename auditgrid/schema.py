"""Schemas of the audit engine's tables."""

from __future__ import annotations

FILES_DDL = "file_id long, repo string, relative_path string, content string"
#: A finding before enrichment. finding_ord orders the findings of one rule in one file.
FINDINGS_DDL = "file_id long, repo string, relative_path string, rule_id string, severity string, message string, line int, evidence string, finding_ord long"
#: What an expression on one file finds.
FOUND_DDL = "array<struct<rule_id:string,severity:string,message:string,line:int,evidence:string,finding_ord:bigint>>"
KEYS = ("file_id", "repo", "relative_path")
EVIDENCE_CHARS = 120
