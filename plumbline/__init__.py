"""Check, repair and audit tables of any size with Spark."""

from plumbline.config import FairnessConfig, QualityConfig
from plumbline.functions.storage import scratch
from plumbline.operators.repair import Fix, Repaired, apply_fixes
from plumbline.operators.scoring import score_proxy
from plumbline.operators.sensitive import detect_sensitive, prepare_sensitive
from plumbline.plans.audit import AuditReport, audit, audit_table
from plumbline.plans.remediate import propose_plan, remediate, revalidate
from plumbline.plans.safe import SafePlan, propose_safe_plan
from plumbline.plans.validate import ValidationReport, validate, validate_file
from plumbline.sources.readers import read_csv, read_table
from plumbline.sources.writers import write_report, write_table

__all__ = [
    "AuditReport", "FairnessConfig", "Fix", "QualityConfig", "Repaired", "SafePlan",
    "ValidationReport",
    "apply_fixes", "audit", "audit_table", "detect_sensitive", "prepare_sensitive",
    "propose_plan", "propose_safe_plan", "read_csv", "read_table", "remediate", "revalidate", "score_proxy",
    "scratch",     "validate", "validate_file", "write_report", "write_table",
]
