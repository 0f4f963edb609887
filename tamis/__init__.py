"""Table profiling, quality and privacy as Spark jobs."""

from tamis.operators.cleaning import CleaningAction, replay, rows_affected
from tamis.operators.privacy import (
    Detection, detect, detections, extend_vault, leak_audit, leaks, mask, masking_summary, pseudonymise,
    tokens, vault_mapping,
)
from tamis.operators.profile import approximate, column_profiles, context, measure, profile, profile_from
from tamis.sources.loader import Refused, load

__all__ = [
    "CleaningAction", "Detection", "Refused", "approximate", "column_profiles", "context", "detect", "detections",
    "extend_vault", "leak_audit", "leaks", "load", "mask", "masking_summary", "measure", "profile",
    "profile_from", "pseudonymise", "replay", "rows_affected", "tokens", "vault_mapping",
]
