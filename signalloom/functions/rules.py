"""Fixed values of the domain: keyword rules, lookup tables, decision texts.

Everything in this module is data.  The values are fixed by the results the
engine has to produce; the expressions that use them live elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple


class EvidenceRule(NamedTuple):
    category: str
    keywords: tuple[str, ...]
    evidence_type: str
    value: str | None  # None: taken from the row text
    confidence: float
    layer: str | None
    severity: str
    event_code: str | None = None
    metric: str | None = None


# Evidence rules in priority order, matched on the lower-cased text.
EVIDENCE_RULES = [
    EvidenceRule("plmn_not_allowed", ("plmn not allowed",), "mobility_management",
                 "PLMN not allowed", 0.98, "MM", "high", event_code="11"),
    EvidenceRule("location_update_failed", ("locationupdate failed", "location update failed"),
                 "mobility_management", None, 0.95, "MM", "high"),
    EvidenceRule("location_update_reject", ("mm location updating reject",), "mobility_management",
                 "MM Location updating reject", 0.95, "MM", "high"),
    EvidenceRule("location_update_request", ("mm location updating request",), "mobility_management",
                 "MM Location updating request", 0.90, "MM", "info"),
    EvidenceRule("registration_denied", ("registration denied",), "mobility_management",
                 "registration denied", 0.95, "MM", "high"),
    EvidenceRule("nas_registered", ("nasregistered",), "network_state",
                 "NASRegistered", 0.85, "NAS", "info"),
    EvidenceRule("nas_not_registered", ("nasnotregistered",), "network_state",
                 "NASNotRegistered", 0.90, "NAS", "medium"),
    EvidenceRule("ps_attached", ("psattachstate attached", "psattached"), "network_state",
                 "PSAttached", 0.85, "NAS", "info"),
    EvidenceRule("detached", ("detached",), "network_state",
                 "Detached", 0.80, "NAS", "medium"),
    EvidenceRule("timeout", ("timeout",), "timing",
                 "timeout", 0.85, None, "medium", metric="timeout"),
    EvidenceRule("retry_detected", ("retry", "retransmission"), "retry",
                 "retry", 0.80, None, "medium", metric="retry_count"),
    EvidenceRule("failure_signal", ("fail",), "failure", None, 0.80, None, "medium"),
    EvidenceRule("reject_signal", ("reject",), "rejection", None, 0.80, None, "medium"),
]

# Assignment keys looked for in trace rows, in priority order.
BASE_VALUE_KEYS = [
    ("PTC_A.Country", "country"),
    ("PTC_A.Location", "location"),
    ("PTC_A.Plmn", "operator"),
    ("PTC_A.Imsi", "imsi"),
    ("PTC_A.Msisdn", "msisdn"),
    ("PTC_A.ResourceType", "resource_type"),
    ("PTC_A.ResourceModes", "resource_modes"),
    ("PTC_A.ResourceOptions", "resource_options"),
    ("PtcStartTimestamp", "ptc_start_timestamp"),
    ("TestExecutionStartTime", "test_execution_start_time"),
]

# Signal labels in output order; a label applies when any keyword
# occurs in the lower-cased line.
SIGNAL_KEYWORDS = [
    ("failure", ("fail",)),
    ("error", ("error", "exception")),
    ("timeout", ("timeout", "timed out")),
    ("retry", ("retry", "retransmission")),
    ("detach", ("detach",)),
    ("attach", ("attach",)),
    ("registration", ("registration", "register")),
    ("authentication", ("auth",)),
    ("paging", ("paging",)),
    ("reject", ("reject",)),
    ("disconnect", ("disconnect",)),
    ("release", ("release",)),
    ("sms", ("sms",)),
    ("call", ("call", "voice")),
    ("volte", ("volte", "ims")),
]

# Event name per evidence category where it is not the upper-cased category.
RENAMED_EVENTS = {
    "location_update_reject": "MM_LOCATION_UPDATE_REJECT",
    "location_update_request": "MM_LOCATION_UPDATE_REQUEST",
}

# Event family per evidence type; anything else is generic.
FAMILY_OF_TYPE = {
    "mobility_management": "mobility_management",
    "network_state": "network_state",
    "retry": "retry",
    "timing": "timing",
    "failure": "failure",
    "rejection": "failure",
}

# Severity set by category; anything else keeps its own severity.
SEVERITY_OF_CATEGORY = {
    "high": ("plmn_not_allowed", "location_update_failed", "location_update_reject",
             "registration_denied"),
    "medium": ("timeout", "retry_detected", "nas_not_registered", "detached",
               "failure_signal", "reject_signal"),
}

# Cause per category.
CAUSE_OF_CATEGORY = {
    "plmn_not_allowed": "PLMN_NOT_ALLOWED",
    "location_update_failed": "LOCATION_UPDATE_FAILED",
    "location_update_reject": "LOCATION_UPDATE_REJECT",
    "registration_denied": "REGISTRATION_DENIED",
    "timeout": "TIMEOUT",
    "retry_detected": "RETRY",
    "nas_not_registered": "NAS_NOT_REGISTERED",
    "detached": "DETACHED",
}

# Workflow stage by category; anything else is trace_analysis.
STAGE_OF_CATEGORY = {
    "mobility_management": ("location_update_request", "location_update_reject",
                            "location_update_failed", "plmn_not_allowed", "registration_denied"),
    "network_registration": ("nas_registered", "nas_not_registered", "ps_attached", "detached"),
    "stability_or_retry": ("timeout", "retry_detected"),
}

# Result by category.
RESULT_OF_CATEGORY = {
    "failed": ("plmn_not_allowed", "location_update_failed", "location_update_reject",
               "registration_denied", "timeout", "failure_signal", "reject_signal"),
    "observed": ("nas_registered", "ps_attached", "location_update_request"),
}

ROAMING_TYPES = ("mobility_management", "network_state")
CONNECTIVITY_CATEGORIES = ("timeout", "retry_detected")
RETRYABLE_CATEGORIES = ("timeout", "retry_detected", "nas_not_registered", "detached")

# Recommendation text by category.
RECOMMENDATION_OF_CATEGORY = {
    "Check HPLMN/VPLMN roaming agreement, SIM profile and PLMN authorization.":
        ("plmn_not_allowed",),
    "Review MM location update flow, reject cause, HPLMN/VPLMN configuration and operator restrictions.":
        ("location_update_failed", "location_update_reject", "registration_denied"),
    "Check network stability, timeout thresholds, radio state and transport delays.":
        ("timeout",),
    "Compare retry count with historical successful retries before escalation.":
        ("retry_detected",),
    "Check registration state, attach state and radio/network availability.":
        ("nas_not_registered", "detached"),
}

# Tokens that make a raw line important to an investigator.
IMPORTANT_TOKENS = ("fail", "reject", "timeout", "retry", "notregistered", "detached", "plmn",
                    "locationupdate")

# Test-id prefix that marks the standard template and campaign.
STANDARD_PREFIX = "350"
STANDARD_TEMPLATE = "IR38_3_3_1"
STANDARD_CAMPAIGN = "GSMA_IR38"
