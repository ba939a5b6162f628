"""Named policies.

FIXED VALUES: names, blocked types, pass-through types, modes and warning tiers.
Descriptions are our own wording.
"""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("mask", "redact", "pseudonymize", "exclude")

ACTION_OF_MODE = {
    "mask": "masked",
    "redact": "redacted",
    "pseudonymize": "pseudonymized",
    "exclude": "excluded",
}


@dataclass(frozen=True)
class Policy:
    name: str
    description: str
    block: tuple[str, ...]
    pass_through: tuple[str, ...]
    mode: str
    warn_at: str
    exclude_any: bool = False


POLICIES = {p.name: p for p in [
    Policy("ai_prompt", "Text bound for a generative model: mask identifiers, stop on critical ones.",
           ("US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "US_DRIVER_LICENSE",
            "IBAN_CODE", "FINANCIAL_ACCOUNT", "IMMIGRATION_STATUS", "CRYPTO"),
           ("DATE_TIME", "URL", "IP_ADDRESS"), "mask", "HIGH"),
    Policy("embedding", "Text bound for a vector index: pseudonymize, stop on protected markers.",
           ("US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "IBAN_CODE",
            "FINANCIAL_ACCOUNT", "IMMIGRATION_STATUS", "DISABILITY_ACCOMMODATION",
            "FERPA_MARKER", "HIPAA_MARKER", "FAFSA_ID"),
           ("DATE_TIME", "URL"), "pseudonymize", "MEDIUM"),
    Policy("log_safe", "Application logs: remove every identifier, stop on none.",
           (), (), "redact", "LOW"),
    Policy("export_internal", "Reports that stay inside the institution.",
           ("US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "IBAN_CODE",
            "FINANCIAL_ACCOUNT", "IMMIGRATION_STATUS"),
           ("INSTITUTION_EMAIL", "DATE_TIME", "URL"), "mask", "HIGH"),
    Policy("export_external", "Data leaving the institution: stop on direct identifiers.",
           ("US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "US_DRIVER_LICENSE",
            "IBAN_CODE", "FINANCIAL_ACCOUNT", "IMMIGRATION_STATUS", "DISABILITY_ACCOMMODATION",
            "VETERAN_STATUS", "EMAIL_ADDRESS", "INSTITUTION_EMAIL", "PHONE_NUMBER", "STUDENT_ID",
            "COLLEAGUE_ID", "BANNER_ID", "DATE_OF_BIRTH", "FAFSA_ID", "FERPA_MARKER",
            "HIPAA_MARKER", "MEDICAL_LICENSE"),
           ("DATE_TIME", "URL"), "pseudonymize", "MEDIUM"),
    Policy("ferpa_strict", "Zero tolerance: any hit drops the text.",
           (), (), "exclude", "LOW", True),
    Policy("analytics", "Dashboards and statistics: pseudonymize, stop on finance and health.",
           ("US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "IBAN_CODE", "FINANCIAL_ACCOUNT",
            "MEDICAL_LICENSE", "HIPAA_MARKER", "IMMIGRATION_STATUS", "DISABILITY_ACCOMMODATION"),
           ("DATE_TIME", "URL", "LOCATION"), "pseudonymize", "HIGH"),
]}


def get_policy(policy: str | Policy) -> Policy:
    if isinstance(policy, Policy):
        return policy
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {sorted(POLICIES)}")
    return POLICIES[policy]


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    return mode
