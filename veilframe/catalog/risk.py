"""Risk tiers. FIXED VALUES: tier of each entity type; unlisted types are MEDIUM."""

TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
DEFAULT_TIER = "MEDIUM"

ENTITY_TIER = {
    "US_SSN": "CRITICAL",
    "CREDIT_CARD": "CRITICAL",
    "US_BANK_NUMBER": "CRITICAL",
    "US_ITIN": "CRITICAL",
    "US_PASSPORT": "CRITICAL",
    "US_DRIVER_LICENSE": "CRITICAL",
    "IBAN_CODE": "CRITICAL",
    "FINANCIAL_ACCOUNT": "CRITICAL",
    "IMMIGRATION_STATUS": "CRITICAL",
    "CRYPTO": "CRITICAL",
    "EMAIL_ADDRESS": "HIGH",
    "PHONE_NUMBER": "HIGH",
    "STUDENT_ID": "HIGH",
    "COLLEAGUE_ID": "HIGH",
    "BANNER_ID": "HIGH",
    "DATE_OF_BIRTH": "HIGH",
    "INSTITUTION_EMAIL": "HIGH",
    "FAFSA_ID": "HIGH",
    "DISABILITY_ACCOMMODATION": "HIGH",
    "VETERAN_STATUS": "HIGH",
    "MEDICAL_LICENSE": "HIGH",
    "PERSON": "MEDIUM",
    "LOCATION": "MEDIUM",
    "FERPA_MARKER": "MEDIUM",
    "HIPAA_MARKER": "MEDIUM",
    "NRP": "MEDIUM",
    "DATE_TIME": "LOW",
    "IP_ADDRESS": "LOW",
    "URL": "LOW",
}


def tier_of(entity: str) -> str:
    return ENTITY_TIER.get(entity, DEFAULT_TIER)


def rank_of(tier: str) -> int:
    return TIERS.index(tier)


# Advice shown by the preflight check, per tier (own wording).
ADVICE = {
    "LOW": "No significant personal data found; the text can be sent unchanged.",
    "MEDIUM": "Names, places or record markers found; consider masking before sending outside.",
    "HIGH": "Personal identifiers found; mask the text before sending it.",
    "CRITICAL": "Critical identifiers found; do not send. Mask or pseudonymize the text first.",
}
