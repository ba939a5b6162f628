"""Education-sector detectors: fixed values.

FIXED VALUES.  The entity labels, pattern names, expressions, base scores and
context words below define what counts as a hit, so they are stated plainly and
in one place.  All expressions are matched without regard to case.  The
institution's own mail domain is a parameter (``{domain}``).
"""

# (entity, recognizer, [(pattern, regex, score), ...], [context words])
EDUCATION_SPECS = [
    ("TITLE_IX_CASE_ID", "TitleIXCaseIdRecognizer",
     [("tix_case_id", r"\bTIX[-_]\d{4}[-_]\d{4,6}\b", 0.85),
      ("tix_case_phrase", r"\bTitle\s+IX\s+(?:case|complaint|investigation)\s+#?\s*\d{3,8}\b", 0.8)],
     ["title ix", "titleix", "conduct", "complaint", "investigation", "respondent", "complainant"]),

    ("IRB_PROTOCOL", "IrbProtocolRecognizer",
     [("irb_number", r"\bIRB[-_#]?\s*\d{4}[-_]\d{3,6}\b", 0.85),
      ("hs_protocol", r"\bHS[-_]\d{4}[-_]\d{3,6}\b", 0.8),
      ("irb_bare", r"\bIRB[-_#]\s*\d{5,8}\b", 0.7)],
     ["irb", "institutional review board", "protocol", "study", "research", "human subjects"]),

    ("FINANCIAL_AID_AWARD", "FinancialAidAwardRecognizer",
     [("named_award",
       r"\b(?:Pell\s+Grant|Subsidized\s+Loan|Unsubsidized\s+Loan|Direct\s+(?:Subsidized|Unsubsidized|PLUS)\s+Loan|"
       r"Federal\s+(?:Pell|SEOG|Work[- ]Study)|PLUS\s+Loan|Parent\s+PLUS|Grad\s+PLUS|"
       r"Yellow\s+Ribbon\s+Grant|TEACH\s+Grant|Iraq\s+and\s+Afghanistan\s+Service\s+Grant)"
       r"\s+(?:of\s+|amount[:\s]+)?\$[\d,]+(?:\.\d{2})?\b", 0.85),
      ("award_dollar",
       r"\b(?:award|disbursement|aid)\s+(?:amount|package)[:\s]+\$[\d,]+(?:\.\d{2})?\b", 0.7)],
     ["financial aid", "fafsa", "award letter", "disbursement", "aid package", "net price"]),

    ("STUDENT_ACCOUNT_ID", "StudentAccountIdRecognizer",
     [("touchnet_id", r"\bTN[-_]\d{8,12}\b", 0.85),
      ("cashnet_id", r"\bCN[-_]\d{8,12}\b", 0.85),
      ("sar_id", r"\bSAR[-_]\d{8,12}\b", 0.75),
      ("txn_explicit", r"\b(?:transaction|payment)\s+(?:id|#)[:\s]+\d{8,16}\b", 0.8)],
     ["payment", "transaction", "billing", "touchnet", "cashnet", "accounts receivable", "student account"]),

    ("LICENSE_PLATE", "LicensePlateRecognizer",
     [("us_plate", r"\b[A-Z]{2,3}[-\s]?\d{2,4}[-\s]?[A-Z]{0,3}\b", 0.3),
      ("plate_explicit", r"\b(?:plate|tag)\s+(?:#|number|no\.?)?[:\s]+[A-Z0-9]{4,8}\b", 0.75)],
     ["license plate", "license tag", "vehicle", "parking", "permit", "registration", "dmv", "towing"]),

    ("STUDENT_ID", "StudentIdRecognizer",
     [("d_prefix", r"\bD\d{7}\b", 0.9),
      ("colleague_at", r"@\d{7,8}\b", 0.85),
      ("banner_numeric", r"\b[0-9]{7}\b", 0.35)],
     ["student", "id", "banner", "colleague", "sis", "person", "account", "enrollee"]),

    ("COLLEAGUE_ID", "ColleagueIdRecognizer",
     [("colleague_numeric", r"\b\d{6,8}\b", 0.3)],
     ["colleague", "person.id", "person_id", "ellucian", "erp", "record id", "colleague id"]),

    ("INSTITUTION_EMAIL", "InstitutionEmailRecognizer",
     [("institution_mail", r"\b[a-zA-Z0-9._%+\-]+@{domain}\b", 0.95)],
     []),

    ("DATE_OF_BIRTH", "DateOfBirthRecognizer",
     [("mm_dd_yyyy", r"\b(0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])[-/](19|20)\d{2}\b", 0.55),
      ("yyyy_mm_dd", r"\b(19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b", 0.55),
      ("written_dob",
       r"\b(January|February|March|April|May|June|July|August|September|"
       r"October|November|December)\s+\d{1,2},?\s+(?:19|20)\d{2}\b", 0.5)],
     ["dob", "born", "birth", "birthdate", "date of birth", "birthday", "age", "born on"]),

    ("FERPA_MARKER", "FerpaMarkerRecognizer",
     [("ferpa_phrase",
       r"\b(education record|academic record|transcript|"
       r"disciplinary record|financial aid|tuition balance|"
       r"GPA|grade point average|enrollment status|cumulative GPA|"
       r"degree audit|student account|disability accommodation|"
       r"academic standing|academic probation|academic suspension|"
       r"satisfactory academic progress|SAP status|"
       r"incomplete grade|withdrawal|course withdrawal)\b", 0.65)],
     ["student", "confidential", "restricted", "protected", "ferpa", "record"]),

    ("FAFSA_ID", "FafsaIdRecognizer",
     [("fafsa_number", r"\b[A-Z]{2}-\d{6}\b", 0.7),
      ("fsa_id", r"\bFSA[-\s]?ID\b", 0.55),
      ("isir_reference", r"\bISIR\s+\d{4,10}\b", 0.75),
      ("efc_value", r"\bEFC[:\s]+\$?\d{1,6}(?:\.\d{2})?\b", 0.6)],
     ["fafsa", "financial aid", "fsa", "federal", "aid", "efc", "expected family", "isir"]),

    ("IMMIGRATION_STATUS", "ImmigrationStatusRecognizer",
     [("visa_types",
       r"\b(F-1|F1|J-1|J1|M-1|M1|H-1B|H1B|O-1|O1|TN|DACA|"
       r"undocumented|permanent resident|green card holder|"
       r"naturalized citizen|non-immigrant|I-94|I94|"
       r"SEVIS|sevis id|sevis number|DS-2019|I-20)\b", 0.8),
      ("visa_expiry",
       r"\b(visa|I-20|DS-2019)\s+(?:expires?|expiration|exp\.?)\s*:?\s*\d", 0.85)],
     ["international", "student", "visa", "immigration", "status", "dhs", "sevis", "uscis"]),

    ("DISABILITY_ACCOMMODATION", "DisabilityAccommodationRecognizer",
     [("accommodation_phrases",
       r"\b(disability (?:accommodation|services?|office)|"
       r"ADA accommodation|504 plan|IEP|individualized education|"
       r"testing accommodation|extended time|alternative format|"
       r"note-?taker|sign language interpreter|assistive technolog|"
       r"hearing impair|visually impair|learning disabilit|"
       r"attention deficit|ADHD|autism spectrum|accommodations? letter)\b", 0.75)],
     ["student", "disability", "accommodation", "ada", "504", "services", "support"]),

    ("VETERAN_STATUS", "VeteranStatusRecognizer",
     [("veteran_phrases",
       r"\b(veteran|active duty|military|VA benefit|GI Bill|"
       r"Post-9/11|Chapter 33|Chapter 30|Chapter 1606|"
       r"Yellow Ribbon|military leave|deployment|servicemember|"
       r"National Guard|Reserve component|DD-214|DD214)\b", 0.65),
      ("va_payment",
       r"\bVA\s+(?:payment|benefit|allowance|stipend)\s+of\s+\$[\d,]+", 0.85)],
     ["veteran", "military", "va", "gi", "benefit", "service", "deployment"]),

    ("HIPAA_MARKER", "HipaaMarkerRecognizer",
     [("health_phrases",
       r"\b(health record|medical record|mental health|"
       r"counseling (?:record|note|session)|psychiatric|"
       r"diagnosis|prescription|medication|treatment plan|"
       r"protected health information|PHI|HIPAA|"
       r"immunization record|vaccination|allergy|"
       r"campus health|student health center|"
       r"behavioral health|substance (?:abuse|use)|"
       r"eating disorder|suicid|self-harm)\b", 0.7)],
     ["health", "medical", "patient", "student", "counseling", "hipaa", "phi"]),

    ("FINANCIAL_ACCOUNT", "FinancialAccountRecognizer",
     [("ach_routing", r"\b0[0-9]{8}\b", 0.45),
      ("account_number", r"\b\d{10,17}\b", 0.3),
      ("account_explicit", r"\b(?:account|routing|acct)[\s#:]*\d{8,17}\b", 0.75)],
     ["routing", "account", "ach", "bank", "direct deposit", "checking", "savings", "wire"]),

    ("MEDICAL_LICENSE", "MedicalLicenseRecognizer",
     [("ml_prefix", r"\b(ML|DEA)[- ]?\d{6,10}\b", 0.75),
      ("npi_10digit", r"\bNPI[: ]\d{10}\b", 0.9),
      ("npi_bare", r"\b\d{10}\b", 0.35)],
     ["license", "npi", "dea", "medical", "provider", "prescriber", "physician", "nurse"]),

    ("US_SSN", "UsSsnRecognizer",
     [("ssn_dashed", r"(?!219-09-9999|078-05-1120)(?!666|000|9\d{2})\d{3}-(?!00)\d{2}-(?!0{4})\d{4}", 0.85),
      ("ssn_spaced", r"(?!219-09-9999|078-05-1120)(?!666|000|9\d{2})\d{3} (?!00)\d{2} (?!0{4})\d{4}", 0.75),
      ("ssn_dotted", r"(?!219\.09\.9999|078\.05\.1120)(?!666|000|9\d{2})\d{3}\.(?!00)\d{2}\.(?!0{4})\d{4}", 0.75),
      ("ssn_nodash", r"(?!219099999|078051120)(?!666|000|9\d{2})\d{9}(?!\d)", 0.3)],
     ["ssn", "social security", "social", "ss#", "ssn#", "ssid", "tax id"]),
]

# Context words of the generic entity types.  A hint on one of
# these types boosts every detector that shares a word with it.
GENERIC_CONTEXT = {
    "PERSON": ["name", "student", "faculty", "staff", "person", "employee", "professor", "contact"],
    "EMAIL_ADDRESS": ["email", "contact", "address", "mail", "electronic mail"],
    "PHONE_NUMBER": ["phone", "call", "mobile", "cell", "contact", "fax", "telephone"],
    "US_SSN": ["ssn", "social security", "tax id", "identity", "identification"],
    "CREDIT_CARD": ["payment", "card", "billing", "credit", "charge"],
    "LOCATION": ["address", "city", "location", "campus", "building", "street", "zip"],
    "DATE_TIME": ["date", "time", "when", "scheduled", "appointment"],
    "IP_ADDRESS": ["ip", "server", "network", "host", "address"],
    "US_PASSPORT": ["passport", "travel", "immigration", "identity", "document"],
    "US_DRIVER_LICENSE": ["license", "id", "driver", "identification", "dl"],
    "US_BANK_NUMBER": ["routing", "account", "bank", "ach", "direct deposit"],
    "IBAN_CODE": ["iban", "bank", "account", "international", "swift"],
    "MEDICAL_LICENSE": ["license", "npi", "dea", "medical", "provider", "prescriber"],
    "NRP": ["nationality", "race", "ethnicity", "citizenship", "demographic"],
    "URL": ["url", "link", "website", "href", "endpoint"],
    "CRYPTO": ["bitcoin", "wallet", "crypto", "address", "blockchain"],
}
