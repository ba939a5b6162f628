"""Word pools and formats of the pseudonym generators.

The words are our own; only the output formats matter to callers.  Name and
city pools can be replaced through the config file.
"""

FIRST_NAMES = [
    "Adrian", "Bailey", "Corey", "Devon", "Ellis", "Frankie", "Gray", "Harper", "Iris", "Jamie",
    "Kendall", "Logan", "Micah", "Nico", "Oakley", "Parker", "Quincy", "Reese", "Skyler", "Toby",
    "Umi", "Val", "Winter", "Xen", "Yael", "Zion", "Arden", "Blair", "Charlie", "Dale",
]

LAST_NAMES = [
    "Archer", "Bennett", "Castillo", "Dalton", "Eriksen", "Fontaine", "Grimaldi", "Holloway",
    "Ibarra", "Jansen", "Keller", "Larkin", "Moreau", "Nolan", "Ortega", "Pryce", "Quigley",
    "Rasmussen", "Silva", "Thatcher", "Ueda", "Varga", "Whitaker", "Xu", "Yates", "Zeller",
    "Ashby", "Brandt", "Conti", "Doyle",
]

CITIES = [
    "Ashton", "Brookfield", "Clearwater", "Dunmore", "Eastgate", "Foxborough", "Glenwood",
    "Harborview", "Ironwood", "Juniper", "Kingsley", "Lynnfield", "Meadowbrook", "Newhaven",
    "Orchard Park", "Pinecrest", "Quarry Hill", "Ridgeway", "Stonebridge", "Timberlake",
]

MAIL_DOMAINS = ["example.com", "example.org", "example.net", "example.edu"]

ACCOMMODATIONS = [
    "longer exam time", "double exam time", "quiet exam room", "shared class notes",
    "recorded lectures", "large print material", "screen reader use", "flexible deadlines",
]

SERVICE_RECORDS = [
    "Former soldier", "Former sailor", "Former airman", "Former marine",
    "Former coast guard", "Guard member", "Reservist", "Serving member",
]

RESIDENCE_PERMITS = [
    "Study permit", "Exchange permit", "Work permit", "Talent permit",
    "Professional permit", "Visitor permit", "Settled resident", "Temporary permit",
]

# Formats that stand-ins must have. In braces: a word list, a range of whole numbers (written with as
# many digits as its first number has), or {A-Z} and {plate} for one letter. Amounts are in hundreds.
FORMATS = {
    "PERSON": "{first} {last}",
    "EMAIL_ADDRESS": "{mailbox}.test@{domain}",
    "INSTITUTION_EMAIL": "{mailbox}.test@{domain}",
    "PHONE_NUMBER": "(555) {2000000-9999999}",
    "US_SSN": "{100-899}-{10-99}-{1000-9999}",
    "CREDIT_CARD": "4111-1111-1111-1111",
    "DATE_TIME": "{01-12}/{01-28}/{1970-2004}",
    "DATE_OF_BIRTH": "{01-12}/{01-28}/{1970-2004}",
    "LOCATION": "{city}",
    "STUDENT_ID": "D{1000000-9999999}",
    "BANNER_ID": "D{1000000-9999999}",
    "COLLEAGUE_ID": "D{1000000-9999999}",
    "FAFSA_ID": "NE-{100000-999999}",
    "IP_ADDRESS": "192.0.2.{1-254}",
    "URL": "https://example.com/redacted",
    "IBAN_CODE": "GB00FAKE00000000000000",
    "MEDICAL_LICENSE": "ML{000000-999999}",
    "FINANCIAL_ACCOUNT": "{10000-99999}{00000-99999}",
    "US_BANK_NUMBER": "{10000-99999}{00000-99999}",
    "US_PASSPORT": "{A-Z}{10000000-99999999}",
    "US_DRIVER_LICENSE": "DL{1000000-9999999}",
    "IMMIGRATION_STATUS": "{permit}",
    "DISABILITY_ACCOMMODATION": "{accommodation}",
    "VETERAN_STATUS": "{service}",
    "NRP": "[SENSITIVE_ATTRIBUTE]",
    "TITLE_IX_CASE_ID": "TIX-{2020-2025}-{1000-9999}",
    "IRB_PROTOCOL": "IRB-{2020-2025}-{100-999}",
    "FINANCIAL_AID_AWARD": "Pell Grant ${1-9},{0-9}00.00",
    "STUDENT_ACCOUNT_ID": "TN-{100000000-999999999}",
    "LICENSE_PLATE": "{plate}{plate}{plate} {1000-9999}",
}
PLATE_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
