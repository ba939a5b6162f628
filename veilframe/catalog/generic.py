"""Generic detectors, defined here from public formats.

Shapes come from public standards: RFC 5321/5322 addresses, the North American
Numbering Plan, ISO/IEC 7812 card numbers with their check digit, dotted-quad
and colon-hex internet addresses, ISO 8601 dates, ISO 13616 account numbers with
their mod-97 check, published tax-number ranges.  Person, place and group
detection uses titles, common given names, street and postal shapes and term
lists; it has no language model behind it and is less precise than one.
"""

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_MONTH = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
          r"Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")

TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Dean"]

GIVEN_NAMES = [
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph",
    "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Steven", "Paul",
    "Andrew", "Kevin", "Brian", "George", "Mary", "Patricia", "Jennifer", "Linda",
    "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy",
    "Maria", "Anna", "Emily", "Laura", "Jane", "Carlos", "Juan", "Ahmed", "Wei", "Fatima",
]

PLACE_NAMES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut",
    "Delaware", "Florida", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "West Virginia", "Wisconsin", "Wyoming", "Chicago",
    "Houston", "Los Angeles", "Omaha", "London", "Paris", "Berlin", "Madrid", "Tokyo",
]

GROUP_TERMS = [
    "American", "Mexican", "Canadian", "Chinese", "Indian", "Nigerian", "German", "French",
    "Spanish", "Japanese", "Korean", "Vietnamese", "Brazilian", "Hispanic", "Latino", "Latina",
    "African American", "Native American", "Caucasian", "Christian", "Catholic", "Protestant",
    "Muslim", "Jewish", "Hindu", "Buddhist", "Atheist", "Republican", "Democrat", "Libertarian",
]


def _any_of(words):
    return "(?:" + "|".join(words) + ")"


# (entity, recognizer, [(pattern, regex, score[, validator]), ...])
GENERIC_SPECS = [
    ("EMAIL_ADDRESS", "EmailRecognizer",
     [("mailbox", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b", 0.9)]),

    ("PHONE_NUMBER", "PhoneRecognizer",
     [("nanp", r"(?:\+1[-. ]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}\b", 0.75),
      ("international", r"\+[1-9][0-9]{1,2}[-. ]?[0-9]{1,4}(?:[-. ][0-9]{2,4}){2,4}\b", 0.6)]),

    ("CREDIT_CARD", "CardRecognizer",
     [("card_number",
       r"\b(?:[0-9]{13,19}|[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{1,7}|[0-9]{4}[- ][0-9]{6}[- ][0-9]{5})\b",
       0.9, "luhn")]),

    ("IP_ADDRESS", "IpRecognizer",
     [("ipv4", r"\b(?:" + _OCTET + r"\.){3}" + _OCTET + r"\b", 0.6),
      ("ipv6", r"\b(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}\b", 0.6),
      ("ipv6_short", r"\b(?:[0-9A-F]{1,4}:){1,6}(?::[0-9A-F]{1,4}){1,6}\b", 0.6),
      ("ipv6_tail", r"\B::(?:[0-9A-F]{1,4}:){0,6}[0-9A-F]{1,4}\b", 0.6)]),

    ("URL", "UrlRecognizer",
     [("scheme", r"\b(?:https?|ftp)://[^\s<>\"']*[^\s<>\"'.,;:!?)\]]", 0.6),
      ("www", r"\bwww\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[^\s<>\"']*[^\s<>\"'.,;:!?)\]])?", 0.55)]),

    ("DATE_TIME", "DateTimeRecognizer",
     [("iso", r"\b[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b", 0.6),
      ("slashed", r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:[0-9]{4}|[0-9]{2})\b", 0.6),
      ("written", r"\b" + _MONTH + r"\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\b", 0.6),
      ("clock", r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?: ?[AP]M)?\b", 0.5)]),

    ("IBAN_CODE", "IbanRecognizer",
     [("iban_compact", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.9, "mod97"),
      ("iban_spaced", r"\b[A-Z]{2}[0-9]{2}(?: [A-Z]{4})?(?: [0-9]{4}){2,7}(?: [0-9]{1,4})?\b", 0.9, "mod97")]),

    ("CRYPTO", "WalletRecognizer",
     [("base58_wallet", r"\b(?-i:[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", 0.5),
      ("bech32_wallet", r"\bbc1[02-9ac-hj-np-z]{11,71}\b", 0.8),
      ("hex_wallet", r"\b0x[0-9a-f]{40}\b", 0.8)]),

    ("US_BANK_NUMBER", "UsBankRecognizer",
     [("bank_digits", r"\b[0-9]{8,17}\b", 0.25)]),

    ("US_ITIN", "UsItinRecognizer",
     [("itin_separated", r"\b9[0-9]{2}[- ](?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])[- ][0-9]{4}\b", 0.75),
      ("itin_bare", r"\b9[0-9]{2}(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])[0-9]{4}\b", 0.3)]),

    ("US_PASSPORT", "UsPassportRecognizer",
     [("passport_number", r"\b[A-Z0-9][0-9]{8}\b", 0.25)]),

    ("US_DRIVER_LICENSE", "UsDriverLicenseRecognizer",
     [("licence_lettered", r"\b(?:[A-Z][0-9]{7,8}|[A-Z]{2}[0-9]{6})\b", 0.2),
      ("licence_digits", r"\b[0-9]{7,9}\b", 0.1)]),

    ("PERSON", "PersonRecognizer",
     [("titled_name", r"\b(?-i:" + _any_of(TITLES) + r"\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?)\b", 0.7),
      ("given_and_family", r"\b(?-i:" + _any_of(GIVEN_NAMES) + r" [A-Z][a-z]+)\b", 0.6)]),

    ("LOCATION", "LocationRecognizer",
     [("street", r"\b(?-i:[0-9]{1,6} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Way|Place))\b", 0.65),
      ("state_zip", r"\b(?-i:[A-Z]{2} [0-9]{5}(?:-[0-9]{4})?)\b", 0.55),
      ("place_name", r"\b(?-i:" + _any_of(PLACE_NAMES) + r")\b", 0.55)]),

    ("NRP", "GroupTermRecognizer",
     [("group_term", r"\b(?-i:" + _any_of(GROUP_TERMS) + r")\b", 0.55)]),
]
