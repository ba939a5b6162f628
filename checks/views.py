"""Inputs derived from the given tables. One SQL text serves Spark and DuckDB."""

NOTES = """CASE c_custkey % 22
    WHEN 0  THEN concat('Student D', cast(1000000 + c_custkey AS string), ' enrolled')
    WHEN 1  THEN concat('SSN ', cast(100 + c_custkey % 500 AS string), '-', lpad(cast(1 + c_custkey % 99 AS string), 2, '0'), '-', lpad(cast(1 + c_custkey % 9999 AS string), 4, '0'), ' on file')
    WHEN 2  THEN concat('SSN ', cast(100 + c_custkey % 500 AS string), ' ', lpad(cast(1 + c_custkey % 99 AS string), 2, '0'), ' ', lpad(cast(1 + c_custkey % 9999 AS string), 4, '0'), ' on file')
    WHEN 3  THEN concat('complaint TIX-2024-', lpad(cast(c_custkey % 100000 AS string), 5, '0'), ' opened')
    WHEN 4  THEN concat('protocol IRB-2023-', lpad(cast(c_custkey % 10000 AS string), 4, '0'), ' approved')
    WHEN 5  THEN concat('Pell Grant of $', cast(1000 + c_custkey % 7000 AS string), ' awarded')
    WHEN 6  THEN concat('payment TN-', cast(100000000 + c_custkey AS string), ' posted')
    WHEN 7  THEN concat('parking plate number ABC', cast(1000 + c_custkey % 9000 AS string), ' towed')
    WHEN 8  THEN concat('write advisor', cast(c_custkey AS string), '@campus.edu today')
    WHEN 9  THEN concat('born ', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '/', lpad(cast(1 + c_custkey % 28 AS string), 2, '0'), '/', cast(1960 + c_custkey % 40 AS string))
    WHEN 10 THEN 'student GPA is 3.45 and transcript sent'
    WHEN 11 THEN concat('FAFSA NE-', lpad(cast(c_custkey % 1000000 AS string), 6, '0'), ' pending')
    WHEN 12 THEN 'on F-1 visa and SEVIS update due'
    WHEN 13 THEN 'approved for extended time on exams'
    WHEN 14 THEN 'veteran using GI Bill benefits'
    WHEN 15 THEN 'mental health referral made'
    WHEN 16 THEN concat('account ', cast(1000000000 + c_custkey AS string), ' for direct deposit')
    WHEN 17 THEN concat('provider NPI ', cast(1000000000 + c_custkey AS string), ' listed')
    WHEN 18 THEN concat('mail user', cast(c_custkey AS string), '@example.com or (402) 555-0123')
    WHEN 19 THEN 'the course meets on Monday'
    WHEN 20 THEN concat('colleague id ', cast(100000 + c_custkey AS string), ' updated')
    ELSE NULL
  END"""

# The generic shapes the notes lack, among them right and wrong check digits.
MEMOS = """CASE c_custkey % 24
    WHEN 0  THEN concat('iban DE', lpad(cast(98 - (c_custkey * 1000000 + 131400) % 97 AS string), 2, '0'), lpad(cast(c_custkey AS string), 18, '0'), ' used')
    WHEN 1  THEN concat('iban DE00', lpad(cast(c_custkey AS string), 18, '0'), ' wrong')
    WHEN 2  THEN concat('card 4', lpad(cast((c_custkey * 7919) % 1000000000 AS string), 15, '0'), ' charged')
    WHEN 3  THEN concat('paid with 4111 1111 1111 ', lpad(cast(c_custkey % 10000 AS string), 4, '0'), ' now')
    WHEN 4  THEN concat('host 10.', cast(c_custkey % 256 AS string), '.', cast(c_custkey % 200 AS string), '.7 is up')
    WHEN 5  THEN concat('server 2001:db8:0:0:0:0:0:', cast(c_custkey % 10000 AS string), ' down')
    WHEN 6  THEN concat('see https://host', cast(c_custkey AS string), '.example.com/a?b=1, please')
    WHEN 7  THEN concat('or www.site', cast(c_custkey AS string), '.example.org instead')
    WHEN 8  THEN concat('due 2021-', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0'), ' sharp')
    WHEN 9  THEN concat('met on March ', cast(1 + c_custkey % 28 AS string), ', 2021 at 10:', cast(10 + c_custkey % 50 AS string), ' PM')
    WHEN 10 THEN concat('wallet 0x', md5(cast(c_custkey AS string)), substring(md5(cast(c_custkey + 1 AS string)), 1, 8), ' empty')
    WHEN 11 THEN concat('bank account ', cast(10000000 + c_custkey AS string), ' closed')
    WHEN 12 THEN concat('itin 9', lpad(cast(c_custkey % 100 AS string), 2, '0'), '-', cast(70 + c_custkey % 19 AS string), '-', lpad(cast(c_custkey % 10000 AS string), 4, '0'), ' filed')
    WHEN 13 THEN concat('passport number ', cast(100000000 + c_custkey AS string), ' seen')
    WHEN 14 THEN concat('driver license A', cast(1000000 + c_custkey AS string), ' valid')
    WHEN 15 THEN concat('Dr. Smith met John Carter in room ', cast(c_custkey AS string))
    WHEN 16 THEN concat(cast(1 + c_custkey % 900 AS string), ' Main Street, Lincoln, NE 68508 in Nebraska')
    WHEN 17 THEN 'identifies as Hispanic and speaks Spanish'
    WHEN 18 THEN 'sent to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT yesterday'
    WHEN 19 THEN 'sent to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq yesterday'
    WHEN 20 THEN concat('ring +44 20 7946 ', lpad(cast(c_custkey % 10000 AS string), 4, '0'), ' after')
    WHEN 21 THEN concat('badge ', cast(1000000 + c_custkey AS string), ' handed out')
    WHEN 22 THEN concat('number ', cast(200000000 + c_custkey AS string), ' and ', cast(3000000000 + c_custkey AS string))
    ELSE ''
  END"""

# A positive and a near miss for each pattern that neither notes nor memos fire; the suffix grows with the table.
_POSITIVE = ["Title IX case # 48213", "protocol HS-2021-0042", "protocol IRB-#12345", "award amount: $4,500.00", "payment CN-12345678", "payment SAR-123456789",
             "transaction id: 123456789012", "colleague @1234567", "federal aid FSA ID", "isir ISIR 44521", "EFC: 5321", "visa visa expires: 5",
             "veteran VA payment of $1,200", "bank ach 012345678", "medical license ML-1234567", "ssn 123.45.6789", "host fe80::1a2b", "iban GB82 WEST 1234 5698 7654 32",
             "itin taxpayer 912701234", "host ::1"]
_NEAR = ["Title IX case # 48", "protocol HS-21-0042", "protocol IRB-#123", "award amount: 4,500.00", "payment CN-1234", "payment SAR-12345", "transaction id: 1234",
         "colleague @123456", "federal aid FSAID2", "isir ISIR 445", "EFC: none", "visa visa expires: May", "veteran VA payment of 1,200", "bank ach 01234567",
         "medical license ML-12345", "ssn 000.45.6789", "host fe80:1a2b", "iban GB83 WEST 1234 5698 7654 32", "itin taxpayer 912661234", "host std::sort"]
PROOFS = "CASE c_custkey % " + str(len(_POSITIVE) + len(_NEAR)) + "".join(
    f"\n    WHEN {k} THEN concat('{text} row ', cast(c_custkey AS string))" for k, text in enumerate(_POSITIVE + _NEAR)) + "\n  END"

# (table, key expression, text expression)
SOURCES = {
    "notes": ("customer", "c_custkey", NOTES),
    "memos": ("customer", "c_custkey", MEMOS),
    "proofs": ("customer", "c_custkey", PROOFS),
    "documents": ("documents", "doc_id", "text"),
    "pages": ("pages", "page_id", "html"),
    "conversations": ("conversations", "conv_id * 1000 + turn", "text"),
}


def duck_source(name: str, key: str = "", text: str = "", extra: str = "") -> str:
    table, k, t = SOURCES[name]
    return f"SELECT {k} AS id, {text or t} AS text{extra} FROM {table}"
