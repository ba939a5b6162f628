"""Schema profiles: field name -> hinted entity type.

FIXED VALUES: field names, hints (None = no hint, scan for everything) and the
default mode of each profile. Descriptions are our own wording.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    description: str
    hints: dict = field(default_factory=dict)
    mode: str = "mask"


PROFILES = {p.name: p for p in [
    Profile("banner_student", "Banner student tables", {
        "PIDM": "STUDENT_ID",
        "SPRIDEN_ID": "STUDENT_ID",
        "SPRIDEN_LAST_NAME": "PERSON",
        "SPRIDEN_FIRST_NAME": "PERSON",
        "SPBPERS_SSN": "US_SSN",
        "SPBPERS_BIRTH_DATE": "DATE_OF_BIRTH",
        "GOBTPAC_EXTERNAL_USER": "INSTITUTION_EMAIL",
        "GOREMAL_EMAIL_ADDRESS": "EMAIL_ADDRESS",
        "SPRTELE_PHONE_AREA": "PHONE_NUMBER",
        "SPRTELE_PHONE_NUMBER": "PHONE_NUMBER",
        "SPRADDR_STREET_LINE1": "LOCATION",
        "SPRADDR_CITY": "LOCATION",
        "SPRADDR_ZIP": "LOCATION",
    }),
    Profile("colleague_person", "Colleague person records", {
        "id": "COLLEAGUE_ID",
        "colleaguePersonId": "COLLEAGUE_ID",
        "bannerId": "STUDENT_ID",
        "lastName": "PERSON",
        "firstName": "PERSON",
        "fullName": "PERSON",
        "preferredName": "PERSON",
        "emailAddress": "EMAIL_ADDRESS",
        "phoneNumber": "PHONE_NUMBER",
        "dateOfBirth": "DATE_OF_BIRTH",
        "socialSecurityNumber": "US_SSN",
        "visaType": "IMMIGRATION_STATUS",
        "citizenshipCountry": "NRP",
        "veteranStatus": "VETERAN_STATUS",
        "disabilityIndicator": "DISABILITY_ACCOMMODATION",
    }),
    Profile("salesforce_contact", "Salesforce contact rows", {
        "FirstName": "PERSON",
        "LastName": "PERSON",
        "Name": "PERSON",
        "Email": "EMAIL_ADDRESS",
        "MobilePhone": "PHONE_NUMBER",
        "Phone": "PHONE_NUMBER",
        "Birthdate": "DATE_OF_BIRTH",
        "MailingStreet": "LOCATION",
        "MailingCity": "LOCATION",
        "MailingPostalCode": "LOCATION",
        "SIS_ID__c": "STUDENT_ID",
        "Ethos_Guid__c": "COLLEAGUE_ID",
        "SSN__c": "US_SSN",
    }),
    Profile("ethos_person", "Ethos person resources", {
        "fullName": "PERSON",
        "firstName": "PERSON",
        "lastName": "PERSON",
        "preferredName": "PERSON",
        "emailAddress": "EMAIL_ADDRESS",
        "phoneNumber": "PHONE_NUMBER",
        "dateOfBirth": "DATE_OF_BIRTH",
        "colleaguePersonId": "COLLEAGUE_ID",
        "bannerId": "STUDENT_ID",
        "gender": "NRP",
        "race": "NRP",
        "ethnicity": "NRP",
        "visaType": "IMMIGRATION_STATUS",
        "disabilityIndicator": "DISABILITY_ACCOMMODATION",
    }),
    Profile("n8n_generic", "Common webhook field names", {
        "email": "EMAIL_ADDRESS",
        "phone": "PHONE_NUMBER",
        "name": "PERSON",
        "full_name": "PERSON",
        "first_name": "PERSON",
        "last_name": "PERSON",
        "ssn": "US_SSN",
        "social_security": "US_SSN",
        "dob": "DATE_OF_BIRTH",
        "birth_date": "DATE_OF_BIRTH",
        "address": "LOCATION",
        "student_id": "STUDENT_ID",
        "notes": None,
        "comments": None,
        "bio": None,
        "description": None,
    }),
    Profile("conductor_ethos", "Change notifications of the person service", {
        "resource.id": "COLLEAGUE_ID",
        "resource.content.id": "COLLEAGUE_ID",
        "notes": None,
        "comments": None,
    }),
    Profile("workday_hr", "Workday worker records", {
        "Worker_ID": "COLLEAGUE_ID",
        "Employee_ID": "COLLEAGUE_ID",
        "National_Identifier": "US_SSN",
        "Social_Security_Number": "US_SSN",
        "Legal_Name_First_Name": "PERSON",
        "Legal_Name_Last_Name": "PERSON",
        "Known_As_First_Name": "PERSON",
        "Email_Address": "EMAIL_ADDRESS",
        "Phone_Number": "PHONE_NUMBER",
        "Date_of_Birth": "DATE_OF_BIRTH",
        "Home_Address_Line_1": "LOCATION",
        "Home_City": "LOCATION",
        "Home_Postal_Code": "LOCATION",
        "Emergency_Contact_Name": "PERSON",
        "Emergency_Contact_Phone": "PHONE_NUMBER",
        "Bank_Account_Number": "FINANCIAL_ACCOUNT",
        "Routing_Number": "FINANCIAL_ACCOUNT",
        "body": None,
        "content": None,
    }),
    Profile("servicenow_itsm", "ServiceNow tickets", {
        "caller_id.name": "PERSON",
        "caller_id.email": "EMAIL_ADDRESS",
        "opened_by.name": "PERSON",
        "assigned_to.name": "PERSON",
        "short_description": None,
        "description": None,
        "comments": None,
        "work_notes": None,
        "additional_comments": None,
        "close_notes": None,
        "u_requester_name": "PERSON",
        "u_requester_email": "EMAIL_ADDRESS",
        "contact_type": None,
        "location.name": "LOCATION",
    }, "redact"),
    Profile("slate_crm", "Slate applicant records", {
        "first": "PERSON",
        "last": "PERSON",
        "full_name": "PERSON",
        "preferred_name": "PERSON",
        "email": "EMAIL_ADDRESS",
        "mobile": "PHONE_NUMBER",
        "ssn": "US_SSN",
        "dob": "DATE_OF_BIRTH",
        "address1": "LOCATION",
        "city": "LOCATION",
        "zip": "LOCATION",
        "visa_type": "IMMIGRATION_STATUS",
        "citizenship": "NRP",
        "ethnicity": "NRP",
        "gender": "NRP",
        "disability_status": "DISABILITY_ACCOMMODATION",
        "veteran_status": "VETERAN_STATUS",
        "essay": None,
        "personal_statement": None,
        "counselor_notes": None,
        "interview_notes": None,
    }),
    Profile("starfish_early_alert", "Starfish alerts and case notes", {
        "student.first_name": "PERSON",
        "student.last_name": "PERSON",
        "student.email": "EMAIL_ADDRESS",
        "student.id": "STUDENT_ID",
        "advisor.name": "PERSON",
        "advisor.email": "EMAIL_ADDRESS",
        "flag_reason": None,
        "note_text": None,
        "case_note": None,
        "referral_note": None,
        "intervention_note": None,
        "tracking_item_name": None,
    }),
    Profile("canvas_lms", "Canvas users and submissions", {
        "sis_user_id": "STUDENT_ID",
        "sis_login_id": "INSTITUTION_EMAIL",
        "login_id": "EMAIL_ADDRESS",
        "name": "PERSON",
        "sortable_name": "PERSON",
        "short_name": "PERSON",
        "email": "EMAIL_ADDRESS",
        "submission_comments": None,
        "body": None,
        "comment": None,
        "message": None,
        "bio": None,
    }),
    Profile("microsoft_graph", "Microsoft Graph users and messages", {
        "userPrincipalName": "EMAIL_ADDRESS",
        "mail": "EMAIL_ADDRESS",
        "displayName": "PERSON",
        "givenName": "PERSON",
        "surname": "PERSON",
        "mobilePhone": "PHONE_NUMBER",
        "businessPhones": "PHONE_NUMBER",
        "streetAddress": "LOCATION",
        "city": "LOCATION",
        "postalCode": "LOCATION",
        "employeeId": "COLLEAGUE_ID",
        "onPremisesSamAccountName": "COLLEAGUE_ID",
        "body.content": None,
        "content": None,
        "subject": None,
    }),
]}


def get_profile(profile: str | Profile, custom: dict[str, Profile] | None = None) -> Profile:
    """Look a profile up; a built-in profile wins over a custom one of the same name."""
    if isinstance(profile, Profile):
        return profile
    found = PROFILES.get(profile) or (custom or {}).get(profile)
    if found is None:
        raise ValueError(f"unknown profile {profile!r}; known: {sorted({*PROFILES, *(custom or {})})}")
    return found
