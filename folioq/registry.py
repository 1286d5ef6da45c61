"""The registry of document types: their fields, required paths and child parts. Data only; add a type with register_schema."""

from __future__ import annotations

from typing import Any

#: Text, number, yes or no, and an open map of texts.
S, N, B, M = "string", "double", "boolean", "map<string,string>"

#: Fields by document type. A dict is an object, a list of one is a list of that.
SCHEMAS: dict[str, dict[str, Any]] = {
    "invoice": {
        "invoice_number": S,
        "invoice_date": S,
        "due_date": S,
        "vendor": {"name": S, "address": S, "email": S, "phone": S},
        "customer": {"name": S, "address": S, "email": S, "phone": S},
        "line_items": [{"description": S, "quantity": N, "unit_price": N, "total": N}],
        "subtotal": N,
        "tax": N,
        "tax_rate": N,
        "total": N,
        "currency": S,
        "payment_terms": S,
        "notes": S,
    },
    "resume": {
        "personal_info": {"name": S, "email": S, "phone": S, "location": S, "linkedin": S, "website": S, "github": S},
        "professional_summary": S,
        "experience": [{"company": S, "position": S, "location": S, "start_date": S, "end_date": S, "duration": S, "responsibilities": [S], "achievements": [S]}],
        "education": [{"institution": S, "degree": S, "field_of_study": S, "location": S, "graduation_date": S, "gpa": S, "honors": S}],
        "skills": {"technical": [S], "languages": [S], "tools": [S], "soft_skills": [S]},
        "certifications": [{"name": S, "issuer": S, "date": S, "credential_id": S}],
        "projects": [{"name": S, "description": S, "technologies": [S], "url": S}],
        "languages": [{"language": S, "proficiency": S}],
    },
    "contract": {
        "contract_title": S,
        "contract_type": S,
        "contract_number": S,
        "contract_date": S,
        "parties": [{"name": S, "role": S, "address": S, "contact": S, "signatory": S}],
        "effective_date": S,
        "expiration_date": S,
        "term_duration": S,
        "scope_of_work": S,
        "deliverables": [S],
        "payment_terms": {"amount": N, "currency": S, "schedule": S, "method": S},
        "obligations": {"party_1": [S], "party_2": [S]},
        "confidentiality": S,
        "termination_clause": S,
        "dispute_resolution": S,
        "governing_law": S,
        "special_conditions": [S],
        "signatures": [{"party": S, "signed_by": S, "date": S}],
    },
    "prescription": {
        "doctor_name": S,
        "doctor_qualifications": S,
        "clinic_name": S,
        "clinic_address": S,
        "clinic_phone": S,
        "patient_name": S,
        "patient_age": S,
        "patient_gender": S,
        "date": S,
        "medicines": [{"name": S, "dosage": S, "frequency": S, "duration": S, "instructions": S}],
        "diagnosis": S,
        "instructions": [S],
        "follow_up": S,
        "registration_number": S,
    },
    "certificate": {
        "certificate_type": S,
        "certificate_number": S,
        "issuing_authority": S,
        "issuing_authority_address": S,
        "issue_date": S,
        "primary_person": {"name": S, "age": S, "address": S, "father_name": S, "religion": S},
        "secondary_person": {"name": S, "age": S, "address": S, "father_name": S, "religion": S},
        "event_date": S,
        "event_place": S,
        "witnesses": [S],
        "registrar_name": S,
        "additional_details": M,
    },
    "bank_statement": {
        "bank_name": S,
        "branch_name": S,
        "account_holder": S,
        "account_number": S,
        "ifsc_code": S,
        "account_type": S,
        "statement_period": {"from_date": S, "to_date": S},
        "opening_balance": N,
        "closing_balance": N,
        "currency": S,
        "transactions": [{"date": S, "description": S, "debit": N, "credit": N, "balance": N}],
    },
    "utility_bill": {
        "bill_type": S,
        "provider_name": S,
        "consumer_name": S,
        "consumer_number": S,
        "meter_number": S,
        "billing_address": S,
        "billing_period": S,
        "bill_date": S,
        "due_date": S,
        "previous_reading": N,
        "current_reading": N,
        "units_consumed": N,
        "charges": {"energy_charge": N, "fixed_charge": N, "taxes": N, "other_charges": N},
        "total_amount": N,
        "currency": S,
        "payment_options": [S],
        "late_payment_surcharge": S,
    },
    "marksheet": {
        "institution_name": S,
        "exam_name": S,
        "student_name": S,
        "roll_number": S,
        "class_grade": S,
        "academic_year": S,
        "date_of_birth": S,
        "subjects": [{"name": S, "max_marks": N, "marks_obtained": N, "grade": S}],
        "total_marks": N,
        "max_total_marks": N,
        "percentage": N,
        "result": S,
        "class_teacher": S,
        "principal": S,
        "issue_date": S,
    },
    "ration_card": {
        "card_type": S,
        "card_number": S,
        "issuing_state": S,
        "issuing_department": S,
        "head_of_family": {"name": S, "father_husband_name": S, "address": S, "district": S, "pin_code": S},
        "family_members": [{"serial_number": N, "name": S, "age": N, "relation": S}],
        "ration_shop": {"dealer_name": S, "shop_number": S},
        "issue_date": S,
        "valid_until": S,
    },
    "aadhar_card": {
        "uid_number": S,
        "name": S,
        "dob": S,
        "gender": S,
        "address": {"house": S, "street": S, "landmark": S, "village_town": S, "district": S, "state": S, "pin_code": S},
        "relation_name": S,
        "mobile_linked": S,
        "enrollment_number": S,
        "issue_date": S,
        "qr_data_summary": S,
    },
    "pan_card": {
        "pan_number": S,
        "name": S,
        "father_name": S,
        "dob": S,
        "signature_present": B,
        "card_type": S,
        "issuing_authority": S,
    },
    "driving_licence": {
        "dl_number": S,
        "name": S,
        "dob": S,
        "blood_group": S,
        "address": {"line1": S, "line2": S, "city": S, "state": S, "pin_code": S},
        "issuing_authority": S,
        "issue_date": S,
        "vehicle_classes": [{"class": S, "valid_from": S, "valid_to": S}],
        "validity_nt": S,
        "validity_t": S,
        "father_husband_name": S,
    },
    "passport": {
        "passport_number": S,
        "surname": S,
        "given_names": S,
        "nationality": S,
        "dob": S,
        "place_of_birth": S,
        "sex": S,
        "issue_date": S,
        "expiry_date": S,
        "place_of_issue": S,
        "issuing_authority": S,
        "file_number": S,
        "father_name": S,
        "mother_name": S,
        "spouse_name": S,
        "address": S,
        "mrz_line1": S,
        "mrz_line2": S,
    },
    "cheque": {
        "cheque_number": S,
        "cheque_type": S,
        "bank_name": S,
        "branch_name": S,
        "branch_address": S,
        "ifsc_code": S,
        "micr_code": S,
        "account_number": S,
        "payee_name": S,
        "amount_figures": N,
        "amount_words": S,
        "date": S,
        "drawer_name": S,
        "memo": S,
        "crossed": B,
    },
    "form_16": {
        "form_part": S,
        "assessment_year": S,
        "certificate_number": S,
        "employer": {"name": S, "tan": S, "address": S, "pan": S},
        "employee": {"name": S, "pan": S, "designation": S, "period_of_employment": {"from": S, "to": S}},
        "income": {"gross_salary": N, "allowances_exempt": N, "net_taxable_salary": N, "other_income": N, "gross_total_income": N},
        "deductions": {"chapter_vi_a": N, "section_80c": N, "section_80d": N, "section_80g": N, "other_deductions": N, "total_deductions": N},
        "tax": {"taxable_income": N, "tax_on_income": N, "rebate_87a": N, "surcharge": N, "health_education_cess": N, "total_tax_payable": N, "total_tds_deducted": N, "tds_deposited": N},
        "quarter_details": [{"quarter": S, "amount_paid": N, "tds_deducted": N, "date_of_deposit": S}],
    },
    "insurance_policy": {
        "policy_number": S,
        "policy_type": S,
        "insurer_name": S,
        "insurer_license_number": S,
        "insured": {"name": S, "dob": S, "age": N, "address": S, "mobile": S, "email": S},
        "nominee": {"name": S, "relation": S, "dob": S, "share_percentage": N},
        "sum_assured": N,
        "premium_amount": N,
        "premium_frequency": S,
        "policy_term_years": N,
        "premium_paying_term_years": N,
        "policy_start_date": S,
        "policy_end_date": S,
        "next_premium_due": S,
        "grace_period_days": N,
        "riders": [{"name": S, "sum_assured": N, "premium": N}],
        "agent_name": S,
        "agent_code": S,
    },
    "gst_certificate": {
        "gstin": S,
        "legal_name": S,
        "trade_name": S,
        "constitution": S,
        "registration_date": S,
        "certificate_issue_date": S,
        "cancellation_date": S,
        "status": S,
        "principal_place_of_business": {"address": S, "city": S, "state": S, "pin_code": S, "nature": S},
        "additional_places": [{"address": S, "state": S}],
        "nature_of_business": [S],
        "authorized_signatory": {"name": S, "designation": S},
        "jurisdiction": {"state": S, "zone": S, "division": S, "range": S},
    },
    "birth_certificate": {
        "registration_number": S,
        "child_name": S,
        "gender": S,
        "dob": S,
        "time_of_birth": S,
        "place_of_birth": {"hospital_name": S, "village_town": S, "district": S, "state": S},
        "father": {"name": S, "nationality": S, "occupation": S, "education": S, "religion": S, "aadhar": S},
        "mother": {"name": S, "nationality": S, "occupation": S, "education": S, "religion": S, "aadhar": S},
        "permanent_address": S,
        "present_address": S,
        "registration_date": S,
        "issuing_authority": S,
        "issue_date": S,
        "registrar_name": S,
    },
    "death_certificate": {
        "registration_number": S,
        "deceased_name": S,
        "gender": S,
        "age": N,
        "dod": S,
        "time_of_death": S,
        "place_of_death": {"hospital_name": S, "village_town": S, "district": S, "state": S},
        "cause_of_death": S,
        "father_husband_name": S,
        "mother_name": S,
        "nationality": S,
        "religion": S,
        "occupation": S,
        "permanent_address": S,
        "informant_name": S,
        "informant_relation": S,
        "registration_date": S,
        "issuing_authority": S,
        "issue_date": S,
        "registrar_name": S,
    },
    "land_record": {
        "record_type": S,
        "survey_number": S,
        "sub_division_number": S,
        "village": S,
        "taluka_tehsil": S,
        "district": S,
        "state": S,
        "land_type": S,
        "total_area": {"value": N, "unit": S},
        "owners": [{"name": S, "father_name": S, "share": S, "address": S, "ownership_type": S}],
        "cultivation_details": {"irrigated_area": N, "unirrigated_area": N, "irrigation_source": S, "crop_season": S, "crop_details": S},
        "encumbrances": [{"type": S, "description": S, "date": S}],
        "mutation_number": S,
        "talathi_signature": B,
        "issue_date": S,
        "remarks": S,
    },
    "nrega_card": {
        "job_card_number": S,
        "household_head": {"name": S, "father_husband_name": S, "category": S, "gender": S},
        "village": S,
        "gram_panchayat": S,
        "block": S,
        "district": S,
        "state": S,
        "pin_code": S,
        "registration_date": S,
        "bank_account": {"account_number": S, "bank_name": S, "branch_name": S, "ifsc_code": S},
        "job_seekers": [{"name": S, "gender": S, "age": N, "relation": S}],
        "work_entries": [{"muster_roll_number": S, "work_name": S, "date_from": S, "date_to": S, "days_worked": N, "wage_rate": N, "amount_earned": N, "payment_date": S}],
        "total_days_worked": N,
        "total_wages_earned": N,
    },
}

#: Required paths by document type.
REQUIRED: dict[str, tuple[str, ...]] = {
    "invoice": ("invoice_number", "invoice_date", "vendor.name", "total",),
    "resume": ("personal_info.name", "personal_info.email",),
    "contract": ("contract_title", "parties", "effective_date",),
    "prescription": ("doctor_name", "patient_name", "date", "medicines",),
    "certificate": ("certificate_type", "certificate_number", "issuing_authority", "issue_date", "primary_person.name",),
    "bank_statement": ("bank_name", "account_holder", "account_number", "transactions",),
    "utility_bill": ("provider_name", "consumer_name", "consumer_number", "due_date", "total_amount",),
    "marksheet": ("institution_name", "student_name", "exam_name", "subjects", "result",),
    "ration_card": ("card_number", "card_type", "head_of_family.name", "head_of_family.address", "family_members",),
    "aadhar_card": ("uid_number", "name", "dob", "gender",),
    "pan_card": ("pan_number", "name", "dob",),
    "driving_licence": ("dl_number", "name", "dob", "vehicle_classes",),
    "passport": ("passport_number", "surname", "given_names", "dob", "expiry_date",),
    "cheque": ("cheque_number", "bank_name", "payee_name", "amount_figures", "date",),
    "form_16": ("assessment_year", "employer.name", "employer.tan", "employee.name", "employee.pan", "tax.total_tds_deducted",),
    "insurance_policy": ("policy_number", "policy_type", "insurer_name", "insured.name", "sum_assured", "premium_amount", "policy_start_date", "policy_end_date",),
    "gst_certificate": ("gstin", "legal_name", "constitution", "registration_date",),
    "birth_certificate": ("registration_number", "dob", "gender", "father.name", "mother.name",),
    "death_certificate": ("registration_number", "deceased_name", "dod", "cause_of_death",),
    "land_record": ("survey_number", "village", "taluka_tehsil", "district", "state", "owners",),
    "nrega_card": ("job_card_number", "household_head.name", "gram_panchayat", "district", "state",),
}


def register_schema(name: str, fields: dict[str, Any], required: tuple[str, ...]) -> None:
    """Add or replace a document type."""
    SCHEMAS[name.lower()] = fields
    REQUIRED[name.lower()] = required


def ddl(spec: Any) -> str:
    """The Spark type of a field."""
    if isinstance(spec, dict):
        return "struct<" + ", ".join(f"`{k}`: {ddl(v)}" for k, v in spec.items()) + ">"
    return f"array<{ddl(spec[0])}>" if isinstance(spec, list) else spec


def leaves(spec: dict[str, Any], prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Any]]:
    """(path, kind) of every leaf in order; a list is one leaf."""
    out: list[tuple[tuple[str, ...], Any]] = []
    for k, v in spec.items():
        out += leaves(v, (*prefix, k)) if isinstance(v, dict) else [((*prefix, k), v)]
    return out
