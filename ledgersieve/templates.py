"""Extract templates: headers, how strongly each is required, and the staging columns that cover it.

Fixed values.  One line per header: level | header | staging columns.  Levels are
R required, M recommended, O optional, C required when the row's status asks for
it.  Several staging columns mean any of them covers the header, ``-`` that no
staging column exists, ``=`` that the header itself is looked for in the file.
"""

from __future__ import annotations

from typing import NamedTuple

_BILLING_COMMON_HEAD = """
R | Date of Service | DateOfService
R | Post Date | PostDate
R | CPT-4 Code | CptCode
R | CPT Code Modifier 1 | Modifier1
R | CPT Code Modifier 2 | Modifier2
R | CPT Code Modifier 3 | Modifier3
R | CPT Code Modifier 4 | Modifier4
R | Units | Units
"""
_BILLING_COMMON_BODY = """
R | Work RVUs | WorkRvuOriginal
R | CMS Place of Service Code | PlaceOfServiceCode
R | Primary ICD-10 CM Code | PrimaryIcdCode
R | Secondary ICD-10 CM Code | SecondaryIcdCodes
R | Third ICD-10 CM Code | SecondaryIcdCodes
R | Fourth ICD-10 CM Code | SecondaryIcdCodes
R | 5th through 25th ICD-10 CM Code | SecondaryIcdCodes
R | Patient MRN/Identifier | PatientId, PatientMrn
R | Patient DOB | -
R | Patient Gender | PatientGender
R | Patient City | PatientCity
R | Patient ZIP Code | PatientZip
R | Rendering Provider Full Name | RenderingProviderFullName
R | Rendering Provider NPI | RenderingProviderNpi
R | Rendering Provider's Primary Specialty | RenderingProviderSpecialty
R | Rendering Provider Credentials | RenderingProviderCredentials
R | Billing Provider Full Name | BillingProviderFullName
R | Billing Provider NPI | BillingProviderNpi
R | Billing Provider's Primary Specialty | BillingProviderSpecialty
R | Billing Provider Credentials | BillingProviderCredentials
R | Practice Name | BillPracticeName
R | Billing Location Name | BillLocationName
R | Department Name | BillDepartmentName
R | Cost Center | BillDepartmentId, BillDepartmentName
R | Charge ID | ChargeId
R | Invoice Number / Encounter ID | InvoiceNumber
M | CPT Code Description | CptCodeDesc
M | Rendering Provider First Name | RenderingProviderFirstName
M | Rendering Provider Middle Name/Initial | RenderingProviderMiddleName
M | Rendering Provider Last Name | RenderingProviderLastName
M | Rendering Provider ID | RenderingProviderId
M | Billing Provider First Name | BillingProviderFirstName
M | Billing Provider Middle Name/Initial | BillingProviderMiddleName
M | Billing Provider Last Name | BillingProviderLastName
M | Billing Provider ID | BillingProviderId
M | Referring Provider ID | ReferringProviderId
O | Last Modified Date | -
O | Primary ICD-10 CM Code Description | PrimaryIcdDesc
O | Secondary ICD-10 CM Code Description | SecondaryIcdDesc
O | Third ICD-10 CM Code Description | SecondaryIcdDesc
O | Fourth ICD-10 CM Code Description | SecondaryIcdDesc
O | 5th through 25th ICD-10 CM Description | SecondaryIcdDesc
O | Patient Race/Ethnicity | PatientRace
O | Patient Marital Status | PatientMaritalStatus
O | Referring Provider First Name | ReferringProviderFirstName
O | Referring Provider Middle Name/Initial | ReferringProviderMiddleName
O | Referring Provider Last Name | ReferringProviderLastName
O | Referring Provider Full Name | ReferringProviderFullName
O | Referring Provider NPI | ReferringProviderNpi
O | Referring Provider's Primary Specialty | ReferringProviderSpecialty
O | Referring Provider Credentials | ReferringProviderCredentials
"""
_COMBINED_ONLY = """
R | Transaction Type | TransactionType
R | Transaction Description | TransactionTypeDesc
R | Amount | ChargeAmountOriginal, PaymentOriginal
R | Primary Payer Name | ChargePayerName, TransactionPayerName
R | Primary Payer Plan | ChargePayerPlan, TransactionPayerPlan
R | Primary Payer Financial Class | ChargePayerFinancialClass, TransactionPayerFinancialClass
"""
_CHARGES_ONLY = """
R | Charge Amount | ChargeAmountOriginal
R | Primary Payer Name | ChargePayerName
R | Primary Payer Plan | ChargePayerPlan
R | Primary Payer Financial Class | ChargePayerFinancialClass
"""
_TEXT = {
    "billing_combined": _BILLING_COMMON_HEAD + _COMBINED_ONLY + _BILLING_COMMON_BODY,
    "billing_charges": _BILLING_COMMON_HEAD + _CHARGES_ONLY + _BILLING_COMMON_BODY,
    "billing_transactions": """
R | Transaction ID | ChargeId, InvoiceNumber
R | Transaction Description | TransactionTypeDesc
R | Post Date | PostDate
R | Payment Amount | PaymentOriginal
R | Adjustment Amount | AdjustmentOriginal
R | Refund Amount | RefundOriginal
R | Payer Name | TransactionPayerName
R | Payer Plan | TransactionPayerPlan
R | Payer Financial Class | TransactionPayerFinancialClass
R | Charge ID | ChargeId
R | Invoice Number / Encounter ID | InvoiceNumber
O | Last Modified Date | -
O | Reason Category | ReasonCodeCategory
O | Claim Adjudication Reason Code | ReasonCode
O | Claim Adjudication Reason Description | ReasonCodeDesc
O | Other Reason Detail | -
""",
    "scheduling": """
R | Appt ID | ApptId
R | Location Name | BillLocNameOrig
R | Appt Provider Full Name | ApptProvFullNameOrig
R | Appt Provider NPI | ApptProvNPI
R | Patient Identifier | PatIdOrig
R | Appt Type | ApptType
R | Created Date | CreateDate
R | Appt Date | ApptDate
R | Appt Time | ApptTime
R | Scheduled Length | ApptSchdLength
R | Appt Status | ApptStatus
C | Cancel Date | CancellationDate
C | Cancel Reason | CancelReason
M | Practice Name | PracNameOrig
M | Department Name | DeptNameOrig
M | Cost Center | DeptId, DeptNameOrig
M | Appt Provider First Name | ApptProvFirstName
M | Appt Provider Middle Name | ApptProvMidName
M | Appt Provider Last Name | ApptProvLastName
M | Appt Provider ID | ApptProvId
M | Referring Provider ID | ReferProvId
M | Check In Date | CheckInDate
M | Check In Time | CheckInTime
M | Check Out Date | CheckOutDate
M | Check Out Time | CheckOutTime
O | Appt Provider Credentials | -
O | Appt Provider Primary Specialty | ApptProvSpecialty
O | Referring Provider Full Name | ReferProvFullNameOrig
O | Referring Provider First Name | ReferProvFirstName
O | Referring Provider Middle Name | ReferProvMidName
O | Referring Provider Last Name | ReferProvLastName
O | Referring Provider Credentials | -
O | Referring Provider NPI | ReferProvNPI
O | Referring Provider Primary Specialty | ReferProvSpecialty
""",
    "payroll": """
R | Employee ID | EmployeeId
R | Employee Full Name | EmployeeFullName
R | Job Code ID | JobCode
R | Job Code Description | JobCodeDesc
R | Department ID | DepartmentId
R | Pay Period Start Date | PayPeriodStartDate
R | Pay Period End Date | PayPeriodEndDate
R | Earnings Code | EarningsCode
R | Earnings Description | EarningsCodeDesc
R | Hours | Hours
R | Amount | AmountOrig
M | Provider ID | EmployeeId
M | Employee First Name | EmployeeFirstName
M | Employee Middle Name | EmployeeMiddleName
M | Employee Last Name | EmployeeLastName
M | Employee NPI | EmployeeNpi
M | Department Name | DepartmentName
O | Check/Pay Date | CheckDate
""",
    "gl": """
R | Cost Center Number | CostCenterNumberOrig
R | Cost Center Name | CostCenterNameOrig
R | Report Date | YearMonth
R | Account # | AcctNumber
R | Account Description | AcctDesc
R | Amount | AmountOrig
M | Account Type | -
O | Sub-Account Number | SubAcctNumber
O | Sub-Account Desc | SubAcctDesc
""",
    "quality": """
R | Provider NPI | =
R | Measurement Period Start Date | =
R | Measurement Period End Date | =
R | Measure Number | =
R | Is_Inverse | =
R | Denominator | =
R | Exclusions/Exceptions | =
R | Numerator | =
R | Performance Rate | =
O | Provider Name | =
O | Measure Description | =
O | Initial Population | =
O | Benchmark Target | =
""",
    "patient_satisfaction": """
R | Provider NPI | =
R | Survey Date Range Start | =
R | Survey Date Range End | =
R | Survey Question Full | =
R | Question Order | =
R | Score | =
O | Provider Name | =
O | Survey Question Abbreviated | =
O | Number of Respondents | =
O | Standard Deviation | =
O | Benchmarking Filter | =
O | Benchmark 1 | =
O | Benchmark 2 | =
""",
}
LEVELS = {"R": "required", "M": "recommended", "O": "optional", "C": "conditional_required"}


class Field(NamedTuple):
    source: str
    level: str
    header: str
    targets: tuple[str, ...]  # empty: nothing to check
    by_header: bool


def fields(source: str) -> list[Field]:
    out = []
    for line in filter(None, _TEXT.get(source, "").splitlines()):
        level, header, targets = (part.strip() for part in line.split("|"))
        names = () if targets in ("-", "=") else tuple(t.strip() for t in targets.split(","))
        out.append(Field(source, LEVELS[level], header, names, targets == "="))
    return out


def all_fields() -> list[Field]:
    return [f for source in _TEXT for f in fields(source)]


_LEVEL_RANK = {"required": 3, "recommended": 2, "conditional_required": 2, "optional": 1}


def staging_levels(source: str) -> dict[str, str]:
    """Highest requirement level of every staging column of a source."""
    levels: dict[str, str] = {}
    for f in sorted(fields(source), key=lambda f: -_LEVEL_RANK[f.level]):
        for target in f.targets or ((f.header,) if f.by_header else ()):
            levels.setdefault(target, f.level)
    return levels


# Headers of the required list that the staging load itself does not insist on, and the
# staging columns it insists on although the header is named differently.
_NOT_LOADED = {
    "gl": set(),
    "payroll": set(),
    "scheduling": {"ApptProvNPI"},
    "billing_transactions": set(),
    "billing_charges": {"PatientMrn", "PatientCity", "BillDepartmentId"},
    "billing_combined": {
        "PatientMrn", "PatientCity", "BillDepartmentId", "PaymentOriginal", "TransactionPayerName",
        "TransactionPayerPlan", "TransactionPayerFinancialClass",
    },
}
_LOADED_TOO = {
    "payroll": ["DepartmentName"],
    "scheduling": ["CancellationDate", "CancelReason"],
    "billing_transactions": ["TransactionType"],
}


def required_staging(source: str) -> list[str]:
    """Staging columns that must be covered by some raw column."""
    names = list(_LOADED_TOO.get(source, []))
    for f in fields(source):
        if f.level == "required":
            names += [t for t in f.targets if t not in _NOT_LOADED.get(source, set())]
    return list(dict.fromkeys(names))
