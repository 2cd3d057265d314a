"""Rule constants.

Everything in this file is a fixed value: word lists, patterns and thresholds
that results depend on.  Patterns are searched without regard to case unless a
rule says otherwise; the order of a list is the order of precedence.
"""

SOURCES = [
    "billing_combined", "billing_charges", "billing_transactions", "scheduling",
    "payroll", "gl", "quality", "patient_satisfaction",
]
SOURCE_GROUP = {
    "billing_combined": "billing",
    "billing_charges": "billing",
    "billing_transactions": "billing",
    "scheduling": "scheduling",
    "payroll": "payroll",
    "gl": "gl",
    "quality": "quality",
    "patient_satisfaction": "patient_satisfaction",
}
GROUP_DISPLAY = {
    "billing": "Billing",
    "scheduling": "Scheduling",
    "payroll": "Payroll",
    "gl": "GL",
    "quality": "Quality",
    "patient_satisfaction": "Patient Satisfaction",
    "cross_source": "Cross-Source",
}
ISSUE_PREFIX = {
    "billing": "B",
    "scheduling": "S",
    "payroll": "P",
    "gl": "G",
    "quality": "Q",
    "patient_satisfaction": "PS",
    "cross_source": "X",
}
STAGING_TABLE = {
    "billing_combined": "#staging_billing",
    "billing_charges": "#staging_charges",
    "billing_transactions": "#staging_transactions",
    "scheduling": "#staging_scheduling",
    "payroll": "#staging_payroll",
    "gl": "#staging_gl",
}
NO_STAGING = ("quality", "patient_satisfaction")
CORE_SOURCES = [
    "billing_combined", "billing_charges", "billing_transactions", "scheduling", "payroll", "gl",
]
EXPECTED_GROUPS = ["billing", "scheduling", "payroll", "gl", "quality"]
CROSS_GROUPS = ["billing", "scheduling", "payroll", "gl"]
CROSS_CHECK_GROUPS = {
    "C0": ["billing"],
    "C1": ["billing", "gl"],
    "C2": ["billing", "payroll"],
    "C3": ["billing", "scheduling"],
    "C4": ["payroll", "gl"],
    "C5": ["scheduling", "gl"],
}

# Headers that give a source away, and how many must be there.
FINGERPRINTS = {
    "billing_combined": ["Transaction Type", "Transaction Description", "Amount", "CPT-4 Code", "Work RVUs"],
    "billing_charges": ["Charge Amount", "CPT-4 Code", "Work RVUs"],
    "billing_transactions": ["Transaction ID", "Payment Amount", "Adjustment Amount", "Refund Amount"],
    "scheduling": ["Appt ID", "Appt Date", "Appt Status", "Appt Type", "Scheduled Length"],
    "payroll": ["Employee ID", "Job Code ID", "Earnings Code", "Pay Period Start Date", "Pay Period End Date"],
    "gl": ["Cost Center Number", "Cost Center Name", "Account #", "Account Description"],
    "quality": ["Measure Number", "Is_Inverse", "Denominator", "Numerator", "Performance Rate"],
    "patient_satisfaction": [
        "Survey Date Range Start", "Survey Date Range End", "Survey Question Full", "Question Order", "Score",
    ],
}
MIN_FINGERPRINT_HITS = 2

# Date column that places a file in a month.
FILTER_DATE = {
    "billing_combined": "PostDate",
    "billing_charges": "PostDate",
    "billing_transactions": "PostDate",
    "scheduling": "ApptDate",
    "payroll": "PayPeriodEndDate",
    "gl": "YearMonth",
    "quality": "Measurement Period End Date",
    "patient_satisfaction": "Survey Date Range End",
}
YEAR_MONTH_RANGE = (200001, 203012)

RECOMMENDED_STAGING = {
    "#staging_charges": ["BillDepartmentId", "BillLocationId", "BillPracticeId"],
    "#staging_scheduling": ["BillLocId", "DeptId", "PracId"],
    "#staging_billing": ["BillDepartmentId", "BillLocationId", "BillPracticeId"],
}
# Organisation columns rerouted between name and id by what their values look like.
ORG_NAME_TO_ID = {
    "BillDepartmentName": "BillDepartmentId",
    "BillLocationName": "BillLocationId",
    "BillPracticeName": "BillPracticeId",
    "DeptNameOrig": "DeptId",
    "PracNameOrig": "PracId",
    "BillLocNameOrig": "BillLocId",
}
ID_LIKE_SHARE = 0.70

CHARGE_ONLY_COLUMNS = ("CptCode", "Units", "WorkRvuOriginal", "PrimaryIcdCode", "SecondaryIcdCodes")
NULLABLE_BY_DESIGN = ("Modifier1", "Modifier2", "Modifier3", "Modifier4")

HEADER_FUZZY = 85
NEAR_MISS = 60
NPI_NAME_FUZZY = 85
NAME_FUZZY = 80
LOCATION_FUZZY = 80
# The composite score: weight of token scores, from which ratio of lengths parts are compared, and their weights up to a ratio.
TOKEN_WEIGHT = 0.95
PARTIAL_FROM = 1.5
PARTIAL_WEIGHTS = [(1.5, 8.0, 0.9), (8.0, float("inf"), 0.6)]

SYSTEM_FRAGMENTS = [
    "rowid", "row_id", "rownum", "seq", "sequence", "lastupdated", "lastupdatedby", "lastmodified",
    "lastmodifiedby", "created_by", "createdby", "updated_by", "updatedby", "extract", "extractdate",
    "extracttime", "import", "importdate", "importid", "systemid", "systemfield", "internal", "etl",
    "batchid", "batchnum", "jobid",
]

# Value formats by domain, and the staging columns they bind to (case matters here).
DOMAIN_PATTERNS = {
    "npi": (r"^\d{10}$", "10-digit numeric"),
    "cpt_code": (r"^\d{5}$|^[A-Za-z]\d{4}$", "5-char: 5 digits (99213) or letter+4 digits (T1015)"),
    "icd10": (r"^[A-TV-Z]\d{2,4}\.?\d{0,4}$", "ICD-10 format: letter + digits, optional decimal"),
    "pos_code": (r"^\d{1,2}$", "1-2 digit numeric CMS place of service code"),
    "zip_code": (r"^\d{5}(-\d{4})?$", "5-digit or ZIP+4 format"),
    "yearmonth": (r"^\d{6}$", "YYYYMM integer (e.g. 202601)"),
    "modifier": (r"^[A-Z0-9]{2}$|^$", "2-character alphanumeric modifier code or blank"),
}
DOMAIN_COLUMNS = {
    "RenderingProviderNpi": "npi",
    "BillingProviderNpi": "npi",
    "ReferringProviderNpi": "npi",
    "EmployeeNpi": "npi",
    "ApptProvNPI": "npi",
    "ReferProvNPI": "npi",
    "CptCode": "cpt_code",
    "PrimaryIcdCode": "icd10",
    "SecondaryIcdCodes": "icd10",
    "PlaceOfServiceCode": "pos_code",
    "PatientZip": "zip_code",
    "BillLocationZip": "zip_code",
    "YearMonth": "yearmonth",
    "Modifier1": "modifier",
    "Modifier2": "modifier",
    "Modifier3": "modifier",
    "Modifier4": "modifier",
}

PLACEHOLDERS = [
    "test", "testing", "xxx", "zzz", "tbd", "n/a", "na", "null", "none", "dummy", "sample", "fake",
    "placeholder", "default", "todo", "temp", "unknown", "john doe", "jane doe", "test patient",
    "mickey mouse", "donald duck", "0000000000", "1111111111", "9999999999", "aaaa", "1234567890",
    "000000", "999999", "test001", "patient1",
]
# Traces of text decoded with the wrong character set, and control characters (case matters).
MOJIBAKE = "Ã©|Ã¡|â€™|Ã¶|Â|Ã[^A-Z]|�"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FOOTER = r"^\s*(total|grand\s*total|record\s*count|count|eof|end\s*of\s*file|summary|page)\s*$"

TIME_SHAPE = r"^\d{1,2}:\d{2}(:\d{2})?(\s*[AaPp][Mm])?$"
INTEGER_SHAPE = r"^-?\d+$"
DECIMAL_SHAPE = r"^-?\d+(\.\d+)?$"

TRANSACTION_TYPES = [
    ("charge", r"charge|chg\b|^c$"),
    ("payment", r"payment|pmt\b|pay\b|^p$"),
    ("adjustment", r"adjust|adj\b|^a$"),
    ("void", r"void|reversal|vd\b|rev\b"),
    ("refund", r"refund|ref\b|^r$"),
]
CHARGE_KEYWORDS = r"chg|charge"
VOID_WORDS = ["void", "reversal", "vd", "rev", "reverse", "reversed", "cancel", "cancelled"]
PAYER_CLASSES = [
    ("Commercial/Managed Care",
     r"commercial|managed care|bcbs|blue cross|blue shield|aetna|uhc|united|cigna|humana|anthem|hmo|ppo|epo|"
     r"pos\b|kaiser|molina|centene|wellpoint|health net|coventry|magellan|beacon"),
    ("Medicare", r"medicare|mcr\b|medicare advantage|ma\b"),
    ("Medicaid", r"medicaid|mcd\b|chip\b|state program|medical assistance"),
    ("Self-Pay", r"self.?pay|self\b|cash|uninsured|self pay|private pay"),
    ("Workers Comp", r"work.?comp|workers.?comp|wc\b|occupational"),
    ("Other Government", r"tricare|va\b|champva|champus|veteran|indian health"),
    ("Other", r"charity|contractual|other"),
]
EVALUATION_CODES = (99202, 99499)
PROCEDURE_CODES = (10000, 69999)
INACTIVE_STATUS = ["D", "B", "I", "DELETED", "BUNDLED"]

APPOINTMENT_STATUS = [
    ("Completed", r"complet|comp\b|arrived|checked.?out|checked out|visit complete"),
    ("Cancelled", r"cancel|canc\b|cx\b|canceled"),
    ("Rescheduled", r"rescheduled|rsch\b|reschedule"),
    ("No Show", r"no.?show|ns\b|noshow"),
    ("Scheduled", r"scheduled|pending|future|open slot"),
    ("Checked In", r"check.?in|checkin\b|arrived|roomed"),
    ("Bumped", r"bump"),
    ("Left Without", r"left without|lwbs|lwot"),
]
NEW_PATIENT = r"new\s*patient|new\s*pt\b|new\s*visit|initial\b|init\b|new\s*consult|^new$"
ESTABLISHED_PATIENT = (
    r"establish|est\s*pt\b|return\b|returning|follow.?up|fu\b|f/u\b|existing|re-visit|revisit"
)

JOB_CLASSES = [
    ("Physician", r"physician|md\b|do\b|doctor|surgeon|hospitalist"),
    ("APP", r"\bapp\b|np\b|nurse\s*pract|pa\b|physician\s*asst|pa-c\b|aprn\b|crna\b"),
    ("RN", r"\brn\b|registered\s*nurse|staff\s*nurse"),
    ("LPN", r"\blpn\b|lvn\b|licensed\s*practical|licensed\s*vocational"),
    ("MA/CNA",
     r"\bma\b|medical\s*asst|medical\s*assistant|cma\b|clinical\s*asst|"
     r"\bcna\b|certified\s*nursing|nursing\s*asst"),
    ("Other Clinical", r"\bnurse\b|clinical|tech\b|technician|therapist|phlebotom"),
    ("Admin/Patient Access",
     r"patient\s*access|front\s*desk|receptionist|registration|scheduler|scheduling|check.?in|"
     r"administrative|admin\b|office\b|clerical|secretary|coordinator|billing\b|coding\b|"
     r"collections|revenue\s*cycle"),
    ("Management", r"manager|director|supervisor|administrator|chief|vp\b|vice\s*pres"),
]
PROVIDER_JOBS = ["Physician", "APP"]
SUPPORT_JOBS = ["RN", "LPN", "MA/CNA", "Other Clinical"]
EARNINGS_CLASSES = [
    ("Overtime", r"overtime|ot\b|o/t\b"),
    ("PTO/Leave", r"pto\b|vacation|sick|holiday|leave|time\s*off|personal\s*day"),
    ("Bonus/Incentive", r"bonus|incentive|productivity|quality\s*pay"),
    ("Call Pay", r"call\s*pay|on.?call|callback"),
    ("Base/Regular", r"regular|base|salary|hourly|straight|reg\b|biweekly|semi.?monthly"),
    ("Benefits/Retirement", r"benefit|retirement|401|403|pension|fica|tax|insurance\s*contrib"),
]
ADJUSTMENT_EARNINGS = r"adj|correct|reversal|reissue"
HOURLY_EARNINGS = r"hourly|regular|hour"
PAY_PERIOD_DAYS = [7, 14, 15, 16, 28, 29, 30, 31]

LEDGER_CATEGORIES = [
    ("Charges",
     r"charge|gross\s*revenue|gross\s*patient\s*rev|patient\s*charge|gross\s*charge|"
     r"fee\s*for\s*service|ffs\s*rev"),
    ("Adjustments",
     r"adjustment|contractual|allowance|write.?off|bad\s*debt|charity|discount|deduction|contra\s*rev"),
    ("Other Revenue",
     r"other\s*rev|other\s*income|misc\s*rev|grant|capitation|incentive\s*rev|meaningful\s*use|"
     r"quality\s*bonus|340b|interest\s*income|rental\s*income"),
    ("Provider Compensation",
     r"physician\s*comp|provider\s*comp|provider\s*sal|physician\s*sal|app\s*sal|app\s*comp|doctor\s*sal|"
     r"md\s*comp|do\s*comp|np\s*sal|pa\s*sal|crna\s*sal|provider\s*bonus|physician\s*bonus|"
     r"provider\s*benefit|physician\s*benefit|provider\s*retire|physician\s*401|provider\s*fica|"
     r"physician\s*payroll"),
    ("Support Staff Compensation",
     r"staff\s*sal|staff\s*wage|support\s*staff|nursing\s*sal|rn\s*sal|lpn\s*sal|ma\s*sal|medical\s*asst|"
     r"clerical\s*sal|admin\s*sal|front\s*desk|patient\s*access|staff\s*benefit|staff\s*retire|"
     r"staff\s*fica|staff\s*payroll|temp\s*labor|agency|overtime"),
    ("Facilities / Occupancy",
     r"rent\b|lease\b|occupancy|building|facility|depreciation|amortization|maintenance|repair|utilities|"
     r"electric|water|janitorial|property\s*tax|property\s*ins"),
    ("Medical Supplies",
     r"medical\s*supply|medical\s*suppl|clinical\s*supply|surgical\s*supply|pharmaceutical|drug\b|vaccine|"
     r"implant|lab\s*supply|reagent"),
    ("Other Operating Expenses",
     r"office\s*supply|office\s*suppl|it\b|technology|software|hardware|telephone|internet|postage|"
     r"printing|travel|education|cme\b|dues|subscription|license\b|insurance\b|legal|consulting|"
     r"professional\s*fee|outsource|billing\s*service|collection|marketing|advertising|recruitment|"
     r"malpractice"),
]
REQUIRED_CATEGORIES = [
    ("Charges", "CRITICAL"),
    ("Adjustments", "HIGH"),
    ("Provider Compensation", "CRITICAL"),
    ("Support Staff Compensation", "HIGH"),
    ("Other Operating Expenses", "MEDIUM"),
]
RECOMMENDED_CATEGORIES = ["Other Revenue", "Facilities / Occupancy", "Medical Supplies"]
UNCLASSIFIED = "Unclassified"

MEASURE_SHAPES = [r"^CMS\d+v\d+$", r"^CMS-?\d+$", r"^QPP-?\d+$", r"^MIPS-?\d+$", r"^\d+$", r"^NQF-?\d+$"]
INVERSE_FLAGS = ["y", "yes", "1", "true", "n", "no", "0", "false"]
NOT_INVERSE_FLAGS = ["", "nan", "n", "no", "0", "false"]
KNOWN_INVERSE_MEASURES = ["CMS122", "CMS122v"]
MEASUREMENT_DAYS = [28, 29, 30, 31, 89, 90, 91, 92, 181, 182, 183, 365, 366]

BILLING_ORG_COLUMNS = [
    "BillDepartmentId", "BillDepartmentName", "BillLocationId", "BillLocationName",
    "BillPracticeId", "BillPracticeName",
]
BILLING_PLACE_COLUMNS = ["BillLocationName", "BillDepartmentName", "BillPracticeName"]
SCHEDULING_PLACE_COLUMNS = ["BillLocNameOrig", "DeptNameOrig", "PracNameOrig"]
SCHEDULING_LEDGER_COLUMNS = ["BillLocNameOrig", "PracNameOrig", "DeptNameOrig", "DeptId"]
OFFSET_SHARE = 0.80
OFFSET_MIN_IDS = 5
NPI_PRESENT_PCT = 10.0

# Keys that should be unique per source (described for the source, not checked by every client).
LOGICAL_KEYS = {
    "billing_combined": ["ChargeId", "PostDate", "TransactionType"],
    "billing_charges": ["ChargeId"],
    "billing_transactions": ["ChargeId", "PostDate"],
    "scheduling": ["ApptId"],
    "payroll": ["EmployeeId", "PayPeriodEndDate", "EarningsCode"],
    "gl": ["CostCenterNumberOrig", "AcctNumber", "YearMonth"],
    "quality": [
        "Provider NPI", "Measurement Period Start Date", "Measurement Period End Date", "Measure Number",
    ],
    "patient_satisfaction": ["Provider NPI", "Survey Date Range Start", "Question Order"],
}

REMINDERS = [
    "All test files must be pipe-delimited (.txt) with headers and no footers",
    "All core test files must cover the same single month of data",
    "Test file data should be reconciled against an internal report before resubmission",
    "Field names and formats should follow the data extract template",
]
NULL_KEY = "zzNull"
