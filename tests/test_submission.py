"""A small two-round submission from text files to the verdict."""

import pytest
from pyspark.sql import functions as F

from ledgersieve.operators import issues as iss
from ledgersieve.plans.star_load import load_star
from ledgersieve.plans.submission import References, review
from ledgersieve.sources import sinks

CHARGES = """Charge ID|Post Date|Date of Service|CPT-4 Code|Work RVUs|Charge Amount|Units|Cost Center|Department Name|Rendering Provider NPI|Rendering Provider Full Name|Patient MRN|Dept_Extra
c1|2026-01-05|2026-01-04|99213|0|100.00|1|18748|Cardiology|1000000001|Smith, Ann|00123|a
c2|2026-01-06|2026-01-05|99213-25|1.3|250.00|1|18748|Cardiology|1000000001|Smith, Ann|00124|b
c3|2026-01-07|2026-01-06|80053|0||1|18749|Pediatrics|1234567890|Jones, Bob|00125|c
Total||||||||||||
"""
TRANSACTIONS = """Transaction ID|Transaction Description|Post Date|Payment Amount|Adjustment Amount|Refund Amount|Charge ID
t1|Payment|2026-01-09|-80.00|-20.00|0|c1
t2|Payment|2026-01-09|-10.00|0|0|c9
"""
LEDGER = """Cost Center Number,Cost Center Name,Report Date,Account #,Account Description,Amount
18748,Cardiology Clinic,202601,4000,Gross charges,350
18748,Cardiology Clinic,202601,5000,Physician compensation,-200
18749,Pediatrics Clinic,202601,5100,Staff salaries,-50
"""
PAYROLL = """Employee ID|Employee Full Name|Job Code ID|Job Code Description|Department ID|Pay Period Start Date|Pay Period End Date|Earnings Code|Earnings Description|Hours|Amount|Employee NPI
e1|Ann Smith|1|Physician|8818748000|2026-01-01|2026-01-14|R|REG PAY|80|9000|1000000001
e2|Carl Lee|2|Registered Nurse|8818749000|2026-01-01|2026-01-14|R|REG PAY|-40|900|
"""
QUALITY = """Provider NPI|Measurement Period Start Date|Measurement Period End Date|Measure Number|Is_Inverse|Denominator|Exclusions/Exceptions|Numerator|Performance Rate
1000000001|2026-01-01|2026-01-31|CMS122v12|Y|50|0|80|105
"""
ALIASES = """RawColumn,StagingColumn,Staging_Table
Charge ID,ChargeId,#staging_charges
Post Date,PostDate,#staging_charges
Date of Service,DateOfService,#staging_charges
CPT-4 Code,CptCode,#staging_charges
Work RVUs,WorkRvuOriginal,#staging_charges
Charge Amount,ChargeAmountOriginal,#staging_charges
Units,Units,#staging_charges
Cost Center,BillDepartmentName,#staging_charges
Department Name,BillDepartmentName,#staging_charges
Rendering Provider NPI,RenderingProviderNpi,#staging_charges
Rendering Provider Full Name,RenderingProviderFullName,#staging_charges
Patient MRN,PatientId,#staging_charges
Patient MRN,PatientMrn,#staging_charges
ChargeID,ChargeId,#staging_transactions
Transaction Description,TransactionTypeDesc,#staging_transactions
Post Date,PostDate,#staging_transactions
Payment Amounts,PaymentOriginal,#staging_transactions
Adjustment Amount,AdjustmentOriginal,#staging_transactions
Refund Amount,RefundOriginal,#staging_transactions
Cost Center Number,CostCenterNumberOrig,#staging_gl
Cost Center Name,CostCenterNameOrig,#staging_gl
Report Date,YearMonth,#staging_gl
Account #,AcctNumber,#staging_gl
Account Description,AcctDesc,#staging_gl
Amount,AmountOrig,#staging_gl
Employee ID,EmployeeId,#staging_payroll
Employee Full Name,EmployeeFullName,#staging_payroll
Employee NPI,EmployeeNpi,#staging_payroll
Job Code ID,JobCode,#staging_payroll
Job Code Description,JobCodeDesc,#staging_payroll
Department ID,DepartmentId,#staging_payroll
Pay Period Start Date,PayPeriodStartDate,#staging_payroll
Pay Period End Date,PayPeriodEndDate,#staging_payroll
Earnings Code,EarningsCode,#staging_payroll
Earnings Description,EarningsCodeDesc,#staging_payroll
Hours,Hours,#staging_payroll
Amount,AmountOrig,#staging_payroll
"""
STRUCTURE = """Staging_Table,Source_Column,Type,Max_Length,Precision,Scale
#staging_charges,ChargeId,varchar,150,,
#staging_charges,PostDate,date,,,
#staging_charges,CptCode,varchar,30,,
#staging_charges,ChargeAmountOriginal,decimal,,14,2
#staging_charges,RenderingProviderNpi,varchar,20,,
#staging_gl,AmountOrig,decimal,,14,2
#staging_payroll,Hours,decimal,,7,2
"""


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("submission")
    for name, body in {
        "billing_charges/charges.txt": CHARGES, "txn.txt": TRANSACTIONS, "ledger.csv": LEDGER, "pay.txt": PAYROLL, "q.txt": QUALITY,
        "sources.csv": "Filename,Source\npay.txt,payroll\nq.txt,nonsense\n",
        "column_transforms.csv": "StagingColumn,Formula\nPatientId,TRIM(UPPER(x))\nUnits,DROP(x)\n",
    }.items():
        path = root / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    refs = root / "refs"
    refs.mkdir()
    (refs / "aliases.csv").write_text(ALIASES)
    (refs / "structure.csv").write_text(STRUCTURE)
    return str(root / "in"), str(refs), str(root / "out")


def test_review_needs_a_shared_folder(spark, folders):
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="work="):
            review(spark, folders[0], References.read(spark, folders[1]), "acme", "v1")


@pytest.fixture(scope="module")
def result(spark, folders):
    found = review(spark, folders[0], References.read(spark, folders[1]), "acme", "v1", work=folders[2] + "-work")

    return found


def test_files_and_sources(result):
    files = {r.file: r for r in result.files.collect()}
    assert files["billing_charges/charges.txt"].row_count == 3 and files["billing_charges/charges.txt"].footer_rows == 1
    assert files["ledger.csv"].delimiter == ","
    assert any("comma" in i for i in files["ledger.csv"].issues)
    sources = {r.file: r.source for r in result.sources.collect()}
    assert sources == {
        "billing_charges/charges.txt": "billing_charges", "txn.txt": "billing_transactions", "ledger.csv": "gl", "pay.txt": "payroll", "q.txt": "quality",
    }
    assert result.billing_format.first().format == "separate"


def test_mapping(result):
    rows = {(r.file, r.raw): r for r in result.column_map.collect()}
    assert rows["billing_charges/charges.txt", "Charge ID"].confidence == "EXACT"
    assert rows["txn.txt", "Charge ID"].confidence == "NORMALIZED"
    assert rows["txn.txt", "Payment Amount"].confidence == "FUZZY"
    assert rows["billing_charges/charges.txt", "Dept_Extra"].confidence == "UNMAPPED"
    # five-digit codes under a name column go to the id column
    assert rows["billing_charges/charges.txt", "Cost Center"].staging == "BillDepartmentId"
    assert rows["billing_charges/charges.txt", "Patient MRN"].staging_cols == ["PatientId", "PatientMrn"]
    assert rows["billing_charges/charges.txt", "Post Date"].level == "required" and rows["billing_charges/charges.txt", "Post Date"].sql_type == "date"


def test_findings(result):
    rows = result.findings.collect()
    got = {(r.check_id, r.source, r.severity) for r in rows}
    assert ("B7", "billing_charges", "MEDIUM") in got
    assert ("B3", "billing_charges", "HIGH") in got
    assert ("P1", "payroll", "HIGH") in got
    assert ("Q1", "quality", "HIGH") in got and ("Q2", "quality", "HIGH") in got
    assert ("placeholder_data", "billing_charges", "HIGH") in got
    assert ("G4", "gl", "HIGH") in got
    assert any(r.check_id == "C0a" and r.pct == 50.0 and r.severity == "HIGH" for r in rows)
    assert any(r.check_id == "schema_missing" and r.template_field == "Patient Gender" and r.severity == "CRITICAL" for r in rows)
    assert any(r.check_id == "B2" and r.affected == 1 for r in rows)
    assert any(r.severity == "INFO" and "skipped" in r.message for r in rows)
    assert all(r.client == "acme" and r.source_group for r in rows)


def test_verdict(result):
    ready = result.readiness.first()
    assert ready.overall == "Needs Revision (Round v2)"
    assert ready.missing_sources == "scheduling"
    items = result.checklist.collect()
    assert any(r.item == "Scheduling: no file yet, send one of the month of the others" for r in items)
    assert sum(r.priority == "REMINDER" for r in items) == 4


def test_rollups(result):
    centers = {r.CostCenterNumber: r for r in result.cost_centers.collect()}
    assert centers["18748"].Charges == 350.0 and centers["18748"].GL_ProviderPayAmount == -200.0
    assert centers["18748"].QualityRecordCount == 1.0
    providers = {r.ProviderNPI: r for r in result.providers.collect()}
    assert providers["1000000001"].PayrollHours == 80.0 and providers["1000000001"].Charges == 350.0


def test_written_tables_keep_other_rounds(spark, result, folders):
    names = ["findings", "readiness", "files", "client_issues"]
    assert sorted(sinks.write_tables(result, folders[2], names)) == sorted(names)
    sinks.write_tables(result, folders[2], ["files"])
    assert spark.read.parquet(f"{folders[2]}/files").count() == 5
    back = spark.read.parquet(f"{folders[2]}/findings")
    assert back.where("client = 'acme' and round = 'v1'").count() == result.findings.count()


def test_star_load_twice(spark, result, folders):
    star_folder = folders[2] + "-star"
    first = load_star(result, star_folder)
    fact = spark.read.parquet(f"{star_folder}/fact/PayFact")
    staff = spark.read.parquet(f"{star_folder}/dim/PayEmployee")
    joined = fact.join(staff, fact.PayEmpFnbr == staff.PayEmpUnbr)
    assert {(r.PayEmpId, float(r.PayHoursOrig)) for r in joined.collect()} == {("e1", 80.0), ("e2", -40.0)}
    assert first["PayEmployee"] == 2 and first["CostCenter"] == 2
    again = load_star(result, star_folder)
    assert set(again.values()) == {0}
    assert spark.read.parquet(f"{star_folder}/fact/PayFact").count() == 2
    assert {r.source: r.RowsAffected for r in spark.read.parquet(f"{star_folder}/log").collect()} == {
        "payroll": 2, "gl": 3, "billing_charges": 3, "billing_transactions": 2}


def test_second_round(result):
    before = iss.issues(result.findings)
    after = before.where(F.col("check_id") != "B7").withColumn("round", F.lit("v2"))
    status = {r.dedupe_key: r.status for r in iss.round_difference(before, after).collect()}
    assert status["billing|B7|CptCode"] == "resolved"
    assert "persistent" in status.values() and "new" not in status.values()


def test_star_load_that_stopped_adds_nothing(spark, result, folders, monkeypatch):
    """A load that fails between members and facts leaves no trace, and the next one gives the same numbers."""
    from ledgersieve.operators import star
    from ledgersieve.plans.star_load import read_dimension, read_fact

    clean, torn = folders[2] + "-clean", folders[2] + "-torn"
    first = load_star(result, clean)
    build = star.build_fact

    def fails(rows, fact, *args, **more):
        if fact.name == "GlFact":
            raise RuntimeError("lost")
        return build(rows, fact, *args, **more)

    monkeypatch.setattr(star, "build_fact", fails)
    with pytest.raises(RuntimeError):
        load_star(result, torn)
    assert read_dimension(spark, torn, "PayEmployee") is None and read_fact(spark, torn, "PayFact") is None
    monkeypatch.setattr(star, "build_fact", build)
    assert load_star(result, torn) == first
    for name in ("PayEmployee", "CostCenter", "Date"):
        assert sorted(map(str, read_dimension(spark, torn, name).collect())) == sorted(map(str, read_dimension(spark, clean, name).collect()))
    assert read_fact(spark, torn, "PayFact").count() == 2
    assert set(load_star(result, torn).values()) == {0} and read_fact(spark, torn, "GlFact").count() == 3


def test_tables_of_a_failed_write_are_not_in_force(spark, result, folders, monkeypatch):
    from ledgersieve.sources import publish

    path = folders[2] + "-published"
    names = ["files", "findings", "readiness"]
    sinks.write_tables(result, path, names)
    before = {n: sorted(map(str, sinks.read_table(spark, path, n).collect())) for n in names}
    write, done = publish.Publication.write, []

    def fails(self, df, name, *scope, **more):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(name)
        write(self, df, name, *scope, **more)

    monkeypatch.setattr(publish.Publication, "write", fails)
    with pytest.raises(RuntimeError):
        sinks.write_tables(result, path, names)
    assert len(done) == 2
    assert {n: sorted(map(str, sinks.read_table(spark, path, n).collect())) for n in names} == before
    monkeypatch.setattr(publish.Publication, "write", write)
    sinks.write_tables(result, path, names)
    assert {n: sorted(map(str, sinks.read_table(spark, path, n).collect())) for n in names} == before
    assert sinks.read_table(spark, path, "issues") is None
