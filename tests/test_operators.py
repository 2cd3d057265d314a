"""Operators against brute force on small fixtures, and the shape of their plans."""

import random

import pytest
from pyspark.sql import functions as F

from ledgersieve.context import ColumnMeta, Context
from ledgersieve.functions import day, day_form, number, pad_code, strip_zeros
from ledgersieve.functions.formula import apply_transforms, is_valid, to_sql
from ledgersieve.functions.similarity import composite, ratio, token_sort
from ledgersieve.operators import fuzzy, issues, keys, profile as prof, quantiles, star
from ledgersieve.plans.registered import STORING
from ledgersieve.sources import config, extracts


def values(df):
    return [tuple(r) for r in df.collect()]


def test_formulas(spark, rows):
    df = rows("a b c d e", ("  x_y_z\t",) * 5)
    got = apply_transforms(df, [
        ("a", "TRIM(x)"), ("b", "SUBSTRING(x, CHARINDEX('q', x) - 1, 3)"), ("c", "SPLIT_PART(x, '_', 2) || LEN(x)"),
        ("d", "SUBSTRING(x, 1, LEN(x) - 99)"), ("e", "CHARINDEX('_', x)"), ("gone", "UPPER(x)"),
    ]).first()
    assert tuple(got) == ("x_y_z", "", "y8", "", "4")
    assert not is_valid(spark, "DROP(x)") and not is_valid(spark, "LEFT(x)") and not is_valid(spark, "x") and is_valid(spark, "RIGHT(x, 0)")
    with pytest.raises(ValueError):
        to_sql("REPLACE(x, '', 'a')", "c")


def test_parsing(rows):
    df = rows("v", ("1d",), ("nan",), (" 12.5 ",), ("1,000",), (None,))
    assert [r[0] for r in values(df.select(number("v")))] == [None, None, 12.5, None, None]
    dates = rows("v", ("2026-01-05",), ("1/5/2026",), ("1/5/70",), ("20260105",), ("2026/01/05",), ("1-5-2026",), ("2026-01-05T10:00",), ("99/99/9999",), ("5 Jan",))
    assert [str(r[0]) for r in values(dates.select(day("v")))] == [
        "2026-01-05", "2026-01-05", "1970-01-05", "2026-01-05", "2026-01-05", "2026-01-05", "2026-01-05", "None", "None"]
    codes = rows("v", ("7",), ("123",), ("000",), ("",))
    assert values(codes.select(pad_code("v"), strip_zeros("v"))) == [("07", "7"), ("123", "123"), ("000", "0"), ("00", "0")]


def test_scores():
    assert ratio("", "") == 100 and ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert token_sort("lee carl", "carl lee") == 100
    assert composite("north clinic", "north clinic west") >= 85 and composite("annex", "nation 5") < 80
    assert composite("a", "b a c") == 90


@pytest.mark.parametrize("threshold, scorer, score", [(85, "token_sort", token_sort), (80, "token_sort", token_sort), (60, "ratio", ratio), (80, "composite", composite)])
def test_best_match_is_exact(rows, threshold, scorer, score):
    rng = random.Random(threshold)
    words = ["cardio", "cardiology", "north", "northern", "clinic", "west", "a", "of", "ortho", "gi"]
    left = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)} | {"a", "x", "clinik", "nroth"})
    right = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)} | {"g", "clinics"})
    got = {r.text: (r.best, round(r.score, 6)) for r in fuzzy.best_match(
        rows("text", *[(t,) for t in left]), rows("text", *[(t,) for t in right]), threshold, scorer).collect()}
    want = {}
    for a in left:
        s, b = min((-score(a, b), b) for b in right)
        if -s >= threshold:
            want[a] = (b, round(-s, 6))
    assert got == want


def test_signatures_that_many_share(rows):
    left = [f"zone {c} clinic" for c in "abcdefgh"]
    got = fuzzy.best_match(rows("text", *[(t,) for t in left]), rows("text", ("zone a clinic",), ("zone b clinic",)), 80)
    want = {t: max(token_sort(t, "zone a clinic"), token_sort(t, "zone b clinic")) for t in left}
    assert {r.text: r.score for r in got.collect()} == {t: s for t, s in want.items() if s >= 80}


@pytest.mark.parametrize("threshold", [80, 60])
def test_crowds_are_searched_without_pairs(rows, monkeypatch, threshold):
    """Names of one pattern share nearly all grams; cut into several parts, the best of them is found without a pair of each."""
    monkeypatch.setattr(fuzzy, "CROWDED", 20)
    monkeypatch.setattr(fuzzy, "SEARCHED_RIGHT", 50)
    monkeypatch.setattr(fuzzy, "SEARCHED_LEFT", 30)
    right = [f"supplier#{i:09d}" for i in range(0, 400, 3)] + [f"supplier {i}" for i in range(0, 300, 7)] + ["", "x"]
    left = [f"supplier {i}{' jr' * (i % 2)}" for i in range(0, 500, 6)] + [f"supplier {i}" for i in range(1, 99, 9)] + ["", "zz", "supplier#00000001"]
    sides = [rows("text", *[(t,) for t in side]).selectExpr("'' AS scope", "text", "array_join(array_sort(filter(split(text, ' '), t -> t <> '')), ' ') AS match") for side in (left, right)]
    signed = fuzzy.signatures(*sides, threshold)
    rest = signed[1].join(fuzzy._crowds(signed[1]), ["scope", "gram"], "left_anti")
    got = {r.text: (r.best, round(r.score, 6)) for r in fuzzy.best_match(*sides, threshold).collect()}
    best = {a: min((-token_sort(a, b), b) for b in right) for a in left}
    assert got == {a: (b, round(-s, 6)) for a, (s, b) in best.items() if -s >= threshold}
    assert signed[0].join(rest, ["scope", "gram"]).count() < 0.25 * len(left) * len(right) < signed[0].join(signed[1], ["scope", "gram"]).count()


def test_quantiles_by_brute_force(spark):
    rng = random.Random(1)
    data = [("a", rng.choice([-5.0, 0.0, 3.25, 1e6]) + rng.randint(0, 9)) for _ in range(301)] + [("b", 7.0)] * 50 + [("c", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.q1, r.q2, r.total) for r in quantiles.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    want = {r.k: (*r.p, r.n) for r in df.groupBy("k").agg(F.expr("percentile(v, array(0.25, 0.5))").alias("p"), F.count("*").alias("n")).collect()}
    assert got == want


def test_duplicates_narrow_and_wide(rows):
    narrow = rows("a b", ("1", "2"), ("1", "2"), ("1", None), ("1", None), ("1", "3"))
    assert values(keys.full_row_duplicates(narrow)) == [(2, 4, 5)]
    wide = narrow.select("*", *[F.lit(i).alias(f"c{i}") for i in range(20)])
    assert values(keys.full_row_duplicates(wide)) == [(2, 4, 5)]
    zeros = narrow.select(F.when(F.col("b") == "2", F.lit(-0.0)).otherwise(F.lit(0.0)).alias("z"))
    assert values(keys.full_row_duplicates(zeros)) == [(1, 5, 5)]


def test_one_scan_and_one_shuffle(rows):
    df = rows("PostDate Units", ("2026-01-01", "1"))
    ctx = Context("billing_charges", columns=(ColumnMeta("PostDate", sql_type="date"), ColumnMeta("Units", sql_type="int")))
    plan = prof.profile(df, ctx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") <= 1
    overlap = keys.presence(df, "PostDate", df, "Units")._jdf.queryExecution().executedPlan().toString()
    assert overlap.split("== Initial Plan ==")[0].count("Exchange") == 1 and "Join" not in overlap


def test_dimension_load_is_idempotent(rows):
    spec = star.Dimension("D", "DUnbr", {"one": {"name": star.col("a")}, "two": {"name": star.col("b")}})
    first = rows("a b", ("x", "y"), ("x", None))
    dim = star.upsert(None, star.members(first, spec), spec)
    assert sorted(r.name for r in dim.collect()) == ["x", "y", "zzNull"]
    assert star.insert_new(dim, star.members(first, spec), spec).count() == 0
    more = star.upsert(dim, star.members(rows("a b", ("x", "new")), spec), spec)
    assert sorted(r.DUnbr for r in more.collect()) == [1, 2, 3, 4]


def test_footers_bad_lines_and_blank_columns(spark, tmp_path):
    body = ["id , name,empty"] + [f"{i},n{i}," for i in range(30)] + ["total,,", "7,seven,", "Grand Total,,", "1,2,3,4,5", ",,", "EOF,,"]
    path, work = tmp_path / "x.csv", str(tmp_path / "work")
    path.write_text("\n".join(body) + "\n")
    info, df = extracts.read_extract(spark, str(path), work)
    assert info.columns == ("id", "name") and df.columns == ["id", "name"]
    assert (info.row_count, info.footer_rows, info.bad_lines) == (32, 2, 1)  # "total" inside the data stays
    assert df.count() == 32
    # Later passes read columns, and only those they ask for.
    text = df.select("name")._jdf.queryExecution().toString()
    assert "parquet" in text and "csv" not in text.lower() and "ReadSchema: struct<c0:string,c1:string,c2:string,__bad:string" in text
    only = tmp_path / "one.txt"
    only.write_text("single\nvalue\n")
    assert extracts.read_extract(spark, str(only), work)[0].issues == (extracts.issue_text("no_delimiter"),)


@pytest.mark.parametrize("body,columns,first", [
    ("Cost Center Number,,Cost Center Name,Account #\n1,x,one,2\n3,,four,5\n", ("Cost Center Number", "Unnamed: 1", "Cost Center Name", "Account #"), ["1", "x", "one", "2"]),
    ("a,b,\n1,2,\n3,4,\n", ("a", "b"), ["1", "2"]),
    ("a\ta\t\n1\t2\t3\n", ("a", "a.1", "Unnamed: 2"), ["1", "2", "3"]),
    ("a|b|\n1|2\n", ("a", "b"), ["1", "2"]),
])
def test_blank_headers_keep_their_place(spark, tmp_path, body, columns, first):
    path = tmp_path / "x.txt"
    path.write_text(body)
    info, df = extracts.read_extract(spark, str(path), str(tmp_path / "work"))
    assert info.columns == columns and info.bad_lines == 0 and info.row_count == body.count("\n") - 1
    assert list(df.first()) == first


def test_encoding_and_line_breaks(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("a|b\né|1\n".encode("latin-1"))
    _, df = extracts.read_extract(spark, str(tmp_path / "latin.txt"), str(tmp_path / "work"), encoding="ISO-8859-1")
    assert df.first().a == "é"
    (tmp_path / "broken.csv").write_text('a,b,c\n1,"two\nlines",3\n4,5,6\n')
    info, _ = extracts.read_extract(spark, str(tmp_path / "broken.csv"), str(tmp_path / "work"))
    assert extracts.issue_text("open_quotes", 2) in info.issues
    info, df = extracts.read_extract(spark, str(tmp_path / "broken.csv"), str(tmp_path / "work"), multi_line=True)
    assert info.row_count == 2 and sorted(r.b for r in df.collect()) == ["5", "two\nlines"]


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("gl", "payroll"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "data.txt").write_text(f"a|b\n{folder}|1\n")
    files = extracts.read_submission(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert {name: df.first().a for name, (_, df) in files.items()} == {"gl/data.txt": "gl", "payroll/data.txt": "payroll"}
    named = {r.file: r.source for r in config_overrides(spark, tmp_path, list(files))}
    assert named == {"gl/data.txt": "payroll", "payroll/data.txt": "gl"}


def config_overrides(spark, tmp_path, files):
    (tmp_path / "in" / "sources.csv").write_text("Filename,Source\ndata.txt,payroll\npayroll/data.txt,gl\n")
    return config.source_overrides(spark, str(tmp_path / "in"), files).collect()


@pytest.mark.parametrize("root,path,parts", [
    ("file:/in/acme", "file:/in/acme/gl/x.txt", ["gl", "x.txt"]),
    ("/in/acme/", "file:/in/acme/x.txt", ["x.txt"]),
    ("hdfs://nn:8020/shared/in/acme", "hdfs://nn:8020/shared/in/acme/gl/x.txt", ["gl", "x.txt"]),
    ("/shared/in/acme", "hdfs://nn:8020/shared/in/acme/gl/x.txt", ["gl", "x.txt"]),
    ("hdfs:///in", "hdfs://nn:8020/in/x.txt", ["x.txt"]),
    ("s3a://bucket/in", "s3a://bucket/in/gl/x.txt", ["gl", "x.txt"]),
    ("s3a://bucket", "s3a://bucket/gl/x.txt", ["gl", "x.txt"]),
    ("s3a://bucket/in", "s3a://other/in/x.txt", None),
    ("/in/ac", "/in/acme/x.txt", None),
])
def test_paths_below_a_folder(root, path, parts):
    assert extracts.below(root, path) == parts


def test_next_round_and_verdicts(rows):
    df = rows("round", ("v1",), ("v3",), ("pilot",))
    assert [r[0] for r in values(df.select(issues.next_round(F.col("round"))))] == [
        "v2", "v4 (beyond the rounds agreed)", "pilot+1"]


def test_dedup_keeps_schema_issue(spark):
    from ledgersieve.findings import SCHEMA

    base = dict.fromkeys(SCHEMA)
    made = [
        base | {"client": "c", "round": "v1", "source_group": "billing", "phase": 2, "check_id": "schema_missing", "severity": "CRITICAL", "staging_column": "A"},
        base | {"client": "c", "round": "v1", "source_group": "billing", "phase": 3, "check_id": "null_blank", "severity": "CRITICAL", "staging_column": "A", "pct": 100.0, "affected": 40},
        base | {"client": "c", "round": "v1", "source_group": "gl", "phase": 3, "check_id": "null_blank", "severity": "HIGH", "staging_column": "A", "pct": 100.0},
    ]
    df = spark.createDataFrame([tuple(m.values()) for m in made], ", ".join(f"{c} {t}" for c, t in SCHEMA.items()))
    got = {(r.source_group, r.check_id): (r.deduplicated, r.affected) for r in issues.deduplicate(issues.issues(df)).collect()}
    assert got == {("billing", "schema_missing"): (False, 40), ("billing", "null_blank"): (True, 40), ("gl", "null_blank"): (False, None)}




def test_planning_starts_no_job(spark):
    """Building a registered query runs nothing, save those that store a step."""
    import __spark_entry__ as entry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    skipped = {n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()} | {"pipeline"} | STORING
    for name, build in entry.queries().items():
        if name not in skipped:
            build(spark, "/root/testdata/sf0.001")
            assert not tracker.getJobIdsForGroup("planning"), name
    spark.sparkContext.setJobGroup("other", "other")


@pytest.mark.parametrize("threshold", [45, 80, 97])
def test_composite_match_loses_no_pair(spark, threshold):
    """The best composite match against all pairs, with tokens that many texts share."""
    rng = random.Random(threshold)
    words = ["north", "clinic", "clinic", "clinic", "east", "st", "a", "medical", "center", "centre", "of", "ortho", "orthopedics", "x1"]

    def text():
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 7])))
        for _ in range(rng.randint(0, 2)):
            i = rng.randint(0, len(t))
            t = t[:i] + rng.choice(["", "e", "q", " ", "-"]) + t[i + rng.randint(0, 1):]
        return t

    lefts, rights = sorted({text() for _ in range(60)}), sorted({text() for _ in range(60)})
    left, right = (spark.createDataFrame([(t,) for t in side], "text string") for side in (lefts, rights))
    form = lambda t: "".join(c if c.isalnum() else " " for c in t).strip(" ").lower()
    want = {}
    for a in lefts:
        score, best = max(((composite(form(a), form(b)), b) for b in rights), key=lambda p: (p[0], [-ord(c) for c in p[1]] + [1]))
        best = min(b for b in rights if composite(form(a), form(b)) == score)
        if score >= threshold:
            want[a] = (best, round(score, 9))
    got = {r.text: (r.best, round(r.score, 9)) for r in fuzzy.best_match(left, right, threshold, "composite").collect()}
    assert got == want


def test_composite_match_makes_few_pairs(spark):
    """A token that all texts share makes no pairs of all with all."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    lefts, rights = [[f"clinic {name()} {name()}" for _ in range(n)] for n in (400, 500)]
    prepared = [spark.createDataFrame([("", t, t) for t in side], "scope string, text string, match string") for side in (lefts, rights)]
    assert fuzzy.composite_pairs(*prepared, 80).count() < 0.1 * len(lefts) * len(rights)


def test_quantiles_of_values_that_share_a_bucket(spark):
    """Time stamps lie in one magnitude bucket: what is sorted is a small part of them."""
    start = 1_700_000_000
    df = spark.range(0, 40_000, 1, 8).select(F.lit("k").alias("key"), (F.lit(start) + F.col("id") * 7 % 39_989).cast("double").alias("v"))
    counts = quantiles.value_counts(df, ["key"], "v")
    assert counts.select("bucket").distinct().count() == 1
    values_ = sorted(start + i * 7 % 39_989 for i in range(40_000))
    got = quantiles.from_counts(counts, ["key"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.99}).first()
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.99)):
        low = int(p * 39_999)
        assert got[name] == pytest.approx(values_[low] + (values_[low + 1] - values_[low]) * (p * 39_999 - low), abs=1e-6)
    sorted_rows = [m for m in _rows_into_sorts(quantiles.from_counts(counts, ["key"], "v", {"q2": 0.5}))]
    assert sorted_rows and min(sorted_rows) < 100


def _rows_into_sorts(df):
    """Rows that each window of the plan that ran took in, by its input's metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            found.append(metrics.get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_unchanged_files_are_not_parsed_again(spark, tmp_path, monkeypatch):
    folder, inventory = tmp_path / "in", str(tmp_path / "inventory")
    folder.mkdir()
    for i in range(9):
        (folder / f"f{i}.txt").write_text(f"a|b|c\n1|x{i}|\n2|y|\nTotal: 2||\n")
    (folder / "bare.txt").write_text("no delimiter here\n1\n")
    scans = []
    scan = extracts._scan
    monkeypatch.setattr(extracts, "_scan", lambda *a: scans.append(a[1]) or scan(*a))

    def read():
        found = extracts.read_submission(spark, str(folder), str(tmp_path / "work"), inventory=inventory)
        return {name: (info, df and sorted(map(tuple, df.collect()))) for name, (info, df) in found.items()}

    first = read()
    assert len(scans) == 9 and first["bare.txt"][1] is None
    assert read() == first and len(scans) == 9
    (folder / "new.txt").write_text("a|b\n7|8\n")
    again = read()
    assert len(scans) == 10 and again.pop("new.txt")[1] == [("7", "8")] and again == first
    (folder / "f3.txt").write_text("a|b|c\n1|changed|\n")
    assert read()["f3.txt"][1] == [("1", "changed")] and len(scans) == 11


def _day_fact():
    dates = star.Dimension("D", "DUnbr", {r: {"date": star.a_date(r)} for r in ("a", "b")}, required=True, kinds={"date": "date"})
    names = star.Dimension("N", "NUnbr", {"row": {"first": star.Expression(star.plain, ("x",)), "last": star.Expression(star.plain, ("y",))}})
    return star.Fact("F", [dates, names], {"aFnbr": ("D", "a"), "bFnbr": ("D", "b"), "nFnbr": ("N", "row")}, {"n": star.col("n")})


@pytest.mark.parametrize("bits, lookup_rows", [(64, 200_000), (1, 200_000), (64, 0)])
def test_fact_reads_each_date_once(rows, monkeypatch, bits, lookup_rows):
    """Rows look dates up by their texts, which are read once each; members whose bits are alike are not mixed up."""
    whole = star._hashed
    monkeypatch.setattr(star, "_hashed", lambda *args: f"pmod({whole(*args)}, {2 ** bits if bits < 64 else 2 ** 62})")
    df = rows(
        "a b x y n", ("2024-01-02", "2024-01-02 10:11:12", None, "p", "1"), (" 2024-01-02", "1/2/2024", "p", None, "2"),
        ("2024-02-30", "2024-01-03T23:59", "p", "p", "3"), (None, "soon", None, None, "4"), ("20240103", "2024-01-03 25:00", "", "p", "5"),
        ("2024-01-1T 1:22:33", "+2024-01-03", None, "p", "6"),
    )
    fact = _day_fact()
    # Reading all shapes of a date for every row made the code of the pass too long for the JVM to compile.
    assert "gettimestamp" not in star.stacked_forms(df, fact.dimensions)._jdf.queryExecution().toString()
    members, built = star.load_fact(df, fact, lookup_rows=lookup_rows)
    at = {(r.dimension, r.key): tuple(r.attributes) for r in members.collect()}
    assert sorted(at.values(), key=str) == sorted(
        [("2024-01-02",), ("2024-01-03",), (None, "p"), ("p", None), ("p", "p"), (None, None), ("", "p")], key=str)
    got = {r.n: (at.get(("D", r.aFnbr)), at.get(("D", r.bFnbr)), at[("N", r.nFnbr)]) for r in built.collect()}
    second, third = ("2024-01-02",), ("2024-01-03",)
    assert built.count() == 6 and got == {
        "1": (second, second, (None, "p")), "2": (second, second, ("p", None)), "3": (None, third, ("p", "p")),
        "4": (None, None, (None, None)), "5": (third, None, ("", "p")), "6": (None, None, (None, "p")),
    }


def test_form_of_a_date_is_read_as_the_same_day(rows):
    texts = ["2024-01-02", "2024-01-02 10:11", "2024-01-02T10:11:12.5", "2024-01-02T23:30-05:00", "2024-1-2 10:11:12", "2024-01-02 1:02:33",
             "2024-01-02 01:2:33.1", "0000-01-01 00:00+10:00", "9999-12-31 23:59-10:00", " 2024-01-02 10:11 ", "1/2/24", "20240102", "2024-13-02 10:11", "", None]
    got = rows("t", *[(t,) for t in texts]).select("t", day("t").cast("string").alias("a"), day(day_form("t")).cast("string").alias("b"), day_form("t").alias("f")).collect()
    assert [r.t for r in got if r.a != r.b] == []
    assert {r.f for r in got if r.t and r.t.startswith("2024-01-02") and r.t[10:16] in ("", " 10:11", "T10:11")} == {"2024-01-02"}
