from datetime import date

import pytest

from tallyweave.operators import timesheets as ops
from tallyweave.sources import timesheet_files as files

COLUMNS = "row_order string, resource_name string, date_worked string, investment_id string, hours string, task_name string, time_sheet_status string, charge_code string, investment_name string"
ROWS = [
    ("1", "Zarton, Balran", "5/11/26", "PR1", "20.00", "Build", "Posted", "U-Capital", "One"),
    ("2", "Zarton, Balran", "5/11/26", "PR1", "10.00", "Build", "Posted", "U-Capital", None),
    ("3", "Zarton, Balran", "5/11/26", "PR2", "5.00", "Build", "Posted", "X-Operating", "Two"),
    ("4", "Zarton, Balran", "5/12/26", "PR1", "8.00", "Time Off", "Posted", None, "One"),
    ("5", "Wenton, Dorbet", "5/12/26", "PR1", "7.00", "PTO", "Posted", None, "One"),
    ("6", "Wenton, Dorbet", "5/13/26", "PR1", "4.00", "Build", "Returned", None, "One"),
    ("7", "Wenton, Dorbet", "5/14/26", None, "3.00", "Build", "Posted", None, None),
    ("8", "Wenton, Dorbet", "5/15/26", "PR1", "bad", "Build", "Posted", None, "One"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_import_and_reimport(raw):
    rows = {(r.contractor_name, r.date_worked, r.project_id): r for r in ops.import_rows(raw).collect()}
    assert len(rows) == 7
    assert rows[("Balran Zarton", date(2026, 5, 11), "PR1")].hours == 30.0
    assert rows[("Balran Zarton", date(2026, 5, 12), "PR1")].is_time_off
    assert not rows[("Dorbet Wenton", date(2026, 5, 13), "PR1")].is_posted
    assert rows[("Dorbet Wenton", date(2026, 5, 14), None)].hours == 3.0
    assert rows[("Dorbet Wenton", date(2026, 5, 15), "PR1")].hours == 0.0
    stored, projects = ops.import_rows(raw), ops.projects_of(raw)
    first = ops.import_counters(raw, stored.limit(0), projects.limit(0)).first()
    again = ops.import_counters(raw, stored, projects).first()
    assert (first.source_rows, first.aggregated_rows, first.timesheets_created, first.projects_created) == (8, 7, 7, 2)
    assert (again.timesheets_created, again.timesheets_updated, again.projects_created) == (0, 7, 0)
    assert {(r.project_id, r.project_name, r.capex_opex) for r in projects.collect()} == {("PR1", "One", "CAPEX"), ("PR2", "Two", "OPEX")}


def test_date_spellings_collapse(spark):
    one = spark.createDataFrame([("1", "Zarton, Balran", "5/11/26", "PR1", "8.0")], "row_order string, resource_name string, date_worked string, investment_id string, hours string")
    other = spark.createDataFrame([("1", "Zarton, Balran", "2026-05-11T00:00:00", "PR1", "6.0")], one.schema)
    merged = ops.upsert_timesheets(ops.import_rows(one, 0), ops.import_rows(other, 1)).collect()
    assert [(r.hours, r.is_posted) for r in merged] == [(6.0, True)]
    both = one.unionByName(other)
    assert ops.import_rows(both).first().hours == 8.0  # the later group in key order overwrites
    assert ops.import_rows(both, dedupe="sum").first().hours == 14.0


def test_status_change_is_a_second_row_unless_superseded(spark, raw):
    submitted = raw.filter("row_order = '3'").replace("Posted", "Submitted", "time_sheet_status")
    stored, incoming = ops.import_rows(submitted, 0), ops.import_rows(raw.filter("row_order = '3'"), 1)
    assert ops.upsert_timesheets(stored, incoming).count() == 2
    kept = ops.upsert_timesheets(stored, incoming, supersede=True).collect()
    assert [r.time_sheet_status for r in kept] == ["Posted"]


def test_required_columns():
    with pytest.raises(ValueError, match="Date Worked"):
        files.require_columns(["Resource Name", "Investment ID", "Time Entry Hours"])


def test_csv_encodings(spark, tmp_path):
    header = "Resource Name,Date Worked,Investment ID,Time Entry Hours,Task Name\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (header + '"Núñez, Ana",5/11/26,NA,8.0,\n').encode())
    (tmp_path / "b.csv").write_bytes((header + '"Núñez, Ana",5/12/26,PR1,4.0,“x”\n').encode("cp1252"))
    rows = files.read_timesheet_folder(spark, str(tmp_path)).orderBy("date_worked").collect()
    assert [(r.resource_name, r.investment_id, r.task_name) for r in rows] == [("Núñez, Ana", "NA", None), ("Núñez, Ana", "PR1", "“x”")]


def test_csv_mixed_headers_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Resource Name,Date Worked,Investment ID,Time Entry Hours\n\"Roe, Jan\",5/11/26,PR1,8.0\n")
    (tmp_path / "b.csv").write_text(
        'Date Worked,Task Name,Time Entry Hours,Other,Investment ID,Resource Name,Task Name\n'
        '5/12/26,"say ""hi"", then\nrest",4.0,x,PR2,"Roe, Jan",second\n5/13/26,,1.0,,PR2,"Poe, Ann",second\n'
    )
    (tmp_path / "empty.csv").write_text("")
    rows = files.read_timesheet_folder(spark, str(tmp_path)).orderBy("date_worked").collect()
    assert [(r.resource_name, r.date_worked, r.investment_id, r.hours, r.task_name) for r in rows] == [
        ("Roe, Jan", "5/11/26", "PR1", "8.0", None),
        ("Roe, Jan", "5/12/26", "PR2", "4.0", 'say "hi", then\nrest'),
        ("Poe, Ann", "5/13/26", "PR2", "1.0", None),
    ]
    (tmp_path / "c.csv").write_text("Resource Name,Date Worked\nx,y\n")
    with pytest.raises(ValueError, match="Time Entry Hours"):
        files.read_timesheet_folder(spark, str(tmp_path))


def test_nested_payload(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"resourceId":"7","resourceName":"Zarton, Balran","status":{"displayValue":"Posted"},"timePeriodStart":"2026-05-11T00:00:00",'
        '"timePeriodFinish":"2026-05-17T00:00:00","timeEntries":[{"investmentCode":"PR1","actuals":{"segmentList":{"segments":['
        '{"start":"2026-05-11T00:00:00","value":28800},{"start":"2026-05-12T00:00:00","value":0}]}}},{"investmentCode":"PR2"}]}'
    )
    payload = files.read_payload(spark, str(tmp_path))
    known = spark.createDataFrame([("7",)], "resource_id string")
    rows = files.flatten_payload(files.period_pushdown(payload, known, "2026-05-10", "2026-05-17")).collect()
    assert [(r.investment_id, r.hours) for r in rows] == [("PR1", 8.0)]
    none = files.flatten_payload(files.period_pushdown(payload, known, "2026-05-12", None))
    assert none.count() == 0 and len(none.columns) == 12


def test_a_torn_file_in_several_tasks_equals_the_whole_reading(spark, tmp_path):
    """Line breaks, doubled quotes and commas in cells, over many splits; cells of several splits; an open quote at the end; Windows text."""
    import csv
    import random

    rng = random.Random(5)
    header = list(files.REQUIRED) + ["Task Name"]

    def cell(i):
        odd = rng.random()
        if odd < 0.15:
            return "\n".join(rng.choice(["a", '"q"', ",", "é", ""]) for _ in range(rng.randrange(2, 6)))
        return '5" pipe' if odd < 0.2 else f"cell {i}" if odd < 0.9 else ""

    def content(n, long):
        rows = [[f"Person {i}", "2024-01-02", f"P{i}", "1.0", cell(i)] for i in range(n)]
        rows[n // 2][4] = "x\n" * long + "y"
        return rows

    made = {"utf-8": content(400, 3000), "cp1252": content(300, 1)}
    for encoding, rows in made.items():
        with open(tmp_path / f"{encoding}.csv", "w", newline="", encoding=encoding) as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(header)
            writer.writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for encoding, rows in made.items():
            got = files.read_timesheet_csv(spark, [str(tmp_path / f"{encoding}.csv")], header, encoding, torn=True)
            assert spark.read.text(str(tmp_path / f"{encoding}.csv")).rdd.getNumPartitions() > 3
            seen = [(r["Resource Name"], r["Task Name"]) for r in got.orderBy("row_order").collect()]
            assert seen == [(r[0], r[4] or None) for r in rows]
        whole = sorted((r["resource_name"], r["task_name"] or "") for r in files.read_timesheet_folder(spark, str(tmp_path)).collect())
        assert whole == sorted((r[0], r[4]) for rows in made.values() for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
