"""Streams over several drops of files."""

from datetime import date

import pytest

from tallyweave.streaming import loads

SHEETS = "source_row_hash string, entry_order string, contractor_name string, contractor_name_normalized string, hours double, date_worked date, is_time_off boolean, is_posted boolean, time_sheet_status string"
UPLOADS = (
    "id long, invoice_id long, line_ord long, contractor_name string, hours double, extra struct<period_start: date, period_end: date>, upload long, replaces boolean, "
    "invoice struct<id: long, vendor_name: string, status: string, invoice_type: string, payment_period_start: date, payment_period_end: date>"
)
MAY = (date(2026, 5, 1), date(2026, 5, 31))


@pytest.fixture
def stream(spark, tmp_path):
    """Drop uploads one after the other; verdicts and line results after each."""
    names = ["Balran Zarton", "Dorbet Wensel"]
    sheets = spark.createDataFrame([(f"h{i}", f"{i}", n, n.lower(), 80.0, date(2026, 5, 4), False, True, "Posted") for i, n in enumerate(names)], SHEETS)

    def run(drops, buckets=4):
        seen = []
        for i, drop in enumerate(drops):
            rows = []
            for invoice, upload, replaces, lines in drop:
                header = (invoice, f"vendor {upload}", "needs_manual_review", "contractor", *MAY)
                rows += [(line, invoice, line, name, hours, (None, None), upload, replaces, header) for line, name, hours in lines or [(None, None, None)]]
            spark.createDataFrame(rows, UPLOADS).write.parquet(str(tmp_path / f"inbox/{i}"))
            source = loads.stream_files(spark, spark.createDataFrame([], UPLOADS).schema, str(tmp_path / "inbox"))
            query = loads.match_invoices(source, lambda: sheets, None, str(tmp_path / "results"), str(tmp_path / "checkpoint"), buckets)
            query.awaitTermination()
            verdicts = {r["id"]: (r["status"], r["lines"], r["matched_lines"], r["vendor_name"]) for r in loads.current_verdicts(spark, str(tmp_path / "results")).collect()}
            lines = sorted((r["invoice_id"], r["line_id"], r["line_status"]) for r in loads.current_line_results(spark, str(tmp_path / "results")).collect())
            seen.append((verdicts, lines))
        return seen

    return run


def test_an_invoice_in_two_uploads_is_judged_on_all_its_lines(stream):
    """Two lines of 40 hours for one person: flagged alone, matched as a total once both are there. A line of another person unmatches it."""
    half, other = [(1, "Balran Zarton", 40.0)], [(2, "Balran Zarton", 40.0)]
    seen = stream([
        [(10, 1, False, half), (11, 1, False, [(5, "Dorbet Wensel", 80.0)])],
        [(10, 2, False, other)],
        [(10, 2, False, other)],
        [(10, 3, False, [(3, "Nobody Atall", 1.0)])],
    ])
    assert seen[0] == ({10: ("flagged", 1, 0, "vendor 1"), 11: ("matched", 1, 1, "vendor 1")}, [(10, 1, "flagged"), (11, 5, "matched")])
    assert seen[1] == ({10: ("matched", 2, 2, "vendor 2"), 11: ("matched", 1, 1, "vendor 1")}, [(10, 1, "matched"), (10, 2, "matched"), (11, 5, "matched")])
    assert seen[2] == seen[1]
    assert seen[3][0][10] == ("flagged", 3, 0, "vendor 3") and len(seen[3][1]) == 4


def test_replacing_uploads_and_corrected_lines(stream):
    wrong, right = [(1, "Balran Zarton", 12.0), (2, "Dorbet Wensel", 80.0)], [(1, "Balran Zarton", 80.0)]
    seen = stream([
        [(10, 1, False, wrong)],
        [(10, 2, False, right)],
        [(10, 3, True, right), (10, 2, False, [(9, "Nobody Atall", 1.0)])],
        [(10, 4, True, None)],
    ])
    assert [s[0][10][:3] for s in seen] == [("flagged", 2, 1), ("matched", 2, 2), ("matched", 1, 1), ("flagged", 0, 0)]
    assert seen[2][1] == [(10, 1, "matched")] and seen[3][1] == []


def test_folded_uploads_give_the_same_lines(spark, stream, tmp_path):
    stream([[(10, 1, False, [(1, "Balran Zarton", 12.0), (2, "Dorbet Wensel", 80.0)]), (11, 1, False, None)], [(10, 2, True, [(1, "Balran Zarton", 80.0)])]])
    loads.compact_uploads(spark, str(tmp_path / "results"), str(tmp_path / "folded"))
    for folder in ("results", "folded"):
        log = spark.read.parquet(str(tmp_path / folder / "log"))
        invoices, lines = loads.latest_uploads(log.withColumn("invoice_id", log["invoice.id"]))
        assert sorted(r["id"] for r in invoices.collect()) == [10, 11]
        assert [(r["id"], r["hours"], r["contractor_name"]) for r in lines.collect()] == [(1, 80.0, "Balran Zarton")]
