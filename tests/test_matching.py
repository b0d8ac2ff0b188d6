import random
from datetime import date

import pytest

from tallyweave.functions import similarity
from tallyweave.operators import best_match as bm
from tallyweave.operators.reconcile import reconcile

SHEETS = "source_row_hash string, entry_order string, contractor_name string, contractor_name_normalized string, hours double, date_worked date, is_time_off boolean, is_posted boolean, time_sheet_status string"
INVOICES = "id long, invoice_type string, status string, payment_period_start date, payment_period_end date"
LINES = "id long, invoice_id long, line_ord long, contractor_name string, hours double, extra struct<period_start: date, period_end: date>"
MAY = (date(2026, 5, 1), date(2026, 5, 31))


@pytest.fixture(scope="module")
def match(spark):
    def run(sheets, lines, period=MAY, status="needs_manual_review", aliases=()):
        """``sheets``: (name, hours, day, status, time off); ``lines``: (name, hours[, start, end])."""
        entries = spark.createDataFrame(
            [(f"h{i:03}", f"{i:05}", n, n.lower(), h, d, off, s == "Posted", s) for i, (n, h, d, s, off) in enumerate(sheets)], SHEETS
        )
        invoices = spark.createDataFrame([(1, "contractor", status, *period), (2, "other", status, *period)], INVOICES)
        billed = spark.createDataFrame(
            [(i, 1, i, line[0], line[1], tuple(line[2:4]) if len(line) > 2 else (None, None)) for i, line in enumerate(lines)], LINES
        )
        alias = spark.createDataFrame([(i, *a) for i, a in enumerate(aliases)], "alias_id long, invoice_name string, timesheet_name string")
        result = reconcile(invoices, billed, entries, alias)
        rows = [r.asDict(True) for r in result.lines.orderBy("line_ord").collect()]
        reasons = [r.reason for r in result.reasons.orderBy("line_ord").collect()]
        return rows, [r.status for r in result.invoices.collect()], reasons

    return run


def sheet(name="Balran Zarton", hours=80.0, day=date(2026, 5, 4), status="Posted", off=False):
    return name, hours, day, status, off


def test_matched_and_flagged(match):
    rows, status, reasons = match([sheet()], [("Balran Zarton", 80.0)])
    assert (rows[0]["diff"]["match_method"], status, reasons) == ("exact", ["matched"], [])
    rows, status, reasons = match([sheet()], [("Balran Zarton", 120.0)])
    assert status == ["flagged"] and reasons == ["Hours differ for Balran Zarton (invoice 120.0 vs timesheets 80.0)."]
    assert rows[0]["diff"]["pending_posting"] is False


def test_window_and_statuses(match):
    sheets = [
        sheet(hours=60.0), sheet(hours=20.0, status="Submitted", day=date(2026, 5, 31)), sheet(hours=8.0, off=True),
        sheet(hours=10.0, status="Open"), sheet(hours=40.0, day=date(2026, 6, 1)),
    ]
    rows, status, _ = match(sheets, [("Balran Zarton", 80.0)])
    assert rows[0]["diff"]["timesheet_hours"] == 80.0 and rows[0]["diff"]["pending_hours"] == 10.0 and status == ["matched"]
    rows, status, reasons = match(sheets, [("Balran Zarton", 95.0)])
    assert status == ["flagged"] and "10.0 more hrs are logged" in reasons[0]
    rows, _, _ = match(sheets, [("Balran Zarton", 120.0)], period=(None, date(2026, 5, 31)))
    assert rows[0]["diff"]["timesheet_hours"] == 120.0 and rows[0]["diff"]["period_constrained"] is False


def test_resolution_tiers(match):
    sheets = [sheet(), sheet("Dorbet Wenton", 10.0), sheet("Fencid Vikrik", 5.0)]
    lines = [("Zarton Balran", 80.0), ("Dorbt Wenton", 10.0), ("Fencid", 5.0), ("DorbetWenton", 10.0), ("Worker", 80.0), ("Quxq Xyqx", 1.0), (None, 1.0)]
    rows, status, reasons = match(sheets, lines, aliases=[("Worker", "Balran Zarton"), ("Other", "Nobody")])
    assert [r["diff"]["match_method"] for r in rows] == ["exact", "fuzzy", "fuzzy", "fuzzy", "crossref", "unresolved", "unresolved"]
    assert status == ["flagged"] and "No timesheet match for 'Quxq Xyqx'." in reasons
    rows, _, _ = match([sheet("Jon Nelson")], [("Michael Johnson", 80.0)])
    assert rows[0]["resolved"] is None


def test_single_person_total_ignores_line_periods(match):
    lines = [("Balran Zarton", 40.0, date(2026, 5, 1), date(2026, 5, 2)), ("Zarton, Balran", 40.0, date(2026, 5, 8), date(2026, 5, 9))]
    rows, status, _ = match([sheet()], lines)
    assert status == ["matched"] and all(r["diff"]["aggregated"] and r["line_status"] == "matched" for r in rows)
    _, status, reasons = match([sheet()], [("Balran Zarton", 40.0), ("Balran Zarton", None)])
    assert status == ["flagged"] and reasons == ["Total across 2 lines: Hours differ for Balran Zarton (invoice 40.0 vs timesheets 80.0)."]


def test_own_period_missing_hours_and_failed(match):
    sheets = [sheet(hours=8.0), sheet("Dorbet Wenton", 8.0, date(2026, 5, 20))]
    rows, _, reasons = match(sheets, [("Balran Zarton", 8.0, date(2026, 5, 4), date(2026, 5, 4)), ("Dorbet Wenton", None)])
    assert [r["line_status"] for r in rows] == ["matched", "flagged"] and reasons == ["Invoice hours missing for Dorbet Wenton."]
    rows, status, _ = match(sheets, [("Balran Zarton", 8.0)], status="processing_failed")
    assert rows == [] and status == ["processing_failed"]


def test_tolerance_is_inclusive(match):
    assert match([sheet()], [("Balran Zarton", 81.0)])[1] == ["matched"]
    assert match([sheet(hours=98.0)], [("Balran Zarton", 100.0)])[1] == ["matched"]
    assert match([sheet(hours=97.99)], [("Balran Zarton", 100.0)])[1] == ["flagged"]


def test_grid_search_equals_brute_force(spark, monkeypatch):
    """Small blocks force many cells; a hot token and a hot key are cut as well."""
    monkeypatch.setattr(bm, "QUERY_BLOCK", 20)
    monkeypatch.setattr(bm, "CANDIDATE_BLOCK", 15)
    rng = random.Random(3)

    def name(hot):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 7)))
        return f"kumar {word}" if hot else word + " " + "".join(rng.choice("abcde") for _ in range(5))

    queries, candidates = sorted({name(i % 3 == 0) for i in range(90)}), sorted({name(i % 3 == 0) for i in range(120)})
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    offered = spark.createDataFrame([(c, f"{i:04}") for i, c in enumerate(candidates)], "candidate string, candidate_order string")
    for scorer, function in (("name_similarity", similarity.name_similarity), ("token_sort", similarity.token_sort)):
        got = {r.query: (r.candidate, r.score) for r in bm.best_match(asked, offered, scorer, 65.0).collect()}
        expected = {}
        for q in queries:
            scores = [function(q, c) for c in candidates]
            if max(scores) >= 65:
                expected[q] = (candidates[scores.index(max(scores))], max(scores))
        assert got == expected
    pairs = {(r.query, r.candidate) for r in bm.all_matches(asked, offered, "token_sort", 70.0).collect()}
    assert pairs == {(q, c) for q in queries for c in candidates if similarity.token_sort(q, c) >= 70}


def test_pairs_and_blocks_equal_the_plain_measures():
    """Texts of up to several words of bits, empty ones, repeated and shared tokens."""
    rng = random.Random(1)

    def text(n, letters="abcde "):
        return " ".join("".join(rng.choice(letters) for _ in range(n)).split())

    pairs = [(text(rng.choice([0, 1, 8, 20, 63, 64, 65, 129, 200])), text(rng.choice([0, 1, 8, 20, 64, 65, 200]))) for _ in range(400)]
    pairs += [(a, " ".join(rng.sample(a.split(), len(a.split()))[1:] + ["x"])) for a, _ in pairs if a] + [("aa aa", "aa"), ("é ü", "ü é"), ("john smith", "john doe")]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert similarity.lcs_pairs(left, right).tolist() == [similarity.lcs_length(a, b) for a, b in pairs]
    for name in ("ratio", "token_sort", "token_set"):
        assert getattr(similarity, f"{name}_pairs")(left, right).tolist() == [getattr(similarity, name)(a, b) for a, b in pairs]
    short = [(a, b) for a, b in pairs if len(a) + len(b) < 90]
    for name in ("partial", "name_similarity"):
        assert getattr(similarity, f"{name}_pairs")(*map(list, zip(*short))).tolist() == [getattr(similarity, name)(a, b) for a, b in short]
    candidates = sorted({b for _, b in short} | {"aa aa bb", "aa bb", "john x"})
    block = similarity.NameBlock(candidates)
    for query in [a for a, _ in short[::9]] + ["aa aa bb bb", "john smith"]:
        scores = [similarity.name_similarity(query, c) for c in candidates]
        assert (block.bounds(query) >= scores).all()
        best = max(scores)
        assert block.best(query, 65.0, list(range(len(candidates)))) == ((scores.index(best), best) if best >= 65 else None)


@pytest.mark.parametrize("cutoff", [60.0, 80.0, 88.0])
def test_keyed_search_equals_brute_force(spark, monkeypatch, cutoff):
    """Very short texts, texts of over 128 characters, a third of all with one hot token, cut keys."""
    monkeypatch.setattr(bm, "QUERY_BLOCK", 6)
    monkeypatch.setattr(bm, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(bm, "TASK_ROWS", 500)
    rng = random.Random(int(cutoff))

    def word(n):
        return "".join(rng.choice("abcdeé") for _ in range(n))

    def changed(t):
        letters = list(t)
        for _ in range(rng.randrange(1, 2 + len(t) // 8)):
            letters[rng.randrange(len(letters))] = rng.choice("abcde ")
        return " ".join("".join(letters).split()) or "a"

    candidates = {f"kumar {word(6)}" for _ in range(40)} | {" ".join(word(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))) for _ in range(50)}
    candidates |= {" ".join(word(9) for _ in range(15)) for _ in range(6)} | {"a", "b", "ab", "abc", " ".join(["ab"] * 60)}
    queries = sorted({changed(c) for c in candidates} | {changed(c) for c in candidates} | {"a", "zz", "c a b"})
    candidates = sorted(candidates)
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    offered = spark.createDataFrame([(c, f"{i:04}") for i, c in enumerate(candidates)], "candidate string, candidate_order string")
    scores = {q: [similarity.token_sort(q, c) for c in candidates] for q in queries}
    got = {r.query: (r.candidate, r.score) for r in bm.best_match(asked, offered, "token_sort", cutoff).collect()}
    assert got == {q: (candidates[s.index(max(s))], max(s)) for q, s in scores.items() if max(s) >= cutoff}
    rows = [(r.query, r.candidate) for r in bm.all_matches(asked, offered, "token_sort", cutoff).collect()]
    assert sorted(rows) == sorted((q, c) for q, s in scores.items() for c, x in zip(candidates, s, strict=True) if x >= cutoff)
    assert bm.best_match(asked.limit(0), offered, "token_sort", cutoff).count() == bm.best_match(asked, offered.limit(0), "token_sort", cutoff).count() == 0


def test_sets_of_tokens_within_a_vendor_with_a_third_of_all_rows(spark, monkeypatch):
    """Contained texts of any length, shared and repeated tokens, texts without a common token, ties by order."""
    monkeypatch.setattr(bm, "QUERY_BLOCK", 10)
    monkeypatch.setattr(bm, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(bm, "TASK_ROWS", 400)
    monkeypatch.setattr(bm, "FEW_PAIRS", 40)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(40)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    vendors = ["hot"] * 6 + [f"v{i}" for i in range(6)]
    products = sorted({(rng.choice(vendors), text(rng.randrange(1, 6))) for _ in range(160)})
    asked = sorted({(rng.choice(vendors), rng.choice([text(rng.randrange(1, 5)), text(12), rng.choice(products)[1] + " " + text(8), "zz " + rng.choice(products)[1][1:]])) for _ in range(120)})
    offered = spark.createDataFrame([(v, p, f"{i:04}") for i, (v, p) in enumerate(products)], "vendor string, candidate string, candidate_order string")
    got = {(r.vendor, r.query): (r.candidate, r.score) for r in bm.best_match(spark.createDataFrame(asked, "vendor string, query string"), offered, "token_set", 60.0, within="vendor").collect()}
    expected = {}
    for v, q in asked:
        scored = [(-similarity.token_set(q, p), i, p) for i, (w, p) in enumerate(products) if w == v]
        if scored and -min(scored)[0] >= 60:
            expected[v, q] = (min(scored)[2], -min(scored)[0])
    assert got == expected


def test_a_text_is_sent_as_often_whatever_the_other_side_holds():
    rarity = {ch: -0.1 * i for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz ")}
    for cutoff, size, most in ((88.0, 20, 15), (88.0, 40, 45), (80.0, 20, 28)):
        assert len(bm.text_keys("abcdefghijklmnopqrst"[:size] + "uvwxyz abcdefghijklmn"[: max(0, size - 20)], cutoff, rarity)) <= most


def test_grid_search_within_keys(spark, monkeypatch):
    monkeypatch.setattr(bm, "QUERY_BLOCK", 5)
    monkeypatch.setattr(bm, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(bm, "FEW_PAIRS", 20)
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abcd") for _ in range(6))

    queries = sorted({("hot" if i % 2 else f"k{i % 7}", word()) for i in range(60)})
    candidates = sorted({("hot" if i % 2 else f"k{i % 7}", word()) for i in range(60)})
    asked = spark.createDataFrame(queries, "key string, query string")
    offered = spark.createDataFrame([(k, c, c) for k, c in candidates], "key string, candidate string, candidate_order string")
    got = {(r.key, r.query): r.candidate for r in bm.best_match(asked, offered, "token_sort", 60.0, within="key").collect()}
    expected = {}
    for k, q in queries:
        scored = sorted((-similarity.token_sort(q, c), c) for kk, c in candidates if kk == k)
        if scored and -scored[0][0] >= 60:
            expected[(k, q)] = scored[0][1]
    assert got == expected


def test_alike_names_meet_in_a_bounded_grid(spark, monkeypatch):
    """Names that share nearly every key are not met key by key; long, empty and repeated characters are bounded as well."""
    monkeypatch.setattr(bm, "QUERY_BLOCK", 20)
    monkeypatch.setattr(bm, "CANDIDATE_BLOCK", 30)
    monkeypatch.setattr(bm, "CHARACTER_BITS", 64)
    monkeypatch.setattr(bm, "_keyed_search", lambda *_: pytest.fail("met by keys"))
    rng = random.Random(5)

    def name():
        return "".join(rng.choice(["bal", "ran", "zar", "ton"]) for _ in range(rng.randint(2, 5))) + rng.choice([" inc technologies", " llc solutions", " x" * 50])

    queries, candidates = sorted({name() for _ in range(60)} | {""}), sorted({name() for _ in range(80)} | {""})
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    offered = spark.createDataFrame([(c, f"{i:04}") for i, c in enumerate(candidates)], "candidate string, candidate_order string")
    got = {r.query: (r.candidate, r.score) for r in bm.best_match(asked, offered, "token_sort", 88.0).collect()}
    scores = {q: [similarity.token_sort(q, c) for c in candidates] for q in queries}
    assert got == {q: (candidates[s.index(max(s))], max(s)) for q, s in scores.items() if max(s) >= 88}
    rows = [(r.query, r.candidate) for r in bm.all_matches(asked, offered, "ratio", 80.0).collect()]
    assert sorted(rows) == sorted((q, c) for q in queries for c in candidates if similarity.ratio(q, c) >= 80)


def test_searches_are_sent_after_a_measure_was_used(spark):
    """A UDF that was used holds a handle of the JVM, which no task may take along."""
    rows = spark.createDataFrame([("balran zarton", "dorbet wenton")], "a string, b string")
    for measure in (similarity.ratio_udf, similarity.token_sort_udf, similarity.token_set_udf, similarity.name_similarity_udf):
        rows.select(measure("a", "b")).collect()
    for search, scorers in ((bm._bounded_search, ("ratio", "token_sort")), (bm._cell_search, ("token_sort", "name_similarity"))):
        for scorer in scorers:
            assert bm.cloudpickle.dumps(search(scorer, 80.0, False))
    for scorer in ("ratio", "token_sort", "token_set"):
        assert bm.cloudpickle.dumps(bm._keyed_search(scorer, 80.0, False))
