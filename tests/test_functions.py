import random
from datetime import date

from pyspark.sql import functions as F

from tallyweave.functions import coding, dates, documents, money, names, similarity


def test_names(column):
    assert column(names.first_last, ["Doe, Jane", " Jane Doe ", "Doe,", None, ""]) == ["Jane Doe", "Jane Doe", "Doe", None, None]
    assert column(names.normalize_name, ["O'Neil-Smith, Mary Ann", "JANE   DOE.", "--", None]) == ["mary ann oneilsmith", "jane doe", None, None]
    assert column(names.last_first, ["Jane Mid Doe", "Solo"]) == ["Doe, Jane Mid", "Solo"]
    assert column(names.sorted_key, ["doe jane", "jane doe"]) == ["doe jane", "doe jane"]


def test_dates(column):
    texts = ["26/04/2026", "05/06/2026", "01-MAY-26", "01March2026", "Jun 1, 2026", "2026-05-11T00:00:00", "31-Feb-2026", "later", "05.15.2026"]
    expected = [date(2026, 4, 26), date(2026, 5, 6), date(2026, 5, 1), date(2026, 3, 1), date(2026, 6, 1), date(2026, 5, 11), None, None, date(2026, 5, 15)]
    assert column(dates.parse_date, texts) == expected
    assert column(dates.to_date, ["5/11/26", "5/11/2026", "2026-05-11T00:00:00", "x"]) == [date(2026, 5, 11)] * 3 + [None]
    period = column(lambda v: F.array(*dates.parse_period(v)), ["02-Mar-2026 - 31-Mar-2026", "5/1/2026"])
    assert period == [[date(2026, 3, 2), date(2026, 3, 31)], [date(2026, 5, 1), None]]


def test_numbers(column):
    texts = ["$2,400", "8 3.00", "180 Hrs", "1 5,936.00", "90 400,00", "1.234,56", "1,234.56", "abc", None, "1.2.3"]
    assert column(money.clean_number, texts) == [2400.0, 83.0, 180.0, 15936.0, 90400.0, 1234.56, 1234.56, None, None, 1.23]
    assert column(money.number_cell, [40.0, 37.5, 100.0, None], "double") == ["40", "37.5", "100", ""]
    assert column(money.compact_money, [1_250_000.0, 34_499.0, 567.0], "double") == ["$1.3M", "$34K", "$567"]


def test_codes(column):
    keys = column(coding.normalize_supplier, ["Acme Data INC-317598 (08820)", "acme.com, Inc.", None])
    assert keys == ["acme data inc", "acme inc", ""]
    assert column(coding.supplier_core_key, ["acme technologies inc", "acmetechnologieslimited"]) == ["acmetechnologies"] * 2
    assert column(coding.invoice_number_key, ["6347.0", " INV 12 ", None]) == ["6347", "inv12", ""]
    assert column(coding.code_prefix, ["DT600 - Apps", "679030 - IT", "OPEN"]) == ["DT600", "679030", None]
    assert column(coding.is_time_off, ["Time Off", "timeoff", "PTO", "Laptop", None]) == [True, True, True, False, False]
    assert column(coding.invoice_number_from_name, ["ACI0501202621760_Invoice - App", "bill_77", "none"]) == ["ACI0501202621760", "77", "none"]
    assert column(coding.safe_name_part, ['A/B: "C" Inc.']) == ["AB C Inc"]


def test_policy(column):
    policy = coding.Policy(
        companies=(coding.Company("A", "5", "CA", ("/x",), r"\bnova"),),
        capex_gl="246010", opex_gl="667040", opex_gl_by_vendor_text={"zorvex": "667070"},
    )
    assert column(lambda v: policy.gl_code(v, F.lit("Zorvex Ltd")), ["capex", "OPEX", "?"]) == ["246010", "667070", ""]
    assert column(lambda v: policy.gl_code(v, F.lit("Acme")), ["opex"]) == ["667040"]
    assert column(coding.Policy().class_of_gl, ["", "246010"]) == [None, None]
    assert column(policy.class_of_gl, ["246010", " 667040 ", "667070", "667040, 246010"]) == ["CAPEX", "OPEX", None, None]
    assert column(policy.company_for_project_name, ["Nova Pad", "renovate", None]) == ["A", None, None]


def _slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def test_similarity_against_brute_force():
    rng = random.Random(7)

    def name():
        return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 3)))

    candidates = sorted({name() for _ in range(400)})
    block, sort_block = similarity.NameBlock(candidates), similarity.Block(candidates)
    for _ in range(60):
        query = name()
        assert abs(similarity.ratio(query, candidates[0]) - _slow_ratio(query, candidates[0])) < 1e-9
        for chosen, scorer in ((block, similarity.name_similarity), (sort_block, similarity.token_sort)):
            scores = [scorer(query, c) for c in candidates]
            assert (chosen.bounds(query) >= [s - 1e-9 for s in scores]).all()
            top = max(scores)
            expected = (scores.index(top), top) if top >= 65 else None
            assert chosen.best(query, 65.0, list(range(len(candidates)))) == expected


def test_name_similarity_cases():
    score = similarity.name_similarity
    assert score("jane doe", "doe jane") == 100
    assert score("jane", "jane doe") == 100
    assert score("janedoering", "jane doering") >= 80
    assert score("michael johnson", "jon nelson") < 80


def test_person_names(column):
    texts = [
        "IT consulting (Balran Zarton)", "Software development provided by Maria de Souza",
        "Mobile App Development - 01-Apr to 30-Apr 2026 - Bibran Royat - Lead", "Dorbet Wenton 04/26/2026 - 05/30/2026",
        "IT services", "SACHIN CORP",
    ]
    assert column(documents.person_name, texts) == ["Balran Zarton", "Maria de Souza", "Bibran Royat", "Dorbet Wenton", None, None]


def test_periods(column):
    def period(text):
        return documents.header_period(text)["period"]

    texts = [
        "Period: June 1-14, 2026", "Account Billed From Date Billed To Date\nName: X 02-Mar-2026 31-Mar-2026",
        "work 05 April 2026to25 April 2026", "01-Apr to 30-Apr 2026", "Invoice for the month of April2026", "May 2026 Services",
        "My App Timesheet - February 2026\nName", "Invoice 123\nDate Day\n1-Apr-26 8", "\n".join(["line"] * 10 + ["Widgets $5.00", "Worked in May 2026"]),
        "\n".join(["a long letterhead"] * 10 + ["May 2026", "Widgets $5.00"]),
        "Time Card by company invoice\n06/01/2026 - 06/30/2026\n06/02/2026 Tue Work 8.00\n06/19/2026 Fri Work 8.00",
    ]
    assert column(period, texts) == [
        "June 1, 2026 - June 14, 2026", "02-Mar-2026 - 31-Mar-2026", "4/5/2026 - 4/25/2026", "4/1/2026 - 4/30/2026",
        "4/1/2026 - 4/30/2026", "5/1/2026 - 5/31/2026", "2/1/2026 - 2/28/2026", None, None, "5/1/2026 - 5/31/2026", "6/2/2026 - 6/19/2026",
    ]


def test_service_totals(column):
    texts = [
        "Subtotal 6,000.00\nTotal: USD 6,715.63\nTotal Paid 6,000.00\nBalance Due 715.63", "Invoice Total: $50.00\nBalance Due: $30.00",
        "Amount Due $123.45", "Widget shipment for the month of May",
    ]
    assert column(documents.service_total, texts) == [6715.63, 50.0, 123.45, None]


def test_vendor_lines(column):
    assert column(documents.clean_vendor, ["Acme Inc. 4/30/2026", "Acme - April 2026", None]) == ["Acme Inc.", "Acme", None]
    texts = ["Seller: ACME Sp. z o.o. Sp. k. Buyer: Nova", "INVOICE\nNova Corp\nAcme Data, LLC 12 Main St", "nothing"]
    vendor = column(lambda v: documents.service_vendor(v, "nova"), texts)
    assert vendor == ["ACME Sp. z o.o", "Acme Data, LLC", None]
    brands = column(documents.email_brands, ["pay ar@cyrix.com or x@pnc.com, y@gmail.com\nThanks, CyRix"])
    assert brands == [["CyRix"]]


def test_header_values(column):
    numbers = {
        "Invoice No.: QX-20417/3": "QX-20417/3", "Invoice Number\nAB12C": "AB12C", "InvoiceNo:998877": "998877", "see INV 4471": "INV 4471",
        "ref ABC123456789 end": "ABC123456789", "Invoice 123": "123", "Invoice # 77": None, "Invoice Number Date": None, "nothing": None,
    }
    assert column(documents.header_number, list(numbers)) == list(numbers.values())
    days = {
        "Invoice Date: 05-Mar-2026": date(2026, 3, 5), "Due 1/9/2026\nInvoiceDate 2/3/2026": date(2026, 2, 3), "on 4/30/2026": date(2026, 4, 30),
        "paid 7-Apr-2026": date(2026, 4, 7), "April 9, 2026": date(2026, 4, 9), "1/2/26": None, "x": None,
    }
    assert column(documents.header_date, list(days)) == list(days.values())
    totals = {
        "Total 5.00\nTotal Invoice Value: $1,234.50": 1234.5, "Total to be paid: 90 400,00": 90400.0, "Gross Value 12.30": 12.3,
        "Total Amount Due: $ 2,000.00 USD": 2000.0, "Amount Due (USD) $77.10": 77.1, "Total $ 950": 950.0, "Total hours 8": None, "Subtotal 8.00": None,
    }
    assert column(documents.header_total, list(totals)) == list(totals.values())
    vendors = {
        "Beneficiary Name: Quorl Data\nBank": "Quorl Data", "Invoice\nZant Solutions\nx": "Zant Solutions", "Invoice\nPlain Name\nx": "Plain Name",
        "INVOICE\nNova Inc\nVrel L.L.C.": "Vrel L.L.C.",
    }
    assert column(lambda v: documents.header_vendor(v, "nova"), list(vendors)) == list(vendors.values())


def test_a_vendor_far_down_is_found(column):
    text = "\n".join(["line"] * 60 + ["Seller: Acme Data, LLC"])
    assert column(lambda v: documents.service_vendor(v, "nova"), [text]) == ["Acme Data, LLC"]


def test_a_header_row_far_down_is_found(spark):
    from tallyweave.operators.grid_text import service_rows, table_rows

    def grid(*rows):
        return spark.createDataFrame([(1, 0, [["note", "", "", ""]] * 12 + [list(r) for r in rows])], "doc_id long, table_ord int, cells array<array<string>>")

    people = table_rows(grid(("Name", "Hours", "Rate", "Amount"), ("Balran Zarton", "8", "10.00", "80.00"))).collect()
    assert [(r.contractor_name, r.hours, r.amount) for r in people] == [("Balran Zarton", 8.0, 80.0)]
    services = service_rows(grid(("Description", "Quantity", "Unit Price", "Amount"), ("Hosting", "2", "5.00", "10.00"))).collect()
    assert [(r.description, r.amount) for r in services] == [("Hosting", 10.0)]


def test_names_are_cut_without_patterns_compiled_per_row(column, monkeypatch):
    """Particles in capitals, initials, dots and words that are no names; ``split`` gets single characters only."""
    texts = ["VAN Der Berg", "Maria DE Souza", "Piet VAN DER Berg - Lead", "J. Smith .Dev.", "x \u0001Balran Zarton\u0001", "One Two Three Four Five", "DE la Cruz Ana 2026", None]
    expected = [None, "Maria de Souza", "Piet van der Berg", "J. Smith .Dev.", "Balran Zarton", None, "Cruz Ana", None]
    assert column(documents.best_name, texts) == expected
    split, seen = F.split, []
    monkeypatch.setattr(documents.F, "split", lambda text, pattern, *more: seen.append(pattern) or split(text, pattern, *more))
    documents.person_name(F.col("text"))
    assert seen and all(len(pattern) == 1 for pattern in seen)


def test_plain_numbers_read_like_any_other(column):
    texts = ["7", "007.50", "1,234.50", "12,34,5.0", "1,234", "1,23", "1.234,56", "1.2.3", "5.", ".5", "5\n", "9" * 30, "1,,2.0", "$1,234.50", " 1,234.50", "1 234.50", "", None, "x"]
    got = column(money.clean_number, texts)
    # A sign in front is taken away, so the second reading never is the plain one.
    signed = column(lambda c: money.clean_number(F.concat(F.lit("$"), c)), texts)
    assert got == signed and got[:5] == [7.0, 7.5, 1234.5, 12345.0, 1234.0]


def test_labels_that_all_begin_a_word_find_what_each_finds(column):
    from tallyweave.functions import lines

    options = ("Sub total", "tax", "a/c #", "2nd notice")
    texts = ["SUBTOTAL 3", "pretax", "tax", "sub  total:", "x tax.", "A/C # 7", "no", "", None, "22nd notice", "the 2nd NOTICE", "taxes"]
    each = [column(lambda c, o=o: c.rlike("(?i)" + lines.words(o)), texts) for o in options]
    assert column(lambda c: c.rlike("(?i)" + lines.any_of(options)), texts) == [None if row[0] is None else any(row) for row in zip(*each)]
