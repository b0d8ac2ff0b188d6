import datetime

from tallyweave.sources.driver_views import DriverTables, with_views

LARGE = [5, 7, 20000005, 123456, 1234567, 1234568, 2234567, 999999, 1000000, 10000000, 10999999, 123456789, 23456789, 3456789]


def frames(spark):
    at = datetime.datetime(2024, 1, 3)
    events = [(n, at + datetime.timedelta(days=7 * (n % 3)), i, "click", 100.0, '{"k": 3}') for n, i in enumerate([i for i in LARGE for _ in range(3)])]
    return {
        "events": spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "supplier": spark.createDataFrame([(i, f"Supplier {i}") for i in LARGE], "s_suppkey long, s_name string"),
    }


def rows(spark, sql):
    used = {k: v for k, v in frames(spark).items() if "{" + k + "}" in (body := with_views(sql))}
    return spark.sql(body, **used).collect()


def test_names_of_ids_above_a_million_are_distinct(spark):
    people = {r["user_id"]: (r["first_name"], r["last_name"]) for r in rows(spark, "SELECT * FROM people")}
    assert set(people) == set(LARGE) and len(set(people.values())) == len(LARGE)
    brands = {r["s_suppkey"]: r["brand"] for r in rows(spark, "SELECT * FROM brands")}
    assert set(brands) == set(LARGE) and len(set(brands.values())) == len(LARGE)
    # Ids of up to six digits keep their names.
    assert people[7] == ("Ballip", "Zarton")
    assert len(people[123456][1]) == 12 and len(people[1234567][1]) == 15


def test_invoice_ids_of_large_user_ids_are_distinct(spark):
    lines = rows(spark, "SELECT DISTINCT user_id, week, invoice_id FROM billed_lines WHERE user_id % 5 = 0")
    assert len({r["invoice_id"] for r in lines}) == len({(r["user_id"], r["week"]) for r in lines}) > 1


def test_small_files_are_dealt_out_and_stored_rows_stay_where_they_are_made(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(50).coalesce(1).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(50).repartition(cores + 2).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    tables = DriverTables(spark, str(tmp_path))
    assert tables.table("part").rdd.getNumPartitions() < cores
    dealt = tables.dealt("part")
    assert dealt.rdd.getNumPartitions() == cores and sorted(r[0] for r in dealt.collect()) == list(range(50))
    # Rows that were dealt already are written without another shuffle.
    stored = tables.stored("rows", lambda: spark.range(0, 60, 1, cores + 2))
    assert len(stored.inputFiles()) == cores + 2 and stored.count() == 60
