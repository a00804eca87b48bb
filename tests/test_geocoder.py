"""Batch geocoding: request files, responses with odd lines, the cascade over a second city, the report."""

from pyspark.sql import functions as F

from placeworks.sources import geocoder


def test_requests_hold_every_address_once(spark):
    rows = spark.range(2500).repartition(3).select("id", F.concat(F.lit(' 1 "Elm" St '), "id").alias("address"))
    rows = rows.unionByName(spark.createDataFrame([(9001, None), (9002, "  "), (None, "x")], "id long, address string"))
    got = geocoder.requests(rows, "id", "address", "Chapel Hill", "NC").collect()
    lines = [line for r in got for line in r.content.split("\n")]
    assert sorted(lines) == sorted(f'{i},"1 Elm St {i}",Chapel Hill,NC,' for i in range(2500))
    assert all(r.n == len(r.content.split("\n")) <= geocoder.CHUNK for r in got) and len(got) <= 2500 // 1000 + 4
    small = geocoder.requests(rows.where("id < 10").coalesce(1), "id", "address", "Carrboro", "NC", 4).collect()
    assert sorted(r.n for r in small) == [2, 4, 4]


def test_responses_cascade_and_report(spark):
    lines = [
        '"1","1 Elm, Chapel Hill, NC, ","Match","Exact","1 ELM","-79.05,35.91","605","L"', '"2","2 Elm","Exact","Exact","2 ELM","-79.06,35.92"', '"2","2 Elm","Match","Exact","2 ELM","-79.00,35.90","1","L"',
        '"3","3 Elm","Tie","Exact","3 ELM","-79.05,35.91","605","L"', '"4","4 Elm","No_Match"', '"5","5 Elm","Match","Exact","5 ELM","n/a,35.9","605","L"', '"6","6 Elm","Match","Exact","6 ELM","-79.05","605","L"',
        '"x","7 Elm","Match","Exact","7 ELM","-79.05,35.91","605","L"', "", "   ", None, "junk",
    ]
    first = geocoder.parsed(spark.createDataFrame([(x,) for x in lines], "line string"), "line", "k")
    assert sorted(tuple(r) for r in first.collect()) == [(1, 35.91, -79.05), (2, 35.9, -79.0)]
    rows = spark.range(1, 7).withColumnRenamed("id", "k")
    assert sorted(r.k for r in geocoder.unmatched(rows, "k", first).collect()) == [3, 4, 5, 6]
    second = spark.createDataFrame([(1, 0.0, 0.0), (3, 36.5, -79.0)], "k long, lat double, lon double")
    told = geocoder.geocoded(rows, "k", [first, second])
    got = {r.k: (r.lat, r.source) for r in told.collect()}
    assert got == {1: (35.91, 0), 2: (35.9, 0), 3: (36.5, 1), 4: (None, None), 5: (None, None), 6: (None, None)}
    report = {r.source: (r.n, r.share, r.n_inside) for r in geocoder.report(told, F.col("lat") < 36).collect()}
    assert report == {0: (2, 2 / 6, 2), 1: (1, 1 / 6, 0), None: (3, 0.5, 0)}
