from pyspark.sql import functions as F

from ranklake.operators import regional as RG

LISTS = [
    (1, 10, "D40-(St,B)/D45-(NÖ,W)", "erg.html", "LM Ost St, B, NÖ, Wien", "", "f1", None),
    (2, 10, "Herren 21", "wiener-wertung.html", "Lauf", "", "f2", None),
    (3, 11, "H 35", "erg.html", "Steirische Meisterschaft", "", "f3", ["ST", None]),
    (4, 11, "Familie", "erg.html", "Steirische Meisterschaft", "", "f4", None),
    (5, 11, "H 35", "erg.html", "Steirische Meisterschaft", "", "f5", None),
    (6, 12, "H 35", "erg.html", "Schulmeisterschaft Steiermark", "", "f6", None),
    (7, 12, None, "erg.html", "Steirische Meisterschaft", "", "f7", None),
]
SCHEMA = "list_id long, stage_id long, category string, file_name string, event_title string, stage_title string, fingerprint string, nations array<string>"


def test_mappings_and_instances(spark):
    lists = spark.createDataFrame(LISTS, SCHEMA)
    claims = RG.mappings(lists)
    got = {(r.list_id, r.region): (r.category_key, r.evidence, r.state, r.partition_required) for r in claims.collect()}
    assert got == {
        (1, "STMK"): ("d40", "category", "confirmed", True), (1, "BGLD"): ("d40", "category", "confirmed", True),
        (1, "NOE"): ("d45", "category", "confirmed", True), (1, "WIEN"): ("d45", "category", "confirmed", True),
        (2, "WIEN"): ("h21", "document", "confirmed", False),
        (3, "STMK"): ("h35", "source_nat", "confirmed", True), (5, "STMK"): ("h35", "event_title", "candidate", True),
    }
    inst = {(r.region, r.stage_id, r.category_key): r for r in RG.instances(claims).collect()}
    assert inst["STMK", 11, "h35"].state == "confirmed" and inst["STMK", 11, "h35"].evidence == "source_nat"
    own = inst["STMK", 11, "h35"]
    review = spark.createDataFrame([(own.instance_id, own.input_fingerprint, "rejected"), (inst["WIEN", 10, "h21"].instance_id, "old", "rejected")], "instance_id string, input_fingerprint string, state string")
    after = {(r.region, r.category_key): r.state for r in RG.instances(claims, review).collect()}
    assert after["STMK", "h35"] == "rejected" and after["WIEN", "h21"] == "confirmed"


def test_entries(spark):
    lists = spark.createDataFrame([(1, 10, "D45-(NÖ,W)", "erg.html", "LM NÖ, Wien", "", "f1", None)], SCHEMA)
    claims = RG.mappings(lists)
    days = lists.select("list_id", "stage_id", F.lit("2024-05-01").alias("stage_date"))
    ordered = RG.claims_in_order(claims, days, RG.instances(claims))
    rows = [
        (1, 1, 101, "individual", "person:101", "Club W", 1, "ok", 100, False, None),
        (2, 1, 102, "individual", "person:102", "Club N", 2, "ok", 110, False, None),
        (3, 1, 103, "individual", "person:103", "Club N", 3, "ok", 120, False, "W"),  # the printed code beats the club
        (4, 1, 104, "individual", "person:104", "Team 4", 4, "ok", 130, False, None),  # by membership
        (5, 1, 105, "individual", "person:105", "Old Club", 5, "ok", 140, False, None),  # leads nowhere
        (6, 1, 106, "individual", "person:106", "vereinslos", 6, "ok", 150, False, None),
        (7, 1, 107, "individual", "person:107", "Club W", 7, "ok", 160, True, None),  # out of competition
        (8, 1, 108, "family", "result:8", "Club W", None, "ok", 170, False, None),
        (9, 1, 109, "individual", "person:109", "Club W", None, "mp", None, False, None),
        (10, 1, 110, "relay", "relay:n:1", "Club N", 2, "ok", 110, False, None),
        (11, 1, 111, "relay", "relay:n:1", "Club N", 2, "ok", 110, False, None),
    ]
    r = spark.createDataFrame(rows, "result_id long, list_id long, person_id long, result_kind string, unit string, club string, rank int, status string, time_s int, out_of_competition boolean, observed_nation string")
    clubs = spark.createDataFrame([("Club W", "WIEN"), ("Club N", "NOE")], "club string, region string")
    members = spark.createDataFrame([(104, "Club W", "2020-01-01", None), (105, "Club W", "2025-01-01", None)], "person_id long, club string, valid_from string, valid_to string")
    entered, issues = RG.entries(ordered, r, clubs, members)
    got = {(e.region, e.unit): (e.regional_rank, e.eligibility_basis) for e in entered.collect()}
    club, nat = "event-time-club-jurisdiction", "explicit-source-nat"
    assert got == {
        ("WIEN", "person:101"): (1, club), ("WIEN", "person:103"): (2, nat), ("WIEN", "person:104"): (3, "event-time-person-club-membership"),
        ("WIEN", "person:109"): (None, club), ("NOE", "person:102"): (1, club), ("NOE", "relay:n:1"): (1, club),
    }
    assert {(i.list_id, i.code, i.severity) for i in issues.collect()} == {(1, "regional_membership_unresolved", "info")}
    own = r.withColumn("official_club", F.col("club")).withColumn("category", F.lit("D45"))
    won = RG.podiums(entered, own, region="NOE")
    assert sorted((p.rank, p.person_id) for p in won.collect()) == [(1, 102), (1, 110), (1, 111)]
    assert [p.person_id for p in RG.podiums(entered, own, club="Club N", person_id=103).collect()] == [103]


def test_empty(spark):
    lists = spark.createDataFrame([], SCHEMA)
    assert RG.mappings(lists).collect() == []
