import json

from ranklake.plans import views as V
from ranklake.plans.build import build


def write(tmp_path):
    def row(name, rank, time, status="ok", club="Naturfreunde Wien", **more):
        return {"name": name, "club": club, "timeText": time or "", "status": status, "rank": rank, **more}

    full = [row("Anna Berg", 1, "20:00", yearOfBirth=1990), row("Eva Tal", 2, "21:00"), row("Ida Moos", None, "21:00"), row("Ute See", 4, "25:00", club="vereinslos"), row("Pia Wald", None, None, "dns")]
    first = {"eventId": 7, "source": "html", "fileName": "erg.html", "listType": "race", "categories": [{"name": "D 35", "declaredStarters": 5, "results": full}]}
    again = {"eventId": 7, "source": "pdf", "fileName": "om.pdf", "listType": "race", "categories": [{"name": "D 35", "declaredStarters": 2, "results": full[:2]}]}
    for i, d in enumerate((first, again)):
        (tmp_path / f"7-{i}.json").write_text(json.dumps(d))


def test_build_and_views(spark, tmp_path):
    write(tmp_path)
    registry = spark.createDataFrame([(5, "anna berg", 1990, "Naturfreunde Wien")], "person_id long, name_key string, birth_year int, club string")
    clubs = spark.createDataFrame([("Naturfreunde Wien",)], "name string")
    events = spark.createDataFrame([(7, "ÖM Sprint", "om-sprint")], "event_id long, title string, slug string")
    t = build(spark, str(tmp_path), registry, clubs, events)
    r = {x["name"]: x for x in t["result"].collect()}
    assert len(r) == t["result"].count() == 5
    assert (r["Ida Moos"]["rank"], r["Ida Moos"]["time_behind_s"]) == (2, 60)
    assert r["Anna Berg"]["person_id"] == 5 and r["Anna Berg"]["identity_state"] == "resolved" and r["Eva Tal"]["person_id"] < 0
    assert [r[n]["championship"] for n in ("Anna Berg", "Eva Tal", "Ute See", "Pia Wald")] == ["ÖM", "ÖM", None, None]
    assert sorted((a.medal, a.state) for a in t["award"].collect()) == [("gold", "provisional"), ("silver", "provisional"), ("silver", "provisional")]
    assert all(c.violations == 0 for c in t["check"].collect())
    assert t["result_list"].count() == 2

    stage = spark.createDataFrame([(10_000_007, 7, 1, "Sprint", "2024-05-01")], "stage_id long, event_id long, number int, stage_title string, date string")
    event = spark.createDataFrame([(7, "ÖM Sprint", "2024-05-01", "foot-o")], "event_id long, title string, date string, sport string")
    person = t["result"].selectExpr("person_id", "name").distinct()
    assert V.events(event, stage, t["result"], 2024).collect()[0].n_results == 5
    assert V.event_categories(t["result"], 10_000_007).collect()[0].classified == 4
    podium = V.podiums(t["result"], stage, event, year=2024)
    medals = V.runner_medals(podium, person).collect()
    assert [(m["name"], m["gold"], m["silver"], m["place"]) for m in medals] == [("Anna Berg", 1, 0, 1), ("Eva Tal", 0, 1, 2), ("Ida Moos", 0, 1, 2)]
    assert V.club_medals(podium).collect()[0].gold == 1
    s = V.runner_statistics(V.runner_rows(t["result"], stage, event, 5)).collect()[0]
    assert (s.starts, s.wins) == (1, 1)
    assert V.runner_search(t["result"], person, "anna").collect()[0].person_id == 5
    assert V.club_search(t["result"], "wien").collect()[0].n == 4
    winners = V.champions(podium).collect()
    assert [(w.base, w.women, w.men) for w in winners] == [("35", "Anna Berg", "")]
    redirect = spark.createDataFrame([(99, 5)], "old_id long, new_id long")
    assert V.runner_by_id(person, redirect, 99).collect()[0]["name"] == "Anna Berg"
