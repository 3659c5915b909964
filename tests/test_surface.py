import pytest
from pyspark.sql import functions as F

from lorespark.operators import intents, notes
from lorespark.plans import cli, tools
from lorespark.sources import paged

DAY = "---\nsleep-duration: 6:30\nsleep-quality: 7\nno-phone: true\nphysical-exercise:: false\nmorning-energy: 6\nday-energy: x\nevening-energy: 7\n---\n## Фокус дня\n- a\n## Основные дела\n- [ ] t\n## Что пошло не так\n### Причина\n- late\n## Прочее\n- x"


def test_routes_and_measures(spark):
    frame = spark.createDataFrame([("n", DAY)], "note string, text string")
    got = {r.kind: r.text for r in notes.sections(notes.lines(frame), notes.DAILY_SECTIONS).collect()}
    assert got == {"focus": "- a", "main_tasks": "- [ ] t", "problems": "- late"}
    m = notes.measures(frame).first()
    assert (m.sleep_duration, m.sleep_minutes, m.sleep_quality, m.no_phone, m.physical_exercise, m.day_energy, m.energy) == ("6:30", 390, 7, True, False, None, 6.5)
    kinds = spark.createDataFrame([("Причины отклонений",), ("Список задач",), ("План и факт",), ("x",)], "h string")
    assert [r[0] for r in kinds.coalesce(1).select(notes.section_kind(F.col("h"), notes.WEEKLY_SECTIONS)).collect()] == ["deviations", "tasks", None, None]


def test_people_files(spark):
    rows = [("Иванов Иван", "---\nroles: ['[[A|lead]]', dev]\ntg: '@x'\n---\n"), ("Группа А", "| Кто | Что |\n| [[Иванов Иван]] | роль |\n| [[Группа Б]] | - |\n")]
    got = {r.name: r for r in notes.people_files(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got["Иванов Иван"].roles == ["lead", "dev"] and got["Иванов Иван"].telegram == "@x" and got["Группа А"].is_group and got["Группа А"].members == {"Иванов Иван": "роль"}


def test_intents(spark):
    known = intents.references(spark.createDataFrame([("spend", "spent money"), ("spend", "bought bread"), ("task", "remind me")], "intent string, phrase string"))
    got = {r.phrase_id: r.label for r in intents.classify(spark, spark.createDataFrame([(1, "remind me"), (2, "spent money bought")], "phrase_id long, phrase string"), known).collect()}
    assert got == {1: "task", 2: "spend"}
    assert intents.dispatch("a", {"a": lambda x: x + 1}, 1) == 2 and intents.dispatch(None, {}, 3, fallback=lambda x: x) == 3
    with pytest.raises(KeyError):
        intents.dispatch("z", {"a": print})
    row = spark.createDataFrame([("```json\n{\"amount\": 12.5, \"currency\": \"RUB\"}\n```",), ("none",)], "a string").coalesce(1).select(intents.extracted(F.col("a"), intents.EXPENSE)).collect()
    assert str(row[0][0][0].amount) == "12.50" and row[1][0] is None


def test_paged_source(spark):
    paged.register(spark, "stub_accounts", "id int, name string", lambda page: ([(page * 10 + k, f"a{k}") for k in range(2)], 3))
    assert sorted(r.id for r in spark.read.format("stub_accounts").load().collect()) == [10, 11, 20, 21, 30, 31]
    assert paged.transaction("deposit", "1.00", None, 2, "2025-01-01", "x") == {"transactions": [{"type": "deposit", "amount": "1.00", "date": "2025-01-01", "description": "x", "destination_id": 2}]}
    with pytest.raises(ValueError):
        paged.transaction("transfer", "1", 1, None, "2025-01-01", "x")


def test_tools(spark):
    points = spark.createDataFrame([(1, "alpha"), (2, "beta")], "vec_id long, t string")
    from lorespark.functions import vectors

    found = tools.TOOLS.get("search")({"points": points.withColumn("embedding", vectors.character_embedding(F.col("t")))}, spark, ["alpha"], 1)
    assert found.first().vec_id == 1 and found.first().score == 1.0
    changed = tools.TOOLS.get("add_task")({"notes": spark.createDataFrame([("n", "## A\n- x\n## B")], "note string, text string")}, "A", "- [ ] y")
    assert changed.first().text == "## A\n- x\n- [ ] y\n## B"
    assert len(tools.TOOLS.names()) == 21


def test_command_line(tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "retrieval_fusion" in capsys.readouterr().out
    (tmp_path / "p.yaml").write_text("name: p\nsteps:\n  - {id: a, module: status_counts}\n  - {id: b, module: nope, depends_on: [a]}\n")
    assert cli.main(["validate", str(tmp_path / "p.yaml")]) == 1 and "unknown module" in capsys.readouterr().out
