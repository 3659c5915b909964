from datetime import date

import pytest
from pyspark.sql import functions as F

from lorespark.functions import recurrence, text

PHRASES = [
    ("сегодня", "2026-03-22"), ("вчера", "2026-03-21"), ("позавчера", "2026-03-20"), ("завтра", "2026-03-23"), ("послезавтра", "2026-03-24"), ("3 дня назад", "2026-03-19"), ("неделю назад", "2026-03-15"),
    ("2 недели назад", "2026-03-08"), ("пять дней назад", "2026-03-17"), ("в четверг", "2026-03-19"), ("в понедельник", "2026-03-16"), ("в субботу", "2026-03-21"), ("на прошлой неделе в четверг", "2026-03-12"),
    ("на прошлой неделе", "2026-03-09"), ("на позапрошлой неделе", "2026-03-02"), ("2026-01-15", "2026-01-15"), ("15.01.2026", "2026-01-15"), ("когда-нибудь", "2026-03-22"), ("месяц назад", "2026-02-20"),
    ("двух дней назад", "2026-03-20"), ("десяти дней назад", "2026-03-12"), ("на посредине", "2026-03-22"), ("было вчера", "2026-03-22"), ("это 2026-01-15 вечером", "2026-01-15"), ("к 5.1.2026", "2026-01-05"),
    ("в среду", "2026-03-18"), ("на позапрошлой неделе в среду", "2026-03-04"), ("неделю назад в четверг", "2026-03-19"), ("", "2026-03-22"),
]


def values(spark, rows, column, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_relative_dates(spark):
    got = values(spark, PHRASES, text.relative_date(F.col("a"), F.lit("2026-03-22").cast("date")))
    assert [str(d) for d in got] == [b for _, b in PHRASES]


TASKS = [
    ("- [ ] 🔺 стендап 10:00-10:15 [[Иванов Иван]]", "Основные дела", {"text": "стендап", "status": "open", "priority": "high", "people": ["Иванов Иван"]}),
    ("- [x] код ревью ⏳ 2025-12-01 ✅ 2025-12-01", "Основные дела", {"text": "код ревью", "status": "done", "priority": "medium", "scheduled_date": date(2025, 12, 1), "completion_date": date(2025, 12, 1)}),
    ("- [/] написать тесты #testing", "Второстепенные задачи", {"status": "in_progress", "priority": "low", "tags": ["testing"], "text": "написать тесты"}),
    ("- [-] отменённая задача", "Второстепенные задачи", {"status": "cancelled"}),
    ("- [X] всё", "Надо подумать о", {"status": "done", "priority": "low"}),
    ("- [ ] 🔼 a 🛫 2025-09-01 📅 2025-09-15", "Фокус дня", {"priority": "medium", "start_date": date(2025, 9, 1), "due_date": date(2025, 9, 15)}),
    ("- [ ] спросить [[Иванов Иван|Ваня]] (потом)", None, {"people": ["Ваня"], "inline_comment": "потом", "priority": "normal", "text": "спросить"}),
    ("- [ ] отчёт 🔁 every day until 2025-12-31", None, {"text": "отчёт"}), ("- [ ] x 🔁 every 2 weeks #срочно #review", None, {"tags": ["срочно", "review"], "text": "x"}),
    ("plain text", None, None), ("- bullet", None, None), ("", None, None),
]


def test_task_lines(spark):
    got = values(spark, [t[:2] for t in TASKS], text.task(F.col("a"), F.col("b")))
    for found, (_, _, want) in zip(got, TASKS):
        if want is None:
            assert found is None
        else:
            assert {k: found[k] for k in want} == want
    assert tuple(got[0].time_slot) == ("10:00", "10:15") and tuple(got[7].recurrence) == ("every day", date(2025, 12, 31)) and got[8].recurrence.rule == "every 2 weeks"


def test_written_task_is_read_back(spark):
    rows = [("- [ ] 10:00-10:15 стендап [[Иванов Иван]] 🛫 2025-09-01 📅 2025-09-15 🔁 every week ⏳ 2025-12-01 ✅ 2025-12-02", None)]
    t = text.task(F.col("a"), F.col("b"))
    names = ("start_date", "due_date", "scheduled_date", "completion_date")
    back = text.task_line(t["status"], F.concat_ws("-", t["time_slot"]["start"], t["time_slot"]["end"]), t["text"], t["people"], {n: t[n] for n in names}, t["recurrence"]["rule"])
    assert values(spark, rows, back) == [rows[0][0]]


@pytest.mark.parametrize(
    "rule,start,end,want",
    [
        ("every day", "2025-01-01", "2025-01-05", 5), ("every 2 weeks", "2025-01-01", "2025-02-28", 5), ("every day until 2025-01-03", "2025-01-01", "2025-01-05", 3), ("every month", "2025-01-15", "2025-04-15", 4),
        ("every mon,wed,fri", "2025-01-06", "2025-01-12", 3), ("каждый день", "2025-01-01", "2025-01-02", 2), ("every пн, ср", "2025-01-06", "2025-01-12", 2), ("nonsense", "2025-01-01", "2025-01-05", 0), ("every day", "2025-01-05", "2025-01-01", 0),
    ],
)
def test_recurrence(spark, rule, start, end, want):
    got = values(spark, [(rule, "")], recurrence.expand(recurrence.parse(F.col("a")), F.lit(start).cast("date"), F.lit(end).cast("date")))[0]
    assert len(got) == want


def test_recurrence_of_month_ends_and_next(spark):
    month = recurrence.expand(recurrence.parse(F.lit("every month")), F.lit("2025-01-31").cast("date"), F.lit("2025-04-30").cast("date"))
    assert [str(d) for d in values(spark, [("", "")], month)[0]] == ["2025-01-31", "2025-02-28", "2025-03-28", "2025-04-28"]
    after = recurrence.following(recurrence.parse(F.col("a")), F.col("b").cast("date"))
    assert [str(d) for d in values(spark, [("every week", "2025-01-01"), ("every mon,wed,fri", "2025-01-06")], after)] == ["2025-01-02", "2025-01-08"]


def test_small_values(spark):
    def one(column, a=None, b=None):
        return values(spark, [(a, b)], column)[0]

    a = F.col("a")
    assert one(text.sexagesimal(a), "390") == "6:30" and one(text.sexagesimal(a), "6:05") == "6:05"
    assert one(text.minutes(a), "6:30") == 390 and one(text.minutes(a), "x") is None
    assert one(text.truth(a), " Да ") is True and one(text.truth(a)) is False
    assert one(text.first_name(a), "Иванов Иван") == "Иван" and one(text.first_name(a), "Иван") == "Иван"
    assert one(text.split_list(a), "a, b;c ; ") == ["a, b", "c"] and one(text.split_list(a), "a, ,b") == ["a", "b"] and one(text.split_list(a)) == []
    assert one(text.normal_keyword(a), " API ") == "API" and one(text.normal_keyword(a), "A") == "a" and one(text.normal_keyword(a), "12") == "12"
    assert one(text.tokens_estimate(a), "abcdef") == 3 and one(text.tokens_estimate(a), "") == 0 and one(text.tokens_estimate(a)) == 0
    assert tuple(one(text.file_version(a), "note_20250101_120000.yaml")) == ("note", "20250101_120000") and one(text.file_version(a), "note.yaml").version is None


def test_links(spark):
    got = values(spark, [("see [[Page#Part|Name]] and [[Page]] and [[Page]] and [site](http://x.y) [[A#B]]", "")], text.links(F.col("a")))[0]
    assert [tuple(x) for x in got] == [("[[Page#Part|Name]]", "wiki", "Page", "Part", "Name"), ("[[Page]]", "wiki", "Page", None, "Page"), ("[[A#B]]", "wiki", "A", "B", "B"), ("[site](http://x.y)", "url", "http://x.y", None, "site")]


def test_answers(spark):
    rows = [("<think>x [1]</think>```json\n[{\"a\": 1},]\n```", ""), ("so {\"a\": 2} ok", ""), ("nothing", ""), ("[1, 2]", "")]
    assert values(spark, rows, text.repaired_json(F.col("a"))) == ["[{\"a\": 1}]", "[{\"a\": 2}]", None, "[1, 2]"]
    usage = values(spark, [("{\"usage\": {\"prompt_tokens\": 3, \"completion_tokens\": 4}}", ""), ("{\"prompt_eval_count\": 5}", ""), ("x", "")], text.token_usage(F.col("a")))
    assert [tuple(u) for u in usage] == [(3, 4, 7, 1), (5, 0, 5, 1), (0, 0, 0, 1)]


def test_rendering(spark):
    row = [(1, "header", 2, [("text", "a", None, ["bold", "italic"]), ("link", "b", "u", []), ("image", "i", None, []), ("text", "", None, ["bold"])])]
    frame = spark.createDataFrame(row, "id int, type string, level int, inlines array<struct<type:string,text:string,href:string,marks:array<string>>>")
    assert frame.select(text.render_block(F.col("type"), F.col("level"), F.col("inlines"))).first()[0] == "## ***a*** [b](u)"
