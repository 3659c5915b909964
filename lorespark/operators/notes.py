"""Notes: front matter, sections, tasks, wellness measures, people, agendas and edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators.automata import contained

ENERGY = ("morning", "day", "evening")
# First word of the file of a group.
GROUP_PREFIX = "группа"


# --- structure of a note --------------------------------------------------------------


def front_matter(source: str) -> tuple[dict, str]:
    """Values between the opening marks and the rest; what is no mapping counts as none."""
    import yaml

    found = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", source or "", re.S)
    if not found:
        return {}, source or ""
    try:
        given = yaml.safe_load(found[1])
    except yaml.YAMLError:
        given = None
    return given if isinstance(given, dict) else {}, source[found.end() :]


def serialise_front_matter(values: dict, order: list[str]) -> str:
    """Front matter with the keys in a fixed order, the others after them; times are quoted."""

    def one(v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]"
        return f'"{v}"' if re.fullmatch(r"\d{1,2}:\d{2}", str(v)) else str(v)

    keys = [k for k in order if k in values] + [k for k in values if k not in order]
    return "---\n" + "".join(f"{k}: {one(values[k])}".rstrip() + "\n" for k in keys) + "---\n"


def lines(notes: DataFrame, by: str = "note", body: str = "text") -> DataFrame:
    """Every line with its place, its section, and whether it is inside a fenced block.

    A section begins at any heading outside fences; ``section`` is the heading's words.
    """
    run = Window.partitionBy(by).orderBy("pos")
    flat = notes.select(by, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    fence = F.trim("line").startswith("```")
    marked = flat.withColumn("_open", F.sum(F.when(fence, 1).otherwise(0)).over(run))
    fenced = (F.col("_open") % 2 == 1) | fence
    heading = ~fenced & F.col("line").rlike(r"^#{1,6}\s+\S")
    marked = marked.withColumns({"fenced": fenced, "level": F.when(heading, F.length(F.regexp_extract("line", "^(#+)", 1)))})
    title = F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", r"^#+\s+", "")))
    return marked.withColumns({"section_no": F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(run), "section": F.last(title, ignorenulls=True).over(run)}).drop("_open")


def tasks(marked: DataFrame, by: str = "note") -> DataFrame:
    """The tasks among the lines, taken apart."""
    found = marked.where("not fenced").withColumn("t", text.task(F.col("line"), F.coalesce("section", F.lit("")))).where("t is not null")
    return found.select(by, "pos", "t.*")


def bullets(marked: DataFrame, by: str = "note") -> DataFrame:
    """Items that are no tasks."""
    item = F.trim("line")
    return marked.where(~F.col("fenced") & item.startswith("- ") & ~item.startswith("- [")).select(by, "pos", "section", F.trim(F.substring(item, 3, 1 << 20)).alias("item"))


def without_fences(marked: DataFrame, by: str = "note") -> DataFrame:
    """The notes again, without fenced blocks."""
    kept = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return marked.where("not fenced").groupBy(by).agg(F.array_join(kept, "\n").alias("text"))


def month_score(body: Column) -> Column:
    """The number before ``из 10`` or ``/10``."""
    return F.regexp_extract(body, r"([0-9]+)\s*(?:из|/)\s*10", 1).try_cast("int")


def week_mark(body: Column) -> Column:
    return F.regexp_extract(body, r"week-mark::\s*([0-9]+)", 1).try_cast("int")


# --- filters --------------------------------------------------------------------------


def filter_tasks(rows: DataFrame, status=None, priority=None, date_from=None, date_to=None, person=None, section=None, query=None, has_time_slot=None, has_scheduled=None) -> DataFrame:
    """Tasks that meet every condition given; a range of dates drops tasks without one."""
    has = lambda c, part: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(part)))
    conditions = {
        "status": (status, lambda v: F.col("status") == v),
        "priority": (priority, lambda v: F.col("priority") == v),
        "from": (date_from, lambda v: F.col("source_date") >= F.lit(v).cast("date")),
        "to": (date_to, lambda v: F.col("source_date") <= F.lit(v).cast("date")),
        "person": (person, lambda v: F.exists("people", lambda p: F.lower(p) == v.lower())),
        "section": (section, lambda v: has("section", v)),
        "query": (query, lambda v: has("text", v) | has("raw_line", v)),
        "slot": (has_time_slot, lambda v: F.col("time_slot").isNotNull() == v),
        "scheduled": (has_scheduled, lambda v: F.col("scheduled_date").isNotNull() == v),
    }
    for value, condition in conditions.values():
        if value is not None:
            rows = rows.where(condition(value))
    return rows


def period(name: str, today: Column) -> tuple[Column, Column]:
    """First and last day of today, this week (from Monday) or this month, or of ``a..b``."""
    if ".." in name:
        return tuple(F.lit(p).cast("date") for p in name.split("..", 1))
    monday = F.date_trunc("week", today).cast("date")
    return {"today": (today, today), "week": (monday, F.date_add(monday, 6)), "month": (F.trunc(today, "month"), F.last_day(today))}[name]


def overdue(rows: DataFrame, today: Column) -> DataFrame:
    return rows.where((F.col("status") == "open") & (F.col("scheduled_date") < today))


# --- statistics -----------------------------------------------------------------------


def status_counts(rows: DataFrame) -> DataFrame:
    names = ("open", "done", "in_progress", "cancelled")
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names))


def top_people(rows: DataFrame, most: int = 10) -> DataFrame:
    """People by number of tasks; of equal ones the first seen (``first``)."""
    flat = rows.select(F.explode("people").alias("person"), "pos")
    return flat.groupBy("person").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first", "person").limit(most)


def wellness_footer(days: DataFrame, last: int) -> DataFrame:
    """Means over the last days: sleep and quality over the days that have them, each energy over the days with any."""
    recent = days.orderBy(F.desc("day")).limit(last)
    energies = [c for c in days.columns if c.startswith("energy_")]
    some = F.count_if(F.coalesce(*(F.col(c).cast("double") for c in energies)).isNotNull())
    return recent.agg(
        F.coalesce(F.round(F.avg("sleep"), 6), F.lit(0.0)).alias("sleep"), F.coalesce(F.round(F.avg("quality"), 6), F.lit(0.0)).alias("quality"), *(F.coalesce(F.round(F.sum(c) / F.nullif(some, F.lit(0)), 6), F.lit(0.0)).alias(c) for c in energies)
    )


def agenda(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals, done and open tasks, tasks of each priority, and the people in order."""
    names = ("high", "medium", "low")
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "open").alias("open"), *(F.count_if(F.col("priority") == p).alias(p) for p in names),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("people")))).alias("people"),
    )


def agenda_order(rows: DataFrame) -> DataFrame:
    """Tasks with a time first, by time; the others as they come."""
    return rows.orderBy(F.col("time_slot.start").isNull(), F.col("time_slot.start"), "pos")


def to_bot(rows: DataFrame) -> DataFrame:
    """Tasks as the bot has them: three priorities, two states, a due day."""
    priority = F.when(F.col("priority").isin("critical", "high"), "high").otherwise(F.col("priority"))
    status = F.when(F.col("status") == "in_progress", "todo").when(F.col("status") == "open", "todo").otherwise(F.col("status"))
    return rows.withColumns({"priority": priority, "status": status, "due": F.coalesce("due_date", "source_date")})


# --- people ---------------------------------------------------------------------------


def aliases(people: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Person of each alias in lower case: discovered ones before full names before free parts of names.

    ``people`` has ``name`` and ``is_group``; ``found`` has ``alias``, ``name`` and ``pos``.
    """
    own = people.select("name", F.lower("name").alias("alias"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("pos"))
    single = people.where("not is_group")
    part = single.select("name", F.explode(F.split(F.lower("name"), r"\s+")).alias("alias"), F.lit(2).alias("rank"), F.lit(0).cast("long").alias("pos")).where("length(alias) >= 2")
    every = own.unionByName(part)
    if found is not None:
        every = every.unionByName(found.select("name", F.lower("alias").alias("alias"), F.lit(0).alias("rank"), (-F.col("pos")).cast("long").alias("pos")))
    return every.groupBy("alias").agg(F.min_by("name", F.struct("rank", "pos", "name")).alias("name"))


def people_in(spark: SparkSession, texts: DataFrame, names: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Who is named in free texts: ``key``, ``name``, the ``alias`` that was used, in lower case, and ``n``, how often.

    ``names`` are those of ``aliases``.  An alias counts where it is not inside a longer
    word, whatever its case; one inside a longer alias counts for both.
    """
    lowered = texts.select(F.col(key), F.lower(F.col(body)).alias(body))
    found = contained(spark, lowered, names, whole=True, key=key, text=body, pattern="alias")
    return found.join(names, found["pattern"] == names["alias"]).select(key, "name", "alias", "n")


def mentioning(rows: DataFrame, person: str, names: DataFrame) -> DataFrame:
    """Tasks with the person that the alias means, among people or link targets."""
    wanted = names.where(F.col("alias") == person.lower()).select(F.lower("name").alias("_who"))
    who = F.lower(F.lit(person))
    hit = F.exists("people", lambda p: (F.lower(p) == F.col("_who")) | (F.lower(p) == who)) | F.exists("wiki_links", lambda x: F.lower(x["target"]) == F.col("_who"))
    return rows.join(F.broadcast(wanted), hit, "left_semi")


def members(groups: DataFrame) -> DataFrame:
    """``person``, ``group`` and ``role`` of groups with a map of members."""
    return groups.select(F.col("name").alias("group"), F.explode("members").alias("person", "role"))


def group_table(body: Column) -> Column:
    """Members and roles of the rows ``| [[Member]] | role |``; nested groups are left out."""
    rows = F.regexp_extract_all(body, F.lit(r"\|\s*\[\[([^\]|]+)(?:\|[^\]]*)?\]\]\s*\|([^|\n]*)\|"), F.lit(1))
    roles = F.regexp_extract_all(body, F.lit(r"\|\s*\[\[([^\]|]+)(?:\|[^\]]*)?\]\]\s*\|([^|\n]*)\|"), F.lit(2))
    pairs = F.transform(F.arrays_zip(rows.alias("m"), roles.alias("r")), lambda x: F.struct(F.trim(x["m"]).alias("member"), F.trim(x["r"]).alias("role")))
    return F.filter(pairs, lambda p: ~F.lower(p["member"]).startswith(GROUP_PREFIX))


# --- edits ----------------------------------------------------------------------------


def set_section(marked: DataFrame, title: str, body: list[str], by: str = "note") -> DataFrame:
    """Notes whose first section with the title has other lines, its heading kept."""
    return _section_edit(marked, title, body, by, keep=False)


def append_to_section(marked: DataFrame, title: str, body: list[str], by: str = "note") -> DataFrame:
    """Notes with lines added at the end of the section, before the next heading of its level or above, or a rule."""
    return _section_edit(marked, title, body, by, keep=True)


def _section_edit(marked: DataFrame, title: str, body: list[str], by: str, keep: bool) -> DataFrame:
    of = Window.partitionBy(by)
    at = F.min(F.when(F.lower("section") == title.lower(), F.when(F.col("level").isNotNull(), F.struct("pos", "level")))).over(of)
    placed = marked.withColumn("_at", at)
    ends = ~F.col("fenced") & (F.col("pos") > F.col("_at.pos")) & ((F.col("level") <= F.col("_at.level")) | F.trim("line").isin("---", "___"))
    placed = placed.withColumn("_end", F.coalesce(F.min(F.when(ends, F.col("pos"))).over(of), F.max("pos").over(of) + 1))
    inside = (F.col("pos") > F.col("_at.pos")) & (F.col("pos") < F.col("_end"))
    rows = placed.where(F.lit(keep) | F.col("_at").isNull() | ~inside).select(by, F.col("pos").cast("double").alias("o"), "line", F.col("_at.pos").alias("_a"), "_end")
    new = F.array(*(F.lit(x) for x in body)).cast("array<string>")
    added = rows.where("_a is not null").select(by, "_a", "_end").distinct().select(by, (F.col("_end") - 0.5).alias("_base"), F.posexplode(new).alias("k", "line"))
    whole = rows.select(by, "o", F.lit(0).alias("k"), "line").unionByName(added.select(by, F.col("_base").alias("o"), "k", "line"))
    return whole.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def change_first_task(marked: DataFrame, part: str, change=None, by: str = "note") -> DataFrame:
    """Notes whose first task that holds a text is changed by a function of the line, or removed without one."""
    hit = ~F.col("fenced") & F.trim("line").rlike(r"^[-*]\s+\[.\]") & F.contains(F.lower("line"), F.lit(part.lower()))
    first = F.min(F.when(hit, F.col("pos"))).over(Window.partitionBy(by))
    placed = marked.withColumn("_here", F.coalesce(F.col("pos") == first, F.lit(False)))
    rows = placed.where("not _here") if change is None else placed.withColumn("line", F.when(F.col("_here"), change(F.col("line"))).otherwise(F.col("line")))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


# --- kinds of sections ----------------------------------------------------------------

# Stems in headings by grain, tried in this order; all stems of one entry must be there.
DAILY_SECTIONS = {"focus": [("фокус",)], "main_tasks": [("основные", "дела")], "secondary_tasks": [("второстепенные",)], "gratitude": [("рад",), ("получилось",)], "problems": [("не так",)], "thoughts": [("подумать",)], "notes": [("заметк",)]}
WEEKLY_SECTIONS = {
    "tasks": [("список", "задач")], "focus": [("фокус",)], "achievements": [("достижени",)], "insights": [("инсайт",)], "deviations": [("отклонени",), ("причин", "план")], "obstacles": [("тормози",), ("проблем", "блок")], "solutions": [("решени",)],
    "self_assessment": [("мотивац",), ("самооценк",)], "joys": [("порадовал",)], "findings": [("находк",), ("ресурс",)], "reflection": [("рефлекси",)],
}
MONTHLY_SECTIONS = {
    "dynamics": [("динамик",)], "achievements": [("достижени",)], "insights": [("инсайт",)], "plan_and_fact": [("план", "факт")], "habits": [("навык",), ("привычк",)], "problems": [("проблем",), ("блок",)], "solutions": [("решени",)],
    "self_assessment": [("самооценк",), ("мотивац",)], "findings": [("находк",), ("ресурс",)], "reflection": [("рефлекси",)],
}
# Keys of the measures in front matter.
SLEEP_TIMES = ("bed-time-start", "sleep-start", "sleep-end", "sleep-duration")
FLAGS = ("quick-fall-asleep", "night-awakenings", "deep-sleep", "remembered-dreams", "no-nightmare", "no-phone", "physical-exercise", "late-dinner")
NUMBERS = ("sleep-quality", "morning-mood", "morning-energy", "day-energy", "evening-energy")


def section_kind(heading: Column, table: dict[str, list[tuple[str, ...]]]) -> Column:
    """What a section is about, by the first entry whose stems its heading has; null if none."""
    h = F.lower(heading)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, choices in table.items():
        hit = F.lit(False)
        for stems in choices:
            every = F.lit(True)
            for stem in stems:
                every &= F.contains(h, F.lit(stem))
            hit |= every
        out = out.when(hit, name)
    return out


def sections(marked: DataFrame, table: dict[str, list[tuple[str, ...]]], by: str = "note") -> DataFrame:
    """Text of each kind of section; headings below one that has a kind belong to it until its level is over."""
    own = section_kind(F.col("section"), table)
    heads = marked.where("level is not null").select(by, "section_no", "level", own.alias("kind"))
    run = Window.partitionBy(by).orderBy("section_no")
    # a heading without a kind, below the last one with a kind, goes with that
    last = F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "level")), ignorenulls=True).over(run)
    kinds = heads.withColumn("_l", last).select(by, "section_no", F.coalesce("kind", F.when(F.col("level") > F.col("_l.level"), F.col("_l.kind"))).alias("kind"))
    rows = marked.where("level is null and not fenced").join(kinds, [by, "section_no"]).where("kind is not null")
    lines_ = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(by, "kind").agg(F.trim(F.array_join(lines_, "\n")).alias("text"))


def measures(notes_: DataFrame, by: str = "note", body: str = "text") -> DataFrame:
    """Sleep, mood and energy from the front matter of notes: times, numbers and flags (a flag that isn't there is false)."""
    import pandas as pd

    def read(frames):
        for frame in frames:
            found = [front_matter(t)[0] for t in frame["body"]]
            yield pd.DataFrame({"k": frame["k"], "m": [{str(k).rstrip(":"): None if v is None else str(v) for k, v in m.items()} for m in found]})

    rows = notes_.select(F.col(by).cast("string").alias("k"), F.col(body).alias("body")).mapInPandas(read, "k string, m map<string,string>")
    at = lambda k: F.try_element_at("m", F.lit(k))
    name = lambda k: k.replace("-", "_")
    columns = [text.sexagesimal(at(k)).alias(name(k)) for k in SLEEP_TIMES] + [at(k).try_cast("int").alias(name(k)) for k in NUMBERS] + [text.truth(at(k)).alias(name(k)) for k in FLAGS]
    out = rows.select(F.col("k").alias(by), *columns)
    return out.withColumns({"sleep_minutes": text.minutes(F.col("sleep_duration")), "energy": text.mean_of(F.array(*(F.col(f"{p}_energy") for p in ("morning", "day", "evening"))))})


def people_files(files: DataFrame) -> DataFrame:
    """People and groups from their files (``name``, ``text``): roles, interests, messenger name, members with roles."""
    import pandas as pd

    def several(v) -> list[str]:
        out = []
        for x in v if isinstance(v, list) else [v] if v else []:
            link = re.fullmatch(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", str(x).strip())
            out.append((link[2] or link[1]) if link else str(x))
        return out

    def read(frames):
        for frame in frames:
            rows = []
            for name, body in zip(frame["name"], frame["text"]):
                given, rest = front_matter(body)
                rows.append((name, name.lower().startswith(GROUP_PREFIX), several(given.get("roles")), several(given.get("interests")), given.get("tg") and str(given["tg"]), rest))
            yield pd.DataFrame(rows, columns=["name", "is_group", "roles", "interests", "telegram", "body"])

    found = files.select("name", "text").mapInPandas(read, "name string, is_group boolean, roles array<string>, interests array<string>, telegram string, body string")
    return found.withColumn("members", F.when(F.col("is_group"), F.map_from_entries(F.array_distinct(group_table(F.col("body")))))).drop("body")


# --- whole notes ----------------------------------------------------------------------


def period_labels(day: Column) -> Column:
    """Names of the day's notes: ``YYYY-MM-DD``, the ISO week ``YYYY-Wnn`` and ``YYYY-MM``."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.struct(F.date_format(day, "yyyy-MM-dd").alias("daily"), week.alias("weekly"), F.date_format(day, "yyyy-MM").alias("monthly"))


def vault_means(days: DataFrame, weeks: DataFrame) -> DataFrame:
    """Mean minutes of sleep, mean energy and mean week mark, 0 where there is none."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c)
    return days.agg(mean("sleep_minutes"), mean("energy")).join(weeks.agg(mean("week_mark")))  # one row beside one row


def change_people(rows: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Tasks with people added behind those they have, and others taken off."""
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return rows.withColumn("people", F.array_except(F.array_union(F.coalesce("people", names([])), names(add)), names(remove)))


def set_measures(notes_: DataFrame, values: dict, order: list[str] = (*SLEEP_TIMES, *NUMBERS, *FLAGS), by: str = "note", body: str = "text") -> DataFrame:
    """Notes whose front matter has these values put over its own, keys in a fixed order; it is made where there is none."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            done = []
            for source in frame["body"]:
                given, rest = front_matter(source)
                # a loader reads H:MM as minutes
                given = {k: f"{v // 60}:{v % 60:02d}" if k in SLEEP_TIMES and type(v) is int else v for k, v in given.items()}
                done.append(serialise_front_matter(given | values, list(order)) + rest)
            yield pd.DataFrame({"k": frame["k"], "body": done})

    made = notes_.select(F.col(by).cast("string").alias("k"), F.col(body).alias("body")).mapInPandas(run, "k string, body string")
    return made.select(F.col("k").alias(by), F.col("body").alias(body))


def ensure_notes(existing: DataFrame, wanted: DataFrame, template: str, by: str = "note", body: str = "text") -> DataFrame:
    """The notes there are, and one from the template (``{{note}}`` is its name) for every wanted one that is missing."""
    missing = wanted.select(by).distinct().join(existing.select(by), by, "left_anti")
    made = missing.select(by, F.replace(F.lit(template), F.lit("{{note}}"), F.col(by).cast("string")).alias(body))
    return existing.select(by, body).unionByName(made)


def tasks_between(marked: DataFrame, first: Column, last: Column, by: str = "note") -> DataFrame:
    """Tasks of the daily notes of a range of days; ``source_date`` is the note's day."""
    return tasks(marked, by).withColumn("source_date", F.try_to_date(F.col(by).cast("string"))).where(F.col("source_date").between(first, last))


def as_markdown(rows: DataFrame, by: list[str], order: list, most: int | None = None) -> DataFrame:
    """One Markdown list for each group: box, text, people after a dash; after ``most`` items the number of the others."""
    mark = F.when(F.col("status") == "done", "x").otherwise(" ")
    item = F.concat(F.lit("- ["), mark, F.lit("] "), "text", F.when(F.size("people") > 0, F.concat(F.lit(" — "), F.array_join("people", ", "))).otherwise(""))
    numbered = rows.withColumns({"_k": F.row_number().over(Window.partitionBy(*by).orderBy(*order)), "_item": item})
    shown = F.col("_item") if most is None else F.when(F.col("_k") <= most, F.col("_item"))
    listed = F.transform(F.sort_array(F.collect_list(F.when(shown.isNotNull(), F.struct("_k", "_item")))), lambda x: x["_item"])
    left = F.count("*") - F.size(listed)
    return numbered.groupBy(*by).agg(F.concat(F.array_join(listed, "\n"), F.when(left > 0, F.concat(F.lit("\n… "), left.cast("string"))).otherwise("")).alias("markdown"))


def all_tasks(*kinds: DataFrame) -> DataFrame:
    """Tasks of notes of several kinds, one behind the other; columns that one hasn't are null."""
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
