"""Text expressions: rendering, links, tasks, dates, tokens, JSON repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs and words that notes use.
STATUS = {" ": "open", "x": "done", "X": "done", "/": "in_progress", "-": "cancelled"}
PRIORITY_SIGNS = {"⏫": "critical", "🔺": "high", "🔼": "medium", "🔽": "low"}
PRIORITY_SECTIONS = {"фокус": "high", "основные": "medium", "второстепенные": "low", "подумать": "low"}
DATE_SIGNS = {"completion_date": "✅", "scheduled_date": "⏳", "start_date": "🛫", "due_date": "📅"}
TRUE_WORDS = ("true", "yes", "1", "да")
DAY_WORDS = {"позавчера": -2, "вчера": -1, "сегодня": 0, "завтра": 1, "послезавтра": 2}
NUMBER_WORDS = {
    "один": 1, "одну": 1, "одного": 1, "два": 2, "две": 2, "двух": 2, "три": 3, "трёх": 3, "трех": 3, "четыре": 4, "четырёх": 4, "четырех": 4, "пять": 5, "пяти": 5,
    "шесть": 6, "шести": 6, "семь": 7, "семи": 7, "восемь": 8, "восьми": 8, "девять": 9, "девяти": 9, "десять": 10, "десяти": 10,
}
WEEKDAYS = {"понедельник": 0, "вторник": 1, "среда": 2, "среду": 2, "четверг": 3, "пятница": 4, "пятницу": 4, "суббота": 5, "субботу": 5, "воскресенье": 6, "воскресение": 6}
UNIT_DAYS = {"день": 1, "дня": 1, "дней": 1, "неделю": 7, "недели": 7, "недель": 7, "месяц": 30, "месяца": 30, "месяцев": 30}


def strip(text: Column) -> Column:
    """Without white space at both ends, the Unicode kinds included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens_estimate(text: Column, chars: float = 2.5) -> Column:
    """Tokens at so many characters each, rounded up; null and empty texts have none."""
    return F.coalesce(F.ceil(F.length(text) / chars), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normal_keyword(word: Column) -> Column:
    """Lower case, but abbreviations in capitals of more than one character stay."""
    w = strip(word)
    return F.when((F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)), w).otherwise(F.lower(w))


def split_list(text: Column) -> Column:
    """Parts of a list at semicolons, or at commas where there is none."""
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")


# --- rendering ------------------------------------------------------------------------


def render_inline(inline: Column) -> Column:
    """Markdown of one inline (``type``, ``text``, ``href``, ``marks``), the marks put on in their order."""
    wrap = lambda t, m: F.when(m == "bold", F.concat(F.lit("**"), t, F.lit("**"))).when(m == "italic", F.concat(F.lit("*"), t, F.lit("*"))).when(m == "code", F.concat(F.lit("`"), t, F.lit("`"))).otherwise(t)
    text = F.coalesce(inline["text"], F.lit(""))
    base = F.when(inline["type"] == "link", F.concat(F.lit("["), text, F.lit("]("), F.coalesce(inline["href"], F.lit("")), F.lit(")"))).otherwise(text)
    marked = F.aggregate(F.coalesce(inline["marks"], F.array().cast("array<string>")), base, wrap)
    return F.when(text == "", "").otherwise(marked)


def inline_text(inlines: Column) -> Column:
    """Texts of the inlines that aren't images, joined by a space."""
    shown = F.filter(F.transform(inlines, lambda x: F.when(x["type"].isin("text", "link"), render_inline(x)).otherwise("")), lambda t: t != "")
    return F.array_join(shown, " ")


def render_block(kind: Column, level: Column, inlines: Column) -> Column:
    """Markdown of one block; code, images and links have none."""
    text = inline_text(inlines)
    return F.when(kind == "header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "list_item", F.concat(F.lit("- "), text)).when(kind.isin("paragraph", "blockquote"), text).otherwise("")


# --- links ----------------------------------------------------------------------------


def wiki_link(inner: Column) -> Column:
    """``target``, ``section`` and ``display`` of what stands between double brackets."""
    has_alias = F.contains(inner, F.lit("|"))
    alias = F.when(has_alias, F.trim(F.substring_index(inner, "|", -1)))
    body = F.when(has_alias, F.regexp_extract(inner, r"^(.*)\|[^|]*$", 1)).otherwise(inner)
    target = F.trim(F.regexp_extract(body, "^([^#]*)", 1))
    section = F.when(F.contains(body, F.lit("#")), F.trim(F.regexp_extract(body, "#(.*)$", 1)))
    nonempty = lambda c: F.when(c != "", c)
    return F.struct(target.alias("target"), nonempty(section).alias("section"), F.coalesce(nonempty(alias), nonempty(section), target).alias("display"))


def links(text: Column) -> Column:
    """Links in order, wiki links first, each raw form once: ``raw``, ``kind``, ``target``, ``section``, ``display``."""
    wiki = F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[[^\[\]]+\]\]"), F.lit(0))),
        lambda r: F.struct(r.alias("raw"), F.lit("wiki").alias("kind"), *(wiki_link(F.substr(r, F.lit(3), F.length(r) - 4))[f].alias(f) for f in ("target", "section", "display"))),
    )
    plain = F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\[)\[[^\[\]]*\]\([^()\s]+\)"), F.lit(0))),
        lambda r: F.struct(r.alias("raw"), F.lit("url").alias("kind"), F.regexp_extract(r, r"\(([^()]*)\)$", 1).alias("target"), F.lit(None).cast("string").alias("section"), F.regexp_extract(r, r"^\[([^\]]*)\]", 1).alias("display")),
    )
    return F.concat(wiki, plain)


def file_version(name: Column) -> Column:
    """``article`` and ``version`` of a name such as ``note_20250101_120000.yaml``; no version is null."""
    version = F.regexp_extract(name, r"_([0-9]{8}_[0-9]{6})\.ya?ml$", 1)
    article = F.regexp_replace(name, r"(?:_[0-9]{8}_[0-9]{6})?\.ya?ml$", "")
    return F.struct(article.alias("article"), F.when(version != "", version).alias("version"))


# --- task lines -----------------------------------------------------------------------


def _sign(text: Column, table: dict[str, str], other) -> Column:
    out = None
    for sign, value in table.items():
        out = F.when(F.contains(text, F.lit(sign)), value) if out is None else out.when(F.contains(text, F.lit(sign)), value)
    return out.otherwise(other)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def task(line: Column, section: Column) -> Column:
    """A task line taken apart; null if the line is no task."""
    trimmed = strip(line)
    box = r"(?U)^[-*]\s+\[([ xX/\-])\]\s+(.*)$"
    mark, body = F.regexp_extract(trimmed, box, 1), F.regexp_extract(trimmed, box, 2)
    status = None
    for sign, name in STATUS.items():
        status = F.when(mark == sign, name) if status is None else status.when(mark == sign, name)
    priority = _sign(body, PRIORITY_SIGNS, _sign(F.lower(F.coalesce(section, F.lit(""))), PRIORITY_SECTIONS, F.lit("normal")))
    dates = {name: F.try_to_date(_found(body, rf"{sign}\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})")) for name, sign in DATE_SIGNS.items()}
    rule = _found(body, r"🔁\s*([^⏳🛫📅✅⏫🔺🔼🔽#\[(]+)")
    until = _found(rule, r"until\s+([0-9]{4}-[0-9]{2}-[0-9]{2})")
    recurrence = F.when(rule.isNotNull(), F.struct(F.trim(F.regexp_replace(rule, r"\s*until\s+[0-9-]+", "")).alias("rule"), F.try_to_date(until).alias("until")))
    slot = r"([0-9]{1,2}:[0-9]{2})\s*[-–]\s*([0-9]{1,2}:[0-9]{2})"
    time = F.when(body.rlike(slot), F.struct(F.regexp_extract(body, slot, 1).alias("start"), F.regexp_extract(body, slot, 2).alias("end")))
    found = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), wiki_link)
    people = F.transform(found, lambda x: x["display"])
    tags = F.regexp_extract_all(body, F.lit(r"(?U)(?<!\w)#([\w\-/]+)"), F.lit(1))
    comment = _found(body, r"\(([^()]*)\)\s*$")
    text = body
    for pattern in (r"🔁\s*[^⏳🛫📅✅⏫🔺🔼🔽#\[(]+", r"[⏳🛫📅✅]\s*[0-9]{4}-[0-9]{2}-[0-9]{2}", "[⏫🔺🔼🔽]️?", slot, r"\[\[[^\[\]]+\]\]", r"(?U)(?<!\w)#[\w\-/]+", r"\([^()]*\)\s*$"):
        text = F.regexp_replace(text, pattern, " ")
    text = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    whole = F.struct(text.alias("text"), status.alias("status"), priority.alias("priority"), *(d.alias(n) for n, d in dates.items()), recurrence.alias("recurrence"), time.alias("time_slot"), found.alias("wiki_links"), people.alias("people"), tags.alias("tags"), comment.alias("inline_comment"), section.alias("section"), trimmed.alias("raw_line"))
    return F.when(trimmed.rlike(box), whole)


def task_line(status: Column, slot: Column, text: Column, people: Column, dates: dict[str, Column], rule: Column) -> Column:
    """A task line from its parts: box, time, text, people, start, due, repetition, scheduled, done."""
    mark = F.when(status == "done", "x").when(status == "in_progress", "/").when(status == "cancelled", "-").otherwise(" ")
    dated = lambda name: F.when(dates[name].isNotNull(), F.concat(F.lit(DATE_SIGNS[name] + " "), F.date_format(dates[name], "yyyy-MM-dd"))) if name in dates else F.lit(None).cast("string")
    named = F.when(F.size(people) > 0, F.array_join(F.transform(people, lambda p: F.concat(F.lit("[["), p, F.lit("]]"))), " "))
    return F.concat_ws(" ", F.concat(F.lit("- ["), mark, F.lit("]")), slot, text, named, dated("start_date"), dated("due_date"), F.when(rule.isNotNull(), F.concat(F.lit("🔁 "), rule)), dated("scheduled_date"), dated("completion_date"))


# --- small values ---------------------------------------------------------------------


def sexagesimal(value: Column) -> Column:
    """``H:MM`` of minutes that a loader read as a number; other text stays."""
    n = value.cast("string").try_cast("int")
    return F.when(n.isNotNull(), F.concat((n / 60).cast("int").cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))).otherwise(value.cast("string"))


def minutes(duration: Column) -> Column:
    """Minutes of ``H:MM``; null for anything else."""
    ok = duration.rlike("^[0-9]+:[0-9]{1,2}$")
    return F.when(ok, F.substring_index(duration, ":", 1).try_cast("int") * 60 + F.substring_index(duration, ":", -1).try_cast("int"))


def truth(value: Column) -> Column:
    """Whether the text is a word for true; null is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def mean_of(values: Column) -> Column:
    """Mean of the values that aren't null."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))


def first_name(name: Column) -> Column:
    """The last of two words, else the first."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def relative_date(text: Column, reference: Column) -> Column:
    """Date that a Russian phrase means, seen from a reference date; the reference if none is understood.

    A word for a day is the whole phrase; numbers of days, weeks or months ago, weekdays
    of this week, the last or the one before, and written dates may be inside one.
    """
    t = F.lower(F.trim(text))
    table = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    listed = lambda values: "|".join(sorted(values, key=lambda w: (-len(w), w)))
    ago = rf"([0-9]+|{listed(NUMBER_WORDS)})\s+({listed(UNIT_DAYS)})\s+назад"
    amount, unit = F.regexp_extract(t, ago, 1), F.regexp_extract(t, ago, 2)
    days = F.coalesce(amount.try_cast("int"), F.try_element_at(table(NUMBER_WORDS), amount)) * F.try_element_at(table(UNIT_DAYS), unit)
    single = F.regexp_extract(t, r"(день|неделю|месяц)\s+назад", 1)
    weekday = F.try_element_at(table(WEEKDAYS), F.regexp_extract(t, rf"({listed(WEEKDAYS)})", 1))
    own = F.weekday(reference)
    monday = F.date_sub(reference, own)
    week = lambda back: F.date_add(monday, F.coalesce(weekday, F.lit(0)) - 7 * back)
    weeks_ago = lambda word: t.rlike(rf"(?U)\b{word}\w*\s+недел")
    iso, dotted = F.regexp_extract(t, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.regexp_extract(t, r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", 0)
    found = (
        F.when(F.try_element_at(table(DAY_WORDS), t).isNotNull(), F.date_add(reference, F.try_element_at(table(DAY_WORDS), t)))
        .when(unit != "", F.date_sub(reference, days.cast("int")))
        .when((single != "") & weekday.isNull(), F.date_sub(reference, F.try_element_at(table(UNIT_DAYS), single)))
        .when(weeks_ago("позапрошл") & weekday.isNotNull(), week(2))
        .when(weeks_ago("прошл"), week(1))
        .when(weekday.isNotNull(), F.date_sub(reference, F.pmod(own - weekday, F.lit(7)).cast("int")))
        .when(weeks_ago("позапрошл"), week(2))
        .when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))
        .when(dotted != "", F.try_to_date(dotted, "d.M.yyyy"))
    )
    return F.coalesce(found, reference)


# --- answers of language models -------------------------------------------------------


def without_thoughts(text: Column) -> Column:
    """Without think tags and code fences."""
    clean = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(clean))


def repaired_json(text: Column) -> Column:
    """The first JSON array, or object as an array of one, that can be read in an answer; null if none."""
    clean = without_thoughts(text)
    mended = F.regexp_replace(clean, r",\s*([\]}])", "$1")
    forms = []
    for form in (clean, mended):
        array, single = F.regexp_extract(form, r"(?s)\[.*\]", 0), F.regexp_extract(form, r"(?s)\{.*\}", 0)
        forms += [F.when(F.try_parse_json(array).isNotNull() & (array != ""), array), F.when(F.try_parse_json(single).isNotNull() & (single != ""), F.concat(F.lit("["), single, F.lit("]")))]
    return F.coalesce(*forms)


def flat_json(text: Column) -> Column:
    """The first object without inner braces in an answer that can be read; null if none."""
    first = F.regexp_extract(without_thoughts(text), r"\{[^{}]*\}", 0)
    return F.when((first != "") & F.try_parse_json(first).isNotNull(), first)


def token_usage(answer: Column) -> Column:
    """Prompt and completion tokens of an answer's JSON, whichever way its maker names them; zeros if none."""
    v = F.try_parse_json(answer)
    pick = lambda *paths: F.coalesce(*(F.try_variant_get(v, p, "bigint") for p in paths), F.lit(0).cast("bigint"))
    into = pick("$.usage_metadata.input_tokens", "$.token_usage.prompt_tokens", "$.usage.prompt_tokens", "$.prompt_eval_count", "$.prompt_tokens")
    out = pick("$.usage_metadata.output_tokens", "$.token_usage.completion_tokens", "$.usage.completion_tokens", "$.eval_count", "$.completion_tokens")
    return F.struct(into.alias("prompt"), out.alias("completion"), (into + out).alias("total"), F.lit(1).alias("calls"))


def fill(template: str, **values: Column) -> Column:
    """A prompt: the template with each ``{name}`` replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
