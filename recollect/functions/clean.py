"""Column functions that take chat texts, titles, versions and dates apart. Each is a composition of built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of blocks that a client puts around or between what people say.
BLOCKS = ("system-reminder", "context", "tool_result", "thinking", "think")
#: Placeholders that an editor or client shows where no title was given, in the four languages of the data.
GENERIC_TITLES = (
    "no subject", "no title", "draft", "blank page", "ohne titel", "kein betreff", "entwurf", "neuer dialog", "sin asunto", "borrador", "nuevo diálogo", "sans titre", "brouillon", "nouveau dialogue",
)
#: What opens a request to keep something, and verbs and modals that mark decisions and constraints, in the same languages.
KEEP = ("make a note", "write this down", "store this", "merk dir", "notiere", "apunta", "anota", "retiens", "notez")
DECIDING = ("resolved to", "opted for", "picked", "the plan is", "beschlossen", "entschieden", "wir nehmen", "acordado", "elegimos", "hemos decidido", "retenu", "nous prenons", "on part sur")
BINDING = ("required", "forbidden", "mandatory", "no later than", "no more than", "shall not", "muss", "darf nicht", "höchstens", "spätestens", "debe", "prohibido", "como máximo", "doit", "interdit", "au plus tard")


def without_blocks(text: Column, tags: tuple[str, ...] = BLOCKS) -> Column:
    """Whole <tag> ... </tag> blocks taken out; an open block without an end reaches to the end of the text."""
    names = "|".join(tags)
    out = F.regexp_replace(text, rf"(?s)<({names})>.*?</\1>\s*", "")
    return F.regexp_replace(out, rf"(?s)<({names})>.*$", "")


def scrubbed(text: Column) -> Column:
    """Blocks, headings of speakers on lines of their own, and clocks at the ends of lines taken out."""
    out = F.regexp_replace(without_blocks(text), r"(?im)^(user|assistant|system|human|you|ai)[ \t]*:[ \t]*\n", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+\d{1,2}:\d{2}([ \t]?[AP]M)?$", ""), r"^\s+|\s+$", "")


def hinted_model(text: Column) -> Column:
    """The model that a message header names, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?im)^model:[ \t]*([\w.-]+)[ \t]*$", 1)), F.lit(""))


def hinted_time(text: Column) -> Column:
    """The local time that a message header gives; null if there is none or it is no time."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(?im)^local time:[ \t]*(\d{4}-\d{2}-\d{2} \d{2}:\d{2})[ \t]*$", 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm"))


def asked_to_remember(text: Column) -> Column:
    """What follows a request to remember, or null."""
    return F.nullif(F.regexp_extract(text, r"(?is)^\s*(?:please,?\s+|bitte\s+|por favor,?\s+)?(?:" + "|".join(KEEP) + r")\s*(?::|,)\s*(.*)$", 1), F.lit(""))


def code_blocks(text: Column, last: int = 2) -> Column:
    """The bodies of the last whole fenced blocks, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))
    return F.slice(found, F.greatest(F.lit(1), F.size(found) - last + 1), last)


def clean_title(title: Column) -> Column:
    """The title without what follows a last dash or bar, white space as single spaces; null for a generic one."""
    out = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s+[|–—-]\s+[^|–—-]*$", ""), r"\s+", " "))
    return F.when((out == "") | F.lower(out).isin(*GENERIC_TITLES), None).otherwise(out)


def listed(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def version_parts(version: Column) -> Column:
    """Numbers of a version, trailing zeroes left out, so that arrays compare as versions do; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(version, "^[vV]", ""), r"(\.0+)+$", "")
    return F.when(plain.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(plain, r"\."), lambda x: x.cast("long")))


def rolled_year(said: Column, at: Column, past: Column) -> Column:
    """A month and day (MM-dd) said without a year: the last such day up to `at` in the past tense, otherwise the next one from it."""
    # eight years either way: 29 February can be as far, around a century that is no leap year
    years = F.sequence(F.year(at) - 8, F.year(at) + 8)
    days, day = F.transform(years, lambda y: F.try_to_date(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), said), "yyyy-MM-dd")), F.to_date(at)
    return F.when(past, F.array_max(F.filter(days, lambda d: d <= day))).otherwise(F.array_min(F.filter(days, lambda d: d >= day)))


def asked_window(at: Column, unit: Column) -> Column:
    """(low, high) around a time: a day and a half either way, a week from it for `week`, 31 days for `month`."""
    half = F.expr("interval 36 hours")
    low = F.when(unit.isin("week", "month"), at).otherwise(at - half)
    high = F.when(unit == "week", at + F.expr("interval 7 days")).when(unit == "month", at + F.expr("interval 31 days")).otherwise(at + half)
    return F.struct(low.alias("low"), high.alias("high"))


def plausible_time(seconds: Column, received: Column, oldest: float = 946_684_800.0, ahead: float = 86_400.0) -> Column:
    """A client's time in seconds if it is after `oldest` and not more than `ahead` seconds after it was received; otherwise that."""
    return F.when((seconds >= oldest) & (seconds <= received + ahead), seconds).otherwise(received)


def utc_seconds(stamp: Column) -> Column:
    """Seconds of an ISO 8601 time with Z or an offset; null for anything else."""
    return F.unix_micros(F.when(stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(stamp))) / F.lit(1e6)


def section(sentence: Column) -> Column:
    """question, decision, constraint or other: what part of a hand-off a sentence belongs to."""
    # words parted by single spaces, so that a phrase is found as whole words by its text
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    has = lambda phrases: F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(low, p))
    return F.when(sentence.rlike(r"\?\s*$"), "question").when(has(DECIDING), "decision").when(has(BINDING), "constraint").otherwise("other")
