"""Statements to triples, time phrases to dates, and texts without secrets: rules as column expressions.

A rule is a pattern, a relation and a mode: `is` states, `was` ends what held, `wish` wants. Every rule is one
regular expression over the sentence, so a batch of sentences is one projection without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(\p{Lu}[\p{L}\p{N}_'’-]*(?: (?:de |da |do |del |la |von |van )?\p{Lu}[\p{L}\p{N}_'’-]*)*)"
_THING = r"([\p{L}\p{N}_'’-]+(?: [\p{L}\p{N}_'’-]+){0,5}?)"
_END = r"(?: (?:any ?more|now|today|these days|at the moment))?\s*[.!]*\s*$"
#: (pattern, subject: a group number or a word, relation, object group, mode). The first of one (relation, mode) wins.
RULES: tuple[tuple[str, int | str, str, int, str], ...] = (
    (rf"^my name(?: is|'s) {_NAME}{_END}", "me", "named", 1, "is"),
    (rf"^call me {_NAME}{_END}", "me", "named", 1, "is"),
    (rf"^my ([a-z]+)'s name is {_NAME}{_END}", 1, "named", 2, "is"),
    (rf"^i(?: am|'m) (?:now )?(?:living|based) in {_NAME}{_END}", "me", "lives_in", 1, "is"),
    (rf"^i (?:now )?live in {_NAME}{_END}", "me", "lives_in", 1, "is"),
    (rf"^i(?: have|['’]ve)? moved (?:from {_NAME} )?to {_NAME}{_END}", "me", "lives_in", 2, "is"),
    (rf"^i(?: have|['’]ve)? moved from {_NAME} to {_NAME}{_END}", "me", "lives_in", 1, "was"),
    (rf"^i(?: no longer| don't| do not) live in {_NAME}{_END}", "me", "lives_in", 1, "was"),
    (rf"^i (?:now )?work (?:at|for) {_NAME}{_END}", "me", "works_at", 1, "is"),
    (rf"^i (?:quit|left|stopped working (?:at|for)) {_NAME}{_END}", "me", "works_at", 1, "was"),
    (rf"^i switched from {_THING} to {_THING}{_END}", "me", "uses", 2, "is"),
    (rf"^i switched from {_THING} to {_THING}{_END}", "me", "uses", 1, "was"),
    (rf"^i (?:now )?use {_THING}{_END}", "me", "uses", 1, "is"),
    (rf"^i (?:really )?(?:like|love|enjoy) {_THING}{_END}", "me", "likes", 1, "is"),
    (rf"^i(?: no longer| don't| do not) (?:like|love|enjoy) {_THING}{_END}", "me", "likes", 1, "was"),
    (rf"^i(?: am|'m) allergic to {_THING}{_END}", "me", "allergic_to", 1, "is"),
    (rf"^i(?: want|'d like| would like| hope) to (?:visit|see) {_NAME}{_END}", "me", "visit", 1, "wish"),
    (rf"^i(?: want|'d like| would like| hope) to (?:learn|study) {_THING}{_END}", "me", "learn", 1, "wish"),
    (rf"^my (?!name\b)([a-z]+) is (?!called)(?:an? |the )?{_THING}{_END}", "me", "has", 2, "is"),
    (rf"^(?!I\b|My\b){_NAME} lives in {_NAME}{_END}", 1, "lives_in", 2, "is"),
    (rf"^(?!I\b|My\b){_NAME} works (?:at|for) {_NAME}{_END}", 1, "works_at", 2, "is"),
    (rf"^(?!I\b|My\b){_NAME} (?:likes|loves|enjoys) {_THING}{_END}", 1, "likes", 2, "is"),
    (rf"^(?!I\b|My\b){_NAME} is (?:an? ){_THING}{_END}", 1, "is_a", 2, "is"),
)


def _pattern(rule: str) -> str:
    """First words in either case; names keep theirs."""
    for word in ("my name", "call me", "my ", "i"):
        if rule.startswith("^" + word):
            return "^" + "".join(f"[{c.upper()}{c}]" if k == 0 else c for k, c in enumerate(word)) + rule[1 + len(word):]
    return rule


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def triples(sentence: Column) -> Column:
    """array<struct<subj, rel, obj, mode>> of what a sentence states; a question states nothing."""
    return once(sentence, _triples)


def _triples(sentence: Column) -> Column:
    found = []
    for rule, subject, relation, place, mode in RULES:
        pattern = _pattern(rule)
        subj = F.lit(subject) if isinstance(subject, str) else F.regexp_extract(sentence, pattern, subject)
        obj = F.regexp_extract(sentence, pattern, place)
        triple = F.struct(subj.alias("subj"), F.lit(relation).alias("rel"), obj.alias("obj"), F.lit(mode).alias("mode"))
        found.append(F.when(~F.rtrim(sentence).endswith("?") & (obj != ""), triple))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


_UNITS = {"day": "day", "week": "week", "month": "month", "year": "year"}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_SMALL = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def resolved_day(said: Column, at: Column) -> Column:
    """The day that a phrase in `said` names, seen from a time; null without one. An ISO date wins, then the rest in the order below."""
    low, day = F.lower(said), F.to_date(at)
    number = lambda x: F.coalesce(*[F.when(x == w, i + 1) for i, w in enumerate(_SMALL)], F.when(x.isin("a", "an"), 1), x.try_cast("int"))
    cases: list[tuple[Column, Column]] = [
        (low.rlike(r"\b\d{4}-\d{2}-\d{2}\b"), F.try_to_date(F.regexp_extract(low, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")),
        (low.rlike(r"\bday before yesterday\b"), F.date_sub(day, 2)), (low.rlike(r"\bday after tomorrow\b"), F.date_add(day, 2)),
        (low.rlike(r"\byesterday\b"), F.date_sub(day, 1)), (low.rlike(r"\btomorrow\b"), F.date_add(day, 1)), (low.rlike(r"\b(today|tonight|this morning)\b"), day),
    ]
    count = rf"(\d{{1,3}}|an?|{'|'.join(_SMALL)})"
    for unit in _UNITS:
        for pattern, sign in ((rf"\b{count} {unit}s? ago\b", -1), (rf"\bin {count} {unit}s?\b", 1)):
            n = number(F.regexp_extract(low, pattern, 1)) * sign
            moved = {"day": F.date_add(day, n), "week": F.date_add(day, n * 7), "month": F.add_months(day, n), "year": F.add_months(day, n * 12)}[unit]
            cases.append((low.rlike(pattern), moved))
        for word, sign in (("last", -1), ("next", 1)):
            moved = {"day": F.date_add(day, sign), "week": F.date_add(day, 7 * sign), "month": F.add_months(day, sign), "year": F.add_months(day, 12 * sign)}[unit]
            cases.append((low.rlike(rf"\b{word} {unit}\b"), moved))
    for k, name in enumerate(_DAYS):
        ahead = F.pmod(F.lit(k) - F.weekday(day), F.lit(7))
        cases.append((low.rlike(rf"\blast {name}\b"), F.date_sub(day, F.when(ahead == 0, 7).otherwise(7 - ahead))))
        cases.append((low.rlike(rf"\b(next |on |this )?{name}\b"), F.date_add(day, F.when((ahead == 0) & low.rlike(rf"\bnext {name}\b"), 7).otherwise(ahead))))
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


#: Names under which people write credentials down, in the four languages of the data.
CREDENTIALS = ("password", "passcode", "login secret", "api key", "kennwort", "passwort", "zugangscode", "contraseña", "clave secreta", "mot de passe", "code secret")
#: Issuers' published formats, in full length, and what stands for a match.
ISSUED: tuple[tuple[str, str], ...] = (
    ("github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}", "[github token]"),  # fine-grained personal token
    ("gh[oprsu]_[A-Za-z0-9]{36}", "[github token]"),  # 40 characters altogether
    ("(AKIA|ASIA)[A-Z2-7]{16}", "[aws key id]"),  # 20 characters, base 32
    ("glpat-[A-Za-z0-9_-]{20}", "[gitlab token]"),
    ("xox[bp](-[0-9]{10,13}){2,3}-[A-Za-z0-9]{24,32}", "[slack token]"),  # workspace and user numbers, then the secret
    ("[rs]k_(live|test)_[A-Za-z0-9]{24,99}", "[stripe key]"),
    ("AIza[A-Za-z0-9_-]{35}", "[google key]"),  # 39 characters altogether
    ("eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "[jwt]"),  # header and claims are both JSON objects (RFC 7519)
)
#: A PEM block (RFC 7468): its first line, lines of base 64, and its last line if it is there.
_PEM = "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*(-----END [A-Z ]*PRIVATE KEY-----)?"
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"
_DIGITS, _DOTTED, _IBAN = "[0-9](?:[ -]?[0-9])*", "[0-9]+(?:[.][0-9]+)+", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4})+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    numbers = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def iban(number: Column) -> Column:
    """Whether letters and digits without spaces pass the check of account numbers (ISO 7064, modulo 97)."""
    turned = F.split(F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97)
    return F.length(number).between(15, 34) & (rest == 1)


def each_run(text: Column, pattern: str, stands: Callable[[Column], Column]) -> Column:
    """text with every match of the pattern (which has no groups) replaced by what stands for it, place by place."""
    between, runs = lambda t: F.split(t, pattern, -1), lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return once(text, lambda t: F.array_join(F.zip_with(between(t), F.transform(runs(t), stands), lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), ""))


def without_secrets(text: Column) -> Column:
    """text with credentials, addresses and numbers by what they are. Card, account and IP numbers are whole runs that pass their checks."""
    out = F.regexp_replace(text, _PEM, "[private key]")
    for pattern, stands in ISSUED:
        out = F.regexp_replace(out, pattern, stands)
    out = F.regexp_replace(out, "(?i)(authorization: *(?:bearer|basic)) +[A-Za-z0-9._~+/-]+=*", "$1 [credentials]")  # RFC 7235
    out = F.regexp_replace(out, "([a-z][a-z0-9+.-]*://[^\\s/:@]*):[^\\s/@]+@", "$1:[password]@")  # RFC 3986, user information
    names = "|".join(name.replace(" ", "[ _-]?") for name in CREDENTIALS)
    out = F.regexp_replace(out, f"(?i)({names})( *[:=] *| is | ist | es | est )[\"']?[^\\s\"',;]{{6,}}[\"']?", "$1$2[password]")
    out = F.regexp_replace(out, "(?i)(\\bpin)( *[:=] *| is | ist | es | est )[0-9]{4,12}(?![0-9])", "$1$2[pin]")  # ISO 9564: 4 to 12 digits
    out = each_run(out, _IBAN, lambda r: F.when(iban(F.replace(r, F.lit(" "), F.lit(""))), F.lit("[iban]")).otherwise(r))
    out = F.regexp_replace(F.regexp_replace(out, _MAIL, "[email]"), "[0-9a-fA-F]{32,}", "[hex]")
    octets = lambda r: F.split(r, "[.]")
    out = each_run(out, _DOTTED, lambda r: F.when((F.size(octets(r)) == 4) & F.forall(octets(r), lambda x: (F.length(x) <= 3) & (x.try_cast("int") <= 255)), F.lit("[ip]")).otherwise(r))
    plain = lambda r: F.regexp_replace(r, "[ -]", "")
    return each_run(out, _DIGITS, lambda r: F.when(F.length(plain(r)).between(13, 19) & luhn(plain(r)), F.lit("[card]")).otherwise(r))
