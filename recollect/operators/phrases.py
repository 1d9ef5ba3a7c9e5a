"""Tokens with places, word classes, noun phrases, names of any length in texts, and names spelt nearly alike."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import tokens as words_of
from recollect.plans.dialect import Queries
from recollect.shared import filtered_early, written
from recollect.tables import table

Q = Queries()

#: A token is a word (letters and digits, with apostrophes and hyphens inside) or any other visible character.
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s]"
#: Closed classes, in the four languages of the data. A word of several classes has the one that comes first.
CLOSED: dict[str, str] = {
    "det": "the a an this these those my your his its our their der die das ein eine einen dem den des mein dein sein ihr el los las un una unos unas mi tu su le les une des mon ton son ce cette",
    "pron": "i you he she it we they who ich er sie wir yo él ella nosotros ellos je il elle nous vous ils",
    "prep": "of in on at to from with for by about into over under von zu mit für aus bei nach auf de en con por para sin sobre du à dans avec pour sur par chez",
    "conj": "and or but if because und oder aber weil y o pero si porque et ou mais que",
    "aux": "is are was were be been am has have had do does did will would can could isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't haven't hasn't ist sind war hat haben wird kann es son era ha han puede est sont était a ont peut",
    "adv": "not very here there now then always nicht sehr hier jetzt immer no muy aquí ahora siempre pas très ici maintenant toujours",
}
#: Endings that open-class words of the four languages mostly have; the first that fits counts.
ENDINGS: tuple[tuple[str, str], ...] = (
    ("noun", "(tion|sion|ment|ness|ity|ship|ance|ence|heit|keit|ung|schaft|ción|dad|eza|miento|age|eur|té)$"),
    ("adj", "(able|ible|ful|less|ous|ive|lich|ig|isch|oso|osa|ivo|iva|eux|euse|ique)$"),
    ("adv", "(ly|mente|ment)$"),
    ("verb", "(ing|ize|ise|ed|ieren|ando|iendo|ar|er|ir|ez|ons)$"),
)
_NOMINAL = ("noun", "name")


def token_rows(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, position from 0, start, end, token) of texts (keys, text); start and end (exclusive) count characters of the text."""
    found = F.zip_with(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.split("text", TOKEN, -1), lambda t, b: F.struct(t.alias("t"), F.length(b).alias("b")))
    rows = texts.select(*keys, F.posexplode(found).alias("position", "f")).where("f.t is not null")
    before = Window.partitionBy(*keys).orderBy("position")
    end = F.sum(F.length("f.t") + F.col("f.b")).over(before)
    return rows.select(*keys, "position", (end - F.length("f.t")).alias("start"), end.alias("end"), F.col("f.t").alias("token"))


def tagged(tokens: DataFrame, *keys: str) -> DataFrame:
    """tokens with tag: closed classes by lexicon, open ones by ending and place, then mended by what stands before.

    A capital inside a sentence makes a name. What a determiner or adjective leads to is a noun, also a word that
    looks like a verb; an unknown word behind a pronoun is a verb, and any other unknown word a noun.
    """
    spark = tokens.sparkSession
    lexicon: dict[str, str] = {}
    for tag, words in CLOSED.items():
        for w in words.split():
            lexicon.setdefault(w, tag)
    listed = spark.createDataFrame(list(lexicon.items()), "w string, closed string")
    low, order = F.translate(F.lower("token"), "’", "'"), Window.partitionBy(*keys).orderBy("position")
    before = lambda c: F.lag(c).over(order)
    opens = before("token").isNull() | before("token").isin(".", "!", "?", ":")
    ending: Column | None = None
    for tag, pattern in ENDINGS:
        ending = F.when(low.rlike(pattern), tag) if ending is None else ending.when(low.rlike(pattern), tag)
    first = (
        F.when(F.col("closed").isNotNull(), F.col("closed")).when(~F.col("token").rlike(r"[\p{L}\p{N}]"), "punct").when(F.col("token").rlike(r"^[\p{N}]"), "num")
        .when(F.col("token").rlike(r"^\p{Lu}\p{Ll}") & ~opens, "name").otherwise(F.coalesce(ending, F.lit("open")))
    )
    rows = tokens.join(F.broadcast(listed), low == F.col("w"), "left").withColumn("first", first)
    led = before("first").isin("det", "adj")
    tag = F.when(F.col("first").isin("verb", "open") & led, "noun").when((F.col("first") == "open") & (before("first") == "pron"), "verb").when(F.col("first") == "open", "noun").otherwise(F.col("first"))
    return rows.withColumn("tag", tag).select(*tokens.columns, "tag")


def noun_phrases(tags: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, n_tokens, head) of runs: a determiner or number, adjectives, then nouns and names, with one of these at least.

    Islands: a run breaks where a word can't belong to one, before a determiner, and where a noun is followed by none.
    """
    order = Window.partitionBy(*keys).orderBy("position")
    before, inside = F.lag("tag").over(order), F.col("tag").isin("det", "num", "adj", *_NOMINAL)
    begins = inside & (before.isNull() | ~before.isin("det", "num", "adj", *_NOMINAL) | (F.col("tag") == "det") | (before.isin(*_NOMINAL) & ~F.col("tag").isin(*_NOMINAL)))
    runs = tags.withColumn("run", F.when(inside, F.sum(begins.cast("int")).over(order))).where("run is not null")
    found = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tokens"), F.max_by("token", "position").alias("head"), F.max(F.col("tag").isin(*_NOMINAL)).alias("nominal"))
    return found.where("nominal").drop("run", "nominal")


def _leftmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of text, place and falling length, those that begin behind the last one kept."""
    last, until = None, -1
    for batch in batches:
        keep = []
        for key, place, n in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key = key.as_py()
            if key != last:
                last, until = key, -1
            keep.append(place >= until)
            if keep[-1]:
                until = place + n
        yield batch.filter(pa.array(keep, pa.bool_()))


def mentions(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, place, n_words, name_id) of the names (name_id, name) that texts (key, text) hold, leftmost and longest first, none over another.

    Texts and names are compared word by word in lower case. Places where a name's first word stands are joined with the
    numbers of words that names with that first word have, and the words there with the names: nothing is compared with
    all names, and a first word that is common costs a row for each of its lengths only. Names of equal words count as the smallest name_id.
    """
    known = names.select("name_id", words_of(F.col("name")).alias("w")).where("size(w) > 0")
    known = written(known.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min("name_id").alias("name_id"), F.first("w").getItem(0).alias("first"), F.first(F.size("w")).alias("n_words")), "names")
    longest = known.agg(F.max("n_words")).first()[0] or 1
    lengths = known.groupBy("first").agg(F.collect_set("n_words").alias("lengths"))  # as many as names have lengths
    said = texts.select(key, words_of(F.col("text")).alias("w"))
    at = said.select(key, F.explode(F.transform("w", lambda x, i: F.struct(i.alias("place"), x.alias("first"), F.slice("w", i + 1, F.lit(longest)).alias("ahead")))).alias("p")).select(key, "p.*")
    here = at.join(lengths, "first").select(key, "place", "ahead", F.explode("lengths").alias("n_words")).where("size(ahead) >= n_words")
    phrases = here.select(key, "place", F.col("n_words"), F.array_join(F.slice("ahead", F.lit(1), F.col("n_words")), " ").alias("phrase"))
    found = phrases.join(known.select("phrase", "name_id"), "phrase").select(key, F.col("place").cast("int").alias("place"), F.col("n_words").cast("int").alias("n_words"), "name_id")
    return found.repartition(key).sortWithinPartitions(key, "place", F.desc("n_words")).mapInArrow(_leftmost, found.schema)


RATIO, SHORTEST, APART = 0.88, 5, 2


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (c.to_pylist() for c in batch.columns)
        matcher, rows = SequenceMatcher(None), []
        for x, y in zip(a, b, strict=True):
            matcher.set_seqs(x, y)
            r = matcher.ratio() if matcher.quick_ratio() >= RATIO else 0.0
            if r >= RATIO:
                rows.append((x, y, r))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["name", "known", "ratio"])


def alike_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, known, ratio) of all pairs of different names (name) and known ones (known) whose matching characters are RATIO of both or more,
    whatever their letters and lengths.

    If 2 * matched >= RATIO * both lengths, at most d = (1 - RATIO) * both lengths characters are left over, an even number if both lengths together are even.
    Of d + 1 segments of the name, counted from 0, one is in the known name whole, with i characters left over before it if it is the i-th (take the first one that
    isn't outrun by what is left over up to its end), so it is moved by -i, 2 - i, ... or i. Names are dealt by their segments, known
    names by what can stand in such a place; Levenshtein's distance, at most d, and letters that the other hasn't keep most of the rest from Python.
    """
    left, right = names.select("name", F.length("name").alias("n")).where("name <> ''").distinct(), known.select("known", F.length("known").alias("m")).where("known <> ''").distinct()
    most = F.floor((1 - RATIO) * (F.col("n") + F.col("m")) + 1e-9)
    lengths = left.select("n").distinct().crossJoin(right.select("m").distinct()).withColumn("d", (most - (most + F.col("n") + F.col("m")) % 2).cast("int"))
    lengths = written(lengths.where((F.col("d") > 0) & (F.abs(F.col("n") - F.col("m")) <= F.col("d"))), "lengths")
    cut = lambda i: F.floor(F.col("n") * i / (F.col("d") + 1)).cast("int")
    place, segment = ["n", "d", "i", "gram"], F.explode(F.sequence(F.lit(0), "d")).alias("i")
    of = left.join(lengths.select("n", "d").distinct(), "n").select("name", "n", "d", segment)
    of = of.select("name", "n", "d", "i", F.substring("name", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("gram"))
    at = right.join(lengths, "m").select("known", "m", "n", "d", segment).select("*", F.explode(F.sequence(-F.col("i"), F.col("i"), F.lit(2))).alias("by"))
    # what is left over of the name before the segment, of the known name before it, and of both behind it
    can = (F.col("i") - F.col("by") <= F.col("d") + F.col("n") - F.col("m")) & (F.col("i") + F.col("by") <= F.col("d") + F.col("m") - F.col("n")) & (F.abs(F.col("m") - F.col("n") - F.col("by")) <= F.col("d") - F.col("i"))
    start, end = cut(F.col("i")) + F.col("by"), cut(F.col("i") + 1) + F.col("by")
    at = at.where(can & (start >= 0) & (end <= F.col("m"))).select("known", "m", "n", "d", "i", F.substring("known", start + 1, end - start).alias("gram"))
    lost = lambda a, b: 2 * F.length(F.call_function("translate", F.col(a), F.col(b), F.lit("")))
    near = (F.levenshtein("name", "known") <= F.col("d")) & (lost("name", "known") <= F.col("d") + F.col("n") - F.col("m")) & (lost("known", "name") <= F.col("d") + F.col("m") - F.col("n"))
    with filtered_early(left.sparkSession):
        pairs = written(of.join(written(at, "segments"), place).where((F.col("name") != F.col("known")) & near).select("name", "known").distinct(), "pairs")
    return pairs.mapInArrow(_ratios, "name string, known string, ratio double")


def near_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, known, ratio) by the rule for keys of things, a part of `alike_names`: all pairs of different names (name) and known ones (known) of equal first letter,
    SHORTEST characters and more, at most APART apart in length and without digits, whose matching characters are RATIO of both or more.

    If 2 * matched >= RATIO * both lengths, then at most e = (1 - RATIO) * (2 n + APART) characters are left over, and each spoils
    two pairs of neighbouring letters of a name at most. So of any 2 e + 1 of its pairs, here the rarest, one is in the other name too.
    Pairs are looked up together with the first letter and the length, and are rare or not among known names of such a letter and
    length; Levenshtein's distance, at most what is left over of both names, keeps most of the rest from Python.
    """
    plain = lambda c: (F.length(c) >= SHORTEST) & ~F.col(c).rlike("[0-9]")
    left, right = names.select("name").where(plain("name")).distinct(), known.select("known").where(plain("known")).distinct()

    def grams(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
        # equal pairs of one name are told apart by their number
        numbered = F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))
        return df.select(c, F.substring(c, 1, 1).alias("first"), n.alias("size"), F.explode(numbered).alias("gram"))

    place = ["first", "size", "gram"]
    of = grams(right, "known").withColumn("size", F.explode(F.sequence(F.col("size") - APART, F.col("size") + APART)))
    df = written(of.groupBy(place).agg(F.count("*").alias("df")), "grams")
    rare = Window.partitionBy("name").orderBy(F.coalesce("df", F.lit(0)), "gram")
    spoilt = 2 * F.floor((1 - RATIO) * (2 * F.length("name") + APART) + 1e-9)
    keys = grams(left, "name").join(df, place, "left").withColumn("r", F.row_number().over(rare)).where((F.col("r") <= spoilt + 1) & F.col("df").isNotNull())
    left_over = (1 - RATIO) * (F.length("name") + F.length("known")) + 1e-9
    pairs = keys.select("name", *place).join(of, place).where("name <> known").select("name", "known").distinct().where(F.levenshtein("name", "known") <= left_over)
    return pairs.mapInArrow(_ratios, "name string, known string, ratio double")


_TOKEN_SQL = r"""
    t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s]') AS w,
                 string_split_regex(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s]') AS b FROM conversations),
    u AS (SELECT conv_id, turn, unnest(w) AS token, unnest(b[1:len(w)]) AS gap, unnest(generate_series(0, len(w) - 1)) AS position FROM t),
    tok AS (SELECT conv_id, turn, token, position, sum(length(token) + length(gap)) OVER o - length(token) AS start, sum(length(token) + length(gap)) OVER o AS "end" FROM u WINDOW o AS (PARTITION BY conv_id, turn ORDER BY position))"""


@Q.add(f"WITH {_TOKEN_SQL} SELECT conv_id, turn, position::INT AS position, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", token FROM tok")
def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every turn with its place."""
    return token_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def _classes_sql() -> str:
    quoted = lambda w: w.replace("'", "''")
    lexicon = ", ".join(f"('{quoted(w)}', {i}, '{tag}')" for i, (tag, ws) in enumerate(CLOSED.items()) for w in ws.split())
    endings = " ".join(f"WHEN regexp_matches(replace(lower(token), '’', ''''), '{p}') THEN '{tag}'" for tag, p in ENDINGS)
    return rf"""
    lex AS (SELECT w, arg_min(tag, i) AS closed FROM (VALUES {lexicon}) AS v(w, i, tag) GROUP BY w),
    p AS (SELECT tok.*, closed, lag(token) OVER (PARTITION BY conv_id, turn ORDER BY position) AS prev FROM tok LEFT JOIN lex ON w = replace(lower(token), '’', '''')),
    f AS (SELECT *, CASE WHEN closed IS NOT NULL THEN closed WHEN NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') THEN 'punct' WHEN regexp_matches(token, '^\p{{N}}') THEN 'num'
                         WHEN regexp_matches(token, '^\p{{Lu}}\p{{Ll}}') AND NOT (prev IS NULL OR prev IN ('.', '!', '?', ':')) THEN 'name' {endings} ELSE 'open' END AS first FROM p),
    g AS (SELECT *, CASE WHEN first IN ('verb', 'open') AND lag(first) OVER o IN ('det', 'adj') THEN 'noun' WHEN first = 'open' AND lag(first) OVER o = 'pron' THEN 'verb'
                         WHEN first = 'open' THEN 'noun' ELSE first END AS tag FROM f WINDOW o AS (PARTITION BY conv_id, turn ORDER BY position))"""


@Q.add(f"WITH {_TOKEN_SQL}, {_classes_sql()} SELECT conv_id, turn, tag, count(*) AS n FROM g GROUP BY ALL")
def turn_word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn by word class."""
    tags = tagged(token_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id", "turn")
    return tags.groupBy("conv_id", "turn", "tag").agg(F.count("*").alias("n"))


@Q.add(f"""
    WITH {_TOKEN_SQL}, {_classes_sql()},
    m AS (SELECT *, tag IN ('det', 'num', 'adj', 'noun', 'name') AS inside, lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY position) AS was FROM g),
    r AS (SELECT *, sum(CASE WHEN inside AND (was IS NULL OR was NOT IN ('det', 'num', 'adj', 'noun', 'name') OR tag = 'det' OR (was IN ('noun', 'name') AND tag NOT IN ('noun', 'name'))) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id, turn ORDER BY position) AS run FROM m)
    SELECT conv_id, turn, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", count(*) AS n_tokens, arg_max(token, position) AS head FROM r WHERE inside
    GROUP BY conv_id, turn, run HAVING bool_or(tag IN ('noun', 'name'))""")
def turn_noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun phrases of every turn."""
    tags = tagged(token_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id", "turn")
    return noun_phrases(tags, "conv_id", "turn")


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to six words: the openings of the benchmark's passages, and each of their words of ten letters and more."""
    w = words_of(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*[F.array_join(F.slice(w, 1, n), " ") for n in (2, 3, 4, 6)])).alias("name"))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.filter(w, lambda x: F.length(x) >= 10)).alias("name"))
    return asked.union(words).select(F.abs(F.xxhash64("name")).alias("name_id"), "name").distinct()


@Q.add()
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents name something of a gazetteer of one to six words."""
    return mentions(table(spark, sf_dir, "documents"), _gazetteer(spark, sf_dir), "doc_id")


@Q.add()
def nearest_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of the documents that the benchmark hasn't, the known word spelt most alike (ratio 0.88 and more, whatever its first letter and length;
    ties: the smaller word)."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("known")).distinct()
    said = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("name")).distinct()
    found = alike_names(said.join(known, said.name == known.known, "left_anti"), known)
    return found.groupBy("name").agg(F.min_by("known", F.struct(-F.col("ratio"), "known")).alias("known"), F.round(F.max("ratio"), 6).alias("ratio"))


QUERIES, ORACLE = Q.queries, Q.oracle
