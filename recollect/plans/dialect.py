"""One statement of a query for two engines: Spark runs it, DuckDB checks it.

The relational part of the statements is the same text for both. Where function names or literals differ,
a query asks its dialect for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.shared import spread, written
from recollect.tables import table, views


class Spark:
    each, nl = "explode", "chr(10)"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def tokens(self, x: str) -> str:
        return f"regexp_extract_all(lower({x}), {self.lit('[\\p{L}\\p{N}]+')}, 0)"

    def finds(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def like(self, x: str, pattern: str) -> str:
        return f"{x} rlike {self.lit(pattern)}"

    def seconds(self, a: str, b: str) -> str:
        return f"timestampdiff(SECOND, {a}, {b})"

    def epoch(self, t: str) -> str:
        return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {t})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def joined(self, x: str, sep: str = ",", order: str | None = None) -> str:
        if order is None:
            return f"array_join(array_sort(collect_list({x})), '{sep}')"
        return f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as x))), s -> s.x), '{sep}')"

    def listed(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} as o, {x} as x))), s -> s.x)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def at(self, x: str, i: str) -> str:
        """Element i, from 1; null beyond the end."""
        return f"try_element_at({x}, cast({i} as int))"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(sep)}, -1)"

    def map(self, x: str, v: str, e: str) -> str:
        return f"transform({x}, {v} -> {e})"

    def keep(self, x: str, v: str, e: str) -> str:
        return f"filter({x}, {v} -> {e})"

    def series(self, a: str, b: str) -> str:
        return f"if(({b}) < ({a}), array(), sequence(cast({a} as int), cast({b} as int)))"

    def slice(self, x: str, start: str, n: str) -> str:
        return f"slice({x}, cast({start} as int), cast({n} as int))"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def sum_of(self, x: str) -> str:
        return f"aggregate({x}, cast(0 as double), (a, b) -> a + b)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)"

    def hour(self, t: str, minutes: int = 60) -> str:
        return f"window({t}, '{minutes} minutes').start"

    def month(self, t: str) -> str:
        return f"date_format({t}, 'yyyy-MM')"

    def days(self, t: str, n: int) -> str:
        return f"({t} + interval '{n}' day)"

    def instr(self, x: str, s: str) -> str:
        return f"instr({x}, {s})"

    def bits(self, x: str) -> str:
        return f"bit_count({x})"

    def url(self, x: str, part: str) -> str:
        return f"parse_url({x}, '{part}')"

    def distinct_sorted(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def dbl(self, x: str) -> str:
        return f"cast({x} as double)"


class Duck(Spark):
    each = "unnest"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def tokens(self, x: str) -> str:
        return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"

    def finds(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def seconds(self, a: str, b: str) -> str:
        return f"date_sub('second', {a}, {b})"

    def epoch(self, t: str) -> str:
        return f"date_diff('second', timestamp '1970-01-01 00:00:00', {t})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def joined(self, x: str, sep: str = ",", order: str | None = None) -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order or x}, {x})"

    def listed(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order}, {x})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def at(self, x: str, i: str) -> str:
        return f"({x})[cast({i} as int)]"

    def split(self, x: str, sep: str) -> str:
        return f"string_split_regex({x}, {self.lit(sep)})"

    def map(self, x: str, v: str, e: str) -> str:
        return f"list_transform({x}, lambda {v}: {e})"

    def keep(self, x: str, v: str, e: str) -> str:
        return f"list_filter({x}, lambda {v}: {e})"

    def series(self, a: str, b: str) -> str:
        return f"generate_series(({a})::INT, ({b})::INT)"

    def slice(self, x: str, start: str, n: str) -> str:
        return f"list_slice({x}, ({start})::INT, ({start})::INT + ({n})::INT - 1)"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def sum_of(self, x: str) -> str:
        return f"coalesce(list_sum({x}), 0)"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(({a})::DOUBLE[], ({b})::DOUBLE[])"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def hour(self, t: str, minutes: int = 60) -> str:
        return f"time_bucket(interval '{minutes} minutes', {t}, timestamp '1970-01-01')"

    def month(self, t: str) -> str:
        return f"strftime({t}, '%Y-%m')"

    def url(self, x: str, part: str) -> str:
        if part == "HOST":
            return f"nullif(regexp_extract({x}, '^[a-z]+://([^/?#:]+)', 1), '')"
        return f"regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

    def distinct_sorted(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"


SPARK, DUCK = Spark(), Duck()
Statement = Callable[[Spark], str]


class Queries:
    """The queries of one module, by name, with their SQL for the check."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, tables: str, statement: Statement, large: str | None = None) -> None:
        """Registers a statement; if a table is named as large, shuffles are spread by its rows and the result is written."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, *tables.split())
            if large is None:
                return spark.sql(statement(SPARK))
            with spread(spark, table(spark, sf_dir, large).count()):
                return written(spark.sql(statement(SPARK)), name)

        run.__name__ = name
        self.queries[name] = run
        self.oracle[name] = statement(DUCK)

    def add(self, oracle: Statement | str | None = None, name: str | None = None):
        """Registers a DataFrame function, with the SQL that checks it."""

        def put(f):
            self.queries[name or f.__name__] = f
            if oracle is not None:
                self.oracle[name or f.__name__] = oracle if isinstance(oracle, str) else oracle(DUCK)
            return f

        return put
