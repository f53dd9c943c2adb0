"""The few places where Spark SQL and the checking engine's SQL spell the same thing differently.

Every plan is written once, as SQL text over a Dialect. Spark runs one rendering, the oracle is the other.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def epoch_ms(self, ts: str) -> str:
        return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div 1000)"

    def series(self, first: str | int, last: str | int) -> str:
        return f"explode(sequence({first}, {last}))"

    def unnest(self, array: str) -> str:
        return f"explode({array})"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def regex_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def regex_one(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)})"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} rlike {self.lit(pattern)})"

    def split(self, s: str, sep: str) -> str:
        return f"split({s}, {self.lit(chr(92) + sep if sep in '.|+?*()[]' else sep)})"

    def at(self, array: str, i: str | int) -> str:
        """Element i from 1; null beyond the end."""
        return f"try_element_at({array}, CAST({i} AS INT))"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def filter(self, a: str, var: str, cond: str) -> str:
        return f"filter({a}, {var} -> {cond})"

    def map(self, a: str, var: str, expr: str) -> str:
        return f"transform({a}, {var} -> {expr})"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0e0, (s, v) -> s + v)"

    def fold(self, a: str, zero: str, acc: str, var: str, expr: str) -> str:
        return f"aggregate({a}, {zero}, ({acc}, {var}) -> {expr})"

    def json_text(self, doc: str, key: str) -> str:
        return f"get_json_object({doc}, '$.{key}')"

    def date_text(self, ts: str, style: str) -> str:
        return f"date_format({ts}, '{style}')"

    def code(self, ch: str) -> str:
        return f"ascii({ch})"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def strip_accents(self, s: str) -> str:
        accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
        plain = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
        return f"translate({s}, '{accented}', '{plain}')"

    def month_start(self, ts: str) -> str:
        return f"CAST(date_trunc('MONTH', {ts}) AS TIMESTAMP_NTZ)"

    def from_hex(self, digits: str) -> str:
        return f"CAST(conv({digits}, 16, 10) AS BIGINT)"

    def char(self, code: str) -> str:
        """The character of a code point; nothing for numbers that are none."""
        return f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') ELSE '' END"

    def base36(self, n: str) -> str:
        return f"lower(conv({n}, 10, 36))"

    def map_of(self, key: str, value: str) -> str:
        return f"map_from_entries(collect_list(named_struct('k', CAST({key} AS BIGINT), 'v', CAST({value} AS BIGINT))))"

    def map_get(self, m: str, key: str) -> str:
        """The value of a key; null without it."""
        return f"try_element_at({m}, CAST({key} AS BIGINT))"

    def map_total(self, m: str) -> str:
        return f"aggregate(map_values({m}), CAST(0 AS BIGINT), (s, v) -> s + v)"


class Duck(Spark):
    name = "duckdb"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def epoch_ms(self, ts: str) -> str:
        return f"(epoch_us({ts}) // 1000)"

    def series(self, first: str | int, last: str | int) -> str:
        return f"unnest(generate_series({first}, {last}))"

    def unnest(self, array: str) -> str:
        return f"unnest({array})"

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def regex_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def split(self, s: str, sep: str) -> str:
        return f"string_split({s}, {self.lit(sep)})"

    def at(self, array: str, i: str | int) -> str:
        return f"list_extract({array}, {i})"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def collect(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def filter(self, a: str, var: str, cond: str) -> str:
        return f"list_filter({a}, lambda {var}: {cond})"

    def map(self, a: str, var: str, expr: str) -> str:
        return f"list_transform({a}, lambda {var}: {expr})"

    def total(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0e0)"

    def fold(self, a: str, zero: str, acc: str, var: str, expr: str) -> str:
        return f"list_reduce(list_prepend({zero}, {a}), lambda {acc}, {var}: {expr})"

    def json_text(self, doc: str, key: str) -> str:
        return f"json_extract_string({doc}, '$.{key}')"

    def date_text(self, ts: str, style: str) -> str:
        for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
            style = style.replace(a, b)
        return f"strftime({ts}, '{style}')"

    def code(self, ch: str) -> str:
        return f"ascii({ch})"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def strip_accents(self, s: str) -> str:
        return f"strip_accents({s})"

    def month_start(self, ts: str) -> str:
        return f"CAST(date_trunc('month', {ts}) AS TIMESTAMP)"

    def from_hex(self, digits: str) -> str:
        return f"coalesce(TRY_CAST(concat('0x', {digits}) AS BIGINT), -1)"

    def char(self, code: str) -> str:
        return f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INT)) ELSE '' END"

    def base36(self, n: str) -> str:
        digits = f"list_transform(generate_series(6, 0, -1), lambda e: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({n} // CAST(power(36, e) AS BIGINT)) % 36 AS INT) + 1, 1))"
        return f"coalesce(nullif(ltrim(array_to_string({digits}, ''), '0'), ''), '0')"

    def map_of(self, key: str, value: str) -> str:
        return f"map_from_entries(list({{'k': CAST({key} AS BIGINT), 'v': CAST({value} AS BIGINT)}}))"

    def map_get(self, m: str, key: str) -> str:
        return f"map_extract_value({m}, CAST({key} AS BIGINT))"

    def map_total(self, m: str) -> str:
        return f"CAST(list_sum(map_values({m})) AS BIGINT)"



SPARK, DUCK = Spark(), Duck()
