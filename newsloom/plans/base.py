"""Registration of queries, literal fixtures, and pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rows:
    """Literal rows, the same for Spark and for SQL."""

    def __init__(self, ddl: str, rows: Sequence[tuple]):
        self.ddl, self.rows = ddl, list(rows)
        parts, depth, now = [], 0, ""
        for ch in ddl:  # commas within < > do not end a column
            depth += (ch == "<") - (ch == ">")
            if ch == "," and not depth:
                parts.append(now)
                now = ""
            else:
                now += ch
        self.columns = [tuple(p.strip().split(" ", 1)) for p in (*parts, now)]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]"}
        casts = ", ".join(f"CAST(c{k} AS {kinds[t.lower()]}) AS {n}" for k, (n, t) in enumerate(self.columns))
        values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({', '.join(f'c{k}' for k in range(len(self.columns)))}))"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(literal(x) for x in v) + "]" if v else "CAST([] AS VARCHAR[])"
    return "'" + str(v).replace("'", "''") + "'"


def names(values: Sequence[str]) -> str:
    return ", ".join(literal(v) for v in values)


# --- SQL counterparts of functions/ -------------------------------------------------------------

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def s_collapse(x: str) -> str:
    return s_trim(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def s_clean(x: str) -> str:
    return s_collapse(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")


def s_unescape(x: str) -> str:
    from newsloom.functions.text import ENTITIES

    for entity, char in ENTITIES:
        x = f"replace({x}, {literal(entity)}, {literal(char)})"
    return x


def s_clean_unescaped(x: str) -> str:
    return s_clean(s_unescape(f"coalesce({x}, '')"))


def s_title(x: str) -> str:
    from newsloom.functions.vocabulary import TITLE_STOPWORDS

    words = f"string_split({s_collapse(f'''regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g')''')}, ' ')"
    return f"trim(left(array_to_string(list_filter({words}, lambda w: length(w) >= 3 AND w NOT IN ({names(TITLE_STOPWORDS)})), ' '), 220))"


def s_tokens(x: str) -> str:
    return f"list_filter(string_split(trim(coalesce({x}, '')), ' '), lambda w: w <> '')"


def s_matches(x: str, patterns: Sequence[str]) -> str:
    return f"regexp_matches({x}, {literal('(?i)(?:' + '|'.join(patterns) + ')')})"


def s_score(x: str, patterns: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {literal('(?i)' + p)}) AS INTEGER)" for p in patterns) + ")"


def s_class(x: str, section: str) -> tuple[str, str]:
    """Category and sentiment of a clean quote."""
    from newsloom.functions import vocabulary as V

    category = "CASE " + " ".join(f"WHEN {s_matches(x, p)} THEN '{n}'" for n, p in V.CATEGORY_PATTERNS.items()) + " END"
    sentiment = (
        f"CASE {section} WHEN 'positives' THEN 'positive' WHEN 'negatives' THEN 'negative' WHEN 'technical_notes' THEN "
        f"CASE WHEN {s_matches(x, V.TECHNICAL_NEGATIVE_PATTERNS)} THEN 'negative' WHEN {s_matches(x, V.TECHNICAL_POSITIVE_PATTERNS)} THEN 'positive' ELSE 'neutral' END END"
    )
    return category, sentiment


# URLs

def s_scheme(u: str) -> str:
    return f"lower(regexp_extract({s_trim(u)}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def s_rest(u: str) -> str:
    return f"regexp_replace({s_trim(u)}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', '')"


def s_netloc(u: str) -> str:
    return f"regexp_extract({s_rest(u)}, '^//([^/?#]*)', 1)"


def s_path(u: str) -> str:
    return f"regexp_extract(regexp_replace({s_rest(u)}, '^//[^/?#]*', ''), '^([^?#]*)', 1)"


def s_query(u: str) -> str:
    return f"regexp_extract({s_rest(u)}, '^[^?#]*\\?([^#]*)', 1)"


def s_host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({s_netloc(u)}, '^.*@', ''), ':\\d*$', ''))"


def s_canonical(u: str) -> str:
    from newsloom.functions.vocabulary import TRACKING_PARAMETERS

    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(list_filter(string_split({s_query(u)}, '&'), lambda x: x <> ''), lambda x: {{'k': {dec('''split_part(x, '=', 1)''')}, 'v': {dec('''CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END''')}}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: lower(p.k) NOT IN ({names(TRACKING_PARAMETERS)})))"
    encoded = f"array_to_string(list_transform({kept}, lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    return (
        f"(CASE WHEN {s_scheme(u)} <> '' THEN {s_scheme(u)} || ':' ELSE '' END || CASE WHEN {s_netloc(u)} <> '' THEN '//' || lower({s_netloc(u)}) ELSE '' END"
        f" || coalesce(nullif(regexp_replace({s_path(u)}, '/+$', ''), ''), '/') || CASE WHEN {encoded} <> '' THEN '?' || {encoded} ELSE '' END)"
    )


def s_identity(u: str) -> str:
    return f"lower(regexp_replace(lower({s_netloc(u)}), '^www\\.', '') || regexp_replace({s_path(u)}, '/+$', ''))"


def s_cache_url(u: str) -> str:
    where = f"regexp_replace(coalesce(nullif({s_path(u)}, ''), '/'), '/+', '/', 'g')"
    return f"(coalesce(nullif({s_scheme(u)}, ''), 'https') || '://' || lower({s_netloc(u)}) || CASE WHEN {where} = '/' THEN '/' ELSE regexp_replace({where}, '/+$', '') END)"
