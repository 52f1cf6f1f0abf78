"""SQL entry: one statement, with the reference's spellings and table functions that Spark lacks."""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import pin
from tessera.sources import files

#: Functions whose names differ only.
_NAMES = {
    "strlen": "octet_length",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "prefix": "startswith",
    "suffix": "endswith",
    "list_value": "array",
    "list_contains": "array_contains",
    "struct_pack": "named_struct",
    "string_agg": "listagg",
    "arg_min": "min_by",
    "arg_max": "max_by",
    "error": "raise_error",
}
_QUOTED = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
_RULES = "org.apache.spark.sql.catalyst.optimizer."
#: What a run without the optimizer leaves out.
SWITCHED_OFF = [_RULES + r for r in ("PushDownPredicates", "ColumnPruning", "ConstantFolding", "ReorderJoin", "PushDownLeftSemiAntiJoin", "LimitPushDown", "CombineFilters", "BooleanSimplification")]
_LABELS: dict[str, str | None] = {"query": None, "session": None}


def translate(statement: str) -> str:
    """Rewrite spellings outside literals: ``//`` to ``div``, ``~~`` to LIKE, function names."""

    def plain(text: str) -> str:
        text = text.replace("!~~", " NOT LIKE ").replace("~~", " LIKE ").replace("//", " div ")
        return re.sub(r"\b(" + "|".join(_NAMES) + r")\s*\(", lambda m: _NAMES[m[1].lower()] + "(", text, flags=re.I)

    parts = _QUOTED.split(statement)
    return "".join(p if i % 2 else plain(p) for i, p in enumerate(parts))


def set_query_label(text: str | None) -> None:
    """A name for the jobs of the next statement only."""
    _LABELS["query"] = text


def set_session_label(text: str | None) -> None:
    """A name for the jobs of every statement that has none of its own."""
    _LABELS["session"] = text


# table functions


def _one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def _functions(spark: SparkSession) -> dict[str, Callable[..., DataFrame]]:
    def read_parquet(path, filename=False, file_row_number=False, hive_partitioning=True, union_by_name=False):
        paths = [path] if isinstance(path, str) else path
        return files.read_parquet(spark, *paths, merge_schema=union_by_name, filename=filename, file_row_number=file_row_number)

    def pin_table(source, **more):
        return _one_row(spark, rows=pin.pin_table(spark, source, **more).count())

    def unpin_table(name):
        pin.unpin_table(name)
        return _one_row(spark, done=True)

    def reset_cache():
        pin.reset_cache(spark)
        return _one_row(spark, done=True)

    def query_label(text):
        set_query_label(text)
        return _one_row(spark, done=True)

    def session_label(text):
        set_session_label(text)
        return _one_row(spark, done=True)

    return {
        "read_parquet": read_parquet,
        "read_csv": lambda path, header=True: spark.read.option("header", header).option("inferSchema", True).csv(path),
        "read_json": lambda path: spark.read.json(path),
        "analyze_parquet": lambda path: files.footer_statistics(spark, path),
        "pin_table": pin_table,
        "unpin_table": unpin_table,
        "reset_cache": reset_cache,
        "set_query_label": query_label,
        "set_session_label": session_label,
        "create_ann_index": lambda table, column, **more: _one_row(spark, lists=len(pin.create_ann_index(table, column, **more).centroids)),
        "drop_ann_index": lambda table, column=None, metric=None: _one_row(spark, dropped=pin.drop_ann_index(table, column, metric)),
        "knn_search": pin.knn_search,
    }


def _arguments(text: str) -> tuple[list, dict]:
    """Literals and ``name => literal`` pairs: strings, numbers, booleans, lists."""
    spelled = {"true": "True", "false": "False", "null": "None"}

    def plain(t: str) -> str:
        t = re.sub(r"\b(true|false|null)\b", lambda m: spelled[m[1].lower()], t, flags=re.I)
        return re.sub(r"(\w+)\s*(?:=>|:=)", r"\1=", t)

    parts = _QUOTED.split(text)
    python = "".join(repr(p[1:-1].replace("''", "'")) if i % 2 and p[0] == "'" else plain(p) for i, p in enumerate(parts))
    call = ast.parse(f"f({python})", mode="eval").body
    return [ast.literal_eval(a) for a in call.args], {k.arg: ast.literal_eval(k.value) for k in call.keywords}


def _with_views(spark: SparkSession, statement: str) -> str:
    """Table functions in FROM, JOIN or CALL, each replaced by a view of its result."""
    known = _functions(spark)
    call = re.compile(r"\b(from|join|call|,)\s+(" + "|".join(known) + r")\s*\(", re.I)
    at = 0
    while m := call.search(statement, at):
        end, depth, quoted = m.end(), 1, False
        while depth and end < len(statement):
            c = statement[end]
            quoted = quoted != (c == "'")
            depth += 0 if quoted else (c in "([") - (c in ")]")
            end += 1
        positional, by_name = _arguments(statement[m.end() : end - 1])
        view = f"_call_{uuid.uuid4().hex}"
        known[m[2].lower()](*positional, **by_name).createOrReplaceTempView(view)
        word = "SELECT * FROM" if m[1].lower() == "call" else m[1]
        statement = f"{statement[: m.start()]}{word} {view}{statement[end:]}"
        at = m.start() + len(word) + len(view)
    return statement


def run(spark: SparkSession, statement: str, enable_optimizer: bool = True, label: str | None = None, **parameters) -> DataFrame:
    """Run exactly one statement; parameters are ``:name`` markers.

    ``label`` (or the one of ``set_query_label``) names this statement's jobs until the next statement is run.
    Without the optimizer the result belongs to a copy of the session in which its rules are switched off, so
    that holds for whatever is done with it."""
    body = statement.strip().rstrip(";")
    if any(";" in p for i, p in enumerate(_QUOTED.split(body)) if i % 2 == 0):
        raise ValueError("exactly one statement is expected")
    name, _LABELS["query"] = label or _LABELS["query"] or _LABELS["session"], None
    spark.sparkContext.setJobDescription(name)
    body = _with_views(spark, body)
    if not enable_optimizer:
        spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(SWITCHED_OFF))
    return spark.sql(translate(body), args=parameters) if parameters else spark.sql(translate(body))
