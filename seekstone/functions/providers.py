"""Extensions as table functions: a manifest names providers, a query is routed to one of them, and
its answer is rows, a list's items or one panel.

A provider is a plain function of the query's text. ``install`` checks the manifest and makes of every
provider a Python table function whose columns ``analyze`` gives by the provider's kind, so that SQL
and DataFrames call it by name in a lateral join. An answer that breaks the provider's own contract,
or a provider that fails, gives an ``error`` for that query and no rows for others' sake.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from seekstone.functions import routing
from seekstone.operators.results import provider_rows
from seekstone.shared import stage

#: Columns by kind of answer.
ANSWERS = {
    "list": "id string, title string, subtitle string, icon string, priority int, action struct<id:string,payload:string>, error string",
    "panel": "panel string, error string",
}
#: Items of one answer at most (a fixed value), as in a result list.
MOST_ITEMS = 200


@dataclass(frozen=True)
class Provider:
    """``answer(text)`` gives a list of items (dicts with ``id`` and ``title``), a panel (a dict with
    ``blocks``), or None for no answer; ``triggers`` are ``(kind, value)``, kind ``prefix`` or ``keyword``."""

    name: str
    kind: str
    answer: Callable[[str], object]
    triggers: tuple[tuple[str, str], ...]


@dataclass
class Installed:
    """Providers of all manifests in the order in which they were installed."""

    spark: SparkSession
    providers: list[tuple[str, Provider]] = field(default_factory=list)

    def function(self, plugin: str, provider: Provider) -> str:
        """The name under which SQL knows a provider."""
        return "provider_" + "_".join("".join(c if c.isalnum() else "_" for c in x) for x in (plugin, provider.name))

    def triggers(self) -> DataFrame:
        rows = [(f"{plugin}:{p.name}", kind, value, place) for place, (plugin, p, kind, value) in enumerate((plugin, p, *t) for plugin, p in self.providers for t in p.triggers)]
        return self.spark.createDataFrame(rows, "provider string, kind string, value string, place int")


def listed(answer: object) -> Iterator[tuple]:
    """Rows of a list; an item without an id or a title breaks the contract."""
    if not isinstance(answer, list):
        raise TypeError("not a list of items")
    if len(answer) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    for item in answer:
        action = item.get("action")
        shown = None if action is None else (str(action["id"]), json.dumps(action.get("payload"), sort_keys=True))
        yield (str(item["id"]), str(item["title"]), item.get("subtitle"), item.get("icon"), int(item.get("priority") or 0), shown, None)


def shown_panel(answer: object) -> Iterator[tuple]:
    if not isinstance(answer, dict) or not isinstance(answer.get("blocks"), list):
        raise TypeError("not a panel")
    yield (json.dumps(answer, sort_keys=True), None)


def table_function(provider: Provider) -> type:
    """The table function of a provider: one text in, rows of its kind out."""
    schema, answer, rows = ANSWERS[provider.kind], provider.answer, {"list": listed, "panel": shown_panel}[provider.kind]
    columns = StructType.fromDDL(schema)  # here, for the worker that analyzes has no session
    width = len(columns.fields)

    class Answer:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.dataType.typeName() not in ("string", "void"):
                raise ValueError("a provider takes a text")
            return AnalyzeResult(columns)

        def eval(self, text: str):
            try:
                given = answer(text or "")
                found = [] if given is None else list(rows(given))
            except Exception as failed:  # noqa: BLE001  (whatever an extension raises stays its own)
                found = [(None,) * (width - 1) + (f"{type(failed).__name__}: {failed}",)]
            yield from found

    return Answer


def install(installed: Installed, manifest: dict, providers: list[Provider]) -> Installed:
    """Register the providers of ``manifest(schema_version, api_version, id, entry)``; one that may not be
    registered, and a kind or trigger that is not known, is an error and registers nothing."""
    spark = installed.spark
    checked = routing.valid_manifest(*(F.lit(manifest.get(k)) for k in ("schema_version", "api_version", "id", "entry")))
    if not spark.range(1).select(checked.alias("ok")).first()["ok"]:
        raise ValueError(f"not a manifest that may be registered: {manifest.get('id')}")
    for p in providers:
        if p.kind not in ANSWERS or any(kind not in ("prefix", "keyword") or not value for kind, value in p.triggers):
            raise ValueError(f"provider {p.name} has a kind or a trigger that is not known")
    out = Installed(spark, [*installed.providers, *((manifest["id"], p) for p in providers)])
    for p in providers:
        spark.udtf.register(out.function(manifest["id"], p), udtf(table_function(p)))
    return out


def answers(installed: Installed, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists, panels and errors of ``queries(query_id, text)``.

    Lists are ``(query_id, id, title, subtitle, icon, score, place, action)`` with ids that name the
    extension and the provider; panels ``(query_id, provider, panel)`` hold blocks of known kinds only;
    errors ``(query_id, provider, error)``. Only queries that a provider's trigger meets reach it.
    """
    spark = installed.spark
    routed = stage(routing.route(queries, installed.triggers()), "routed")
    found = {"list": spark.createDataFrame([], f"query_id {routed.schema['query_id'].dataType.simpleString()}, provider string, {ANSWERS['list']}"),
             "panel": spark.createDataFrame([], f"query_id {routed.schema['query_id'].dataType.simpleString()}, provider string, {ANSWERS['panel']}")}
    for plugin, p in installed.providers:
        asked = routed.where(F.col("provider") == f"{plugin}:{p.name}")
        name = f"asked_{installed.function(plugin, p)}"
        asked.createOrReplaceTempView(name)
        given = spark.sql(f"SELECT a.query_id, a.provider, g.* FROM {name} a, LATERAL {installed.function(plugin, p)}(a.rest) g")
        found[p.kind] = found[p.kind].unionByName(given)
    # an extension runs once a query
    whole = {kind: stage(df, "answers") for kind, df in found.items()}
    items = whole["list"].where("error is null")
    ids = F.concat(F.lit("plugin:"), "provider", F.lit(":"), F.col("id"))
    lists = provider_rows(items.select("query_id", ids.alias("id"), "title", "subtitle", "icon", "priority", "action")).drop("priority")
    panels = whole["panel"].where("error is null").select("query_id", "provider", routing.panel(F.col("panel")).alias("panel"))
    errors = whole["list"].where("error is not null").select("query_id", "provider", "error").unionByName(whole["panel"].where("error is not null").select("query_id", "provider", "error"))
    return lists, panels, errors
