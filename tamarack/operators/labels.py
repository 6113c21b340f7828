"""Entities, properties and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.functions import text


def question_ids(source: DataFrame, uid: str = "uid", sparql: str = "sparql_wikidata", order: Column | None = None) -> DataFrame:
    """(uid, ids) with the sorted distinct ids of each question's query; the first row of a repeated uid counts."""
    ids = source.select(F.col(uid).alias("uid"), text.ids_of(F.col(sparql)).alias("ids"), (order if order is not None else F.monotonically_increasing_id()).alias("_at"))
    return ids.groupBy("uid").agg(F.min_by("ids", "_at").alias("ids"))


def distinct_ids(ids: DataFrame) -> DataFrame:
    return ids.select(F.explode("ids").alias("id")).distinct()


def exploded(ids: DataFrame) -> DataFrame:
    """(uid, id); a uid without ids is left out, as in the map's flat form."""
    return ids.select("uid", F.explode("ids").alias("id"))


def gathered(flat: DataFrame) -> DataFrame:
    return flat.groupBy("uid").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def from_bindings(wanted: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, labels) for every wanted id, its labels in order of arrival; none gives an empty list. ``bindings``: (pos, id, label)."""
    joined = wanted.select("id").distinct().join(bindings, "id", "left")
    lists = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("pos", "label")))).alias("found"))
    return lists.select("id", F.transform("found", lambda x: x["label"]).alias("labels"))


def parsed_response(responses: DataFrame, column: str = "body") -> DataFrame:
    """(pos, id, label) of SPARQL JSON responses."""
    parsed = responses.select(F.from_json(column, schemas.RESPONSE).alias("r"))
    return parsed.select(F.posexplode("r.results.bindings").alias("pos", "b")).select("pos", F.col("b.id.value").alias("id"), F.col("b.label.value").alias("label"))


def with_labels(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(uid, id, labels); an id without labels has an empty list."""
    return exploded(ids).join(labels, "id", "left").select("uid", "id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def local_lookup(wanted: DataFrame, preferred: DataFrame, alternative: DataFrame, language: str) -> DataFrame:
    """What the labelling query asks an endpoint for, over local (id, label, lang) tables: distinct labels of one language from both."""
    both = preferred.unionByName(alternative).where(F.col("lang") == language).select("id", "label").distinct()
    return wanted.select("id").distinct().join(both, "id")


def labelling_query(id_: Column, language: str, indent: int = 0) -> Column:
    """The SPARQL text that asks for one id's labels."""
    if indent < 0:
        raise ValueError("indent must not be negative")
    lines = [
        (0, ["SELECT DISTINCT ?id ?label WHERE {"]), (1, ['BIND("', id_, '" AS ?id) .']), (1, ["{"]), (2, ["wd:", id_, " rdfs:label ?label ."]), (1, ["} UNION {"]),
        (2, ["wd:", id_, " skos:altLabel ?label ."]), (1, ["}"]), (1, [f'FILTER(LANG(?label) = "{language}") .']), (0, ["}"]),
    ]
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for depth, parts in lines for p in ("\t" * (indent + depth), *parts, "\n")])


def labelling_queries(chunks: DataFrame, language: str) -> DataFrame:
    """(chunk, query): one request for the ids of each chunk, in their order."""
    one = F.concat(F.lit("\t{\n"), labelling_query(F.col("id"), language, 2), F.lit("\t}\n"))
    parts = chunks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("id", one.alias("part")))).alias("parts"))
    return parts.select("chunk", F.concat(F.lit("SELECT ?id ?label WHERE {\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\tUNION\n"), F.lit("}")).alias("query"))
