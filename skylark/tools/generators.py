"""Tools that make one value of a set of rows or of options: labels, topics, prompts, personas, keywords, brands, funnels."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import topics
from ..operators.records import attribute_sections
from .presets import _TEXT, _object, _strings
from .rows import MODEL, ask, call, fill

_SEEDS = _strings(minItems=3, maxItems=10)


def _one(system: str, text: str, schema: Mapping[str, Any], model: str = MODEL, retries: int = 3, backend: Any = None, **params: Any) -> Any:
    got, _, error = ask(model, [{"role": "system", "content": system}, {"role": "user", "content": text}], schema, params, retries, backend)
    if got is None:
        raise RuntimeError(error)
    return json.loads(got)


def first_records(df: DataFrame, order: str, most: int = 500) -> str:
    """The first records by attribute, as text for one prompt; a bounded number by definition of the tool."""
    head = df.orderBy(order).limit(most)
    return "\n\n".join(r["section"] for r in attribute_sections(head, order).orderBy("ord").collect())


def extract_labels(df: DataFrame, order: str, most_records: int = 500, most_labels: int = 10, **options: Any) -> dict[str, str]:
    """Label names with descriptions for a set of records, judged by the first ones; of equal names the last counts."""
    schema = _object(labels={"type": "array", "items": _object(name=_TEXT, description=_TEXT), "minItems": 1, "maxItems": most_labels})
    got = _one(f"Propose up to {most_labels} labels that divide the records well.", first_records(df, order, most_records), schema, **options)
    return {x["name"]: x["description"] for x in got["labels"]}


def extract_topics(df: DataFrame, order: str, most_records: int = 500, most_topics: int = 10, **options: Any) -> DataFrame:
    """(topic, subtopics) for a set of records; raises if subtopics are too near to each other or to their topic."""
    schema = _object(topics={"type": "array", "items": _object(topic=_TEXT, subtopics=_strings(minItems=1)), "minItems": 1, "maxItems": most_topics})
    got = _one(f"Propose up to {most_topics} topics with distinct subtopics for the records.", first_records(df, order, most_records), schema, **options)
    made = topics.topics_from_map(df.sparkSession, {t["topic"]: t["subtopics"] for t in got["topics"]})
    errors = [r["error"] for r in topics.subtopic_errors(made).limit(5).collect()]
    if errors:
        raise ValueError("; ".join(errors))
    return made


INTENTS = ["informational", "comparison", "recommendation", "transactional", "navigational", "troubleshooting", "opinion"]


def generate_prompts(instructions: str, low: int = 5, high: int = 100, **options: Any) -> list[dict[str, str]]:
    """Prompts with intents; at least 0 and not fewer at most than at least."""
    if low < 0 or high < low:
        raise ValueError("0 <= low <= high is needed")
    schema = _object(prompts={"type": "array", "items": _object(prompt=_TEXT, intent={"type": "string", "enum": INTENTS}), "minItems": low, "maxItems": high})
    return _one(f"Write {low} to {high} prompts that people would put to an assistant, each with its intent.", instructions, schema, **options)["prompts"]


def generate_persona(known: Sequence[Mapping[str, Any]] = (), instructions: str = "", **options: Any) -> dict[str, Any]:
    schema = _object(name=_TEXT, description=_TEXT, keywordSeeds=_SEEDS)
    return _one(f"Describe one more persona of the audience, unlike the known ones. {instructions}", json.dumps(list(known), ensure_ascii=False) or "none", schema, **options)


def generate_keywords(sector: str = "", market: str = "", language: str = "", brand: str = "", domain: str = "", known: Sequence[str] = (), **options: Any) -> dict[str, Any]:
    """Search keywords with an explanation for a brand or a domain, one of which is needed."""
    if not (brand or domain):
        raise ValueError("a brand or a domain is needed")
    about = {"brand": brand, "domain": domain, "sector": sector, "market": market, "language": language, "known": list(known)}
    return _one("Propose search keywords for the brand that are not known yet, and explain the choice.", json.dumps(about), _object(keywords=_strings(minItems=1), explanation=_TEXT), **options)


_BRAND = _object(
    name=_TEXT, shortName={"type": "string", "minLength": 1}, aliases=_strings(), description=_TEXT, domain=_TEXT, sectors=_strings(), markets=_strings(),
    portfolio={"type": "array", "items": _object(name=_TEXT, category=_TEXT)}, marketPosition={"type": "string", "enum": ["leader", "challenger", "niche", "new"]},
)


def generate_brand(brand: str = "", domain: str = "", **options: Any) -> dict[str, Any]:
    return _one("Describe the brand: names, domain, sectors, markets, portfolio, position.", json.dumps({"brand": brand, "domain": domain}), _BRAND, **options)


def generate_competitors(brand: Mapping[str, Any], least: int = 3, strict: bool = True, **options: Any) -> list[dict[str, Any]]:
    """At least `least` competitors with distinct short names; strict ones share sector and market."""
    clause = "Only direct competitors in the same sectors and markets." if strict else "Neighbouring sectors count too."
    got = _one(f"List the brand's competitors. {clause}", json.dumps(dict(brand)), _object(brands={"type": "array", "items": _BRAND, "minItems": least}), **options)["brands"]
    names = [b["shortName"].lower() for b in got]
    if len(set(names)) < len(names):
        raise ValueError("short names repeat")
    return got


def portfolio_keywords(brands: DataFrame, model: str = MODEL, **options: Any) -> DataFrame:
    """brands whose portfolio entries have keywordSeeds; the entries of all brands are asked in parallel, of equal brands once."""
    rows = brands.withColumn("_row", F.sha2(F.to_json(F.struct(*brands.columns)), 256))
    each = rows.dropDuplicates(["_row"]).select("_row", F.coalesce(F.get("sectors", F.lit(0)), F.lit("")).alias("sector"), F.posexplode("portfolio").alias("ord", "p"))
    prompt = fill("Product: {name} ({category}). Sector: {sector}.", name=F.col("p.name"), category=F.coalesce("p.category", F.lit("")), sector=F.col("sector"))
    asked = call(each, prompt, _object(seeds=_SEEDS), "Give seed keywords under which people search for the product.", model=model, **options)
    seeded = asked.select("_row", F.struct("ord", F.col("p.name").alias("name"), F.col("p.category").alias("category"), F.from_json("reply", "struct<seeds:array<string>>")["seeds"].alias("keywordSeeds")).alias("x"))
    again = seeded.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["name"].alias("name"), x["category"].alias("category"), x["keywordSeeds"].alias("keywordSeeds"))).alias("_new"))
    return rows.join(again, "_row", "left").withColumn("portfolio", F.coalesce("_new", F.array().cast("array<struct<name:string,category:string,keywordSeeds:array<string>>>"))).drop("_row", "_new")


#: stage, goal, category, what belongs there
FUNNEL = [
    ("awareness", "notice a need", "problems", "symptoms and questions that lead to the sector"),
    ("awareness", "notice a need", "basics", "what things are and how they work"),
    ("consideration", "weigh solutions", "comparisons", "one kind or product against another"),
    ("consideration", "weigh solutions", "criteria", "what matters in a choice"),
    ("decision", "choose", "prices", "costs and offers"),
    ("decision", "choose", "providers", "where to buy and whom to trust"),
    ("loyalty", "stay", "support", "use, care and trouble"),
    ("loyalty", "stay", "community", "tips and experiences"),
]


def generate_funnel(spark, sector: str, market: str = "", language: str = "", model: str = MODEL, **options: Any) -> DataFrame:
    """The funnel's categories fitted to a sector, one row each, with 3 to 10 keyword seeds, asked in parallel."""
    base = spark.createDataFrame([(i, *row) for i, row in enumerate(FUNNEL)], "ord int, stage string, goal string, category string, description string")
    prompt = fill("Sector: {sector}. Market: {market}. Language: {language}. Stage: {stage} ({goal}). Category: {category}, {description}.", sector=sector, market=market, language=language,
                  stage=F.col("stage"), goal=F.col("goal"), category=F.col("category"), description=F.col("description"))
    asked = call(base, prompt, _object(description=_TEXT, seeds=_SEEDS), "Fit the funnel's category to the sector and give seed keywords.", model=model, **options)
    got = F.from_json("reply", "struct<description:string,seeds:array<string>>")
    return asked.select("ord", "stage", "goal", "category", got["description"].alias("description"), got["seeds"].alias("keywordSeeds"))


def reseed_funnel(categories: DataFrame, sector: str, model: str = MODEL, **options: Any) -> DataFrame:
    """categories (with stage, category, description) with new keywordSeeds."""
    prompt = fill("Sector: {sector}. Stage: {stage}. Category: {category}, {description}.", sector=sector, stage=F.col("stage"), category=F.col("category"), description=F.coalesce("description", F.lit("")))
    asked = call(categories, prompt, _object(seeds=_SEEDS), "Give seed keywords for the funnel's category.", model=model, **options)
    return asked.withColumn("keywordSeeds", F.from_json("reply", "struct<seeds:array<string>>")["seeds"]).drop("reply", "usage", "error")


def generate_schema(instructions: str, retries: int = 5, **options: Any) -> dict[str, Any]:
    """A JSON schema of an object for what the instructions ask; property names and kinds come from the model."""
    fields = {"type": "array", "items": _object(name={"type": "string", "minLength": 1}, type={"type": "string", "enum": ["string", "number", "integer", "boolean", "strings"]}, description=_TEXT), "minItems": 1}
    got = _one("List the fields of the answer that the instructions call for.", instructions, _object(fields=fields), retries=retries, **options)["fields"]
    kind = lambda f: _strings() if f["type"] == "strings" else {"type": f["type"], "description": f["description"]}
    return _object(**{"_".join(f["name"].lower().split()): kind(f) for f in got})


def spark_type(schema: Mapping[str, Any]) -> str:
    """The Spark type of values under a JSON schema; objects with open properties are maps of strings."""
    kind = schema.get("type", "string")
    if kind == "object":
        props = schema.get("properties")
        return "struct<" + ",".join(f"`{k}`:{spark_type(v)}" for k, v in props.items()) + ">" if props else "map<string,string>"
    if kind == "array":
        return f"array<{spark_type(schema.get('items', {}))}>"
    return {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(kind, "string")


def auto(df: DataFrame, instructions: str, schema: Mapping[str, Any] | str | None = None, columns: Sequence[str] | None = None, out: str = "result", **options: Any) -> DataFrame:
    """Any instructions over records: the schema is given, described in words, or derived once from the instructions."""
    from .presets import generic

    fixed = schema if isinstance(schema, Mapping) else generate_schema(schema or instructions)
    return generic(instructions, fixed, spark_type(fixed), **options).batch(df, columns, out)


def topic_queries(topic: str, n: int = 10, language: str = "", **options: Any) -> list[str]:
    schema = _object(queries=_strings(minItems=1, maxItems=n))
    return _one(f"Write {n} search queries about the topic. {language}", topic, schema, **options)["queries"]


def struct_of(schema: Mapping[str, Any]) -> StructType:
    return StructType.fromDDL(spark_type(schema)[len("struct<") : -1])
