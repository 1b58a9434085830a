"""The row tools: classifiers, labelers, scorers, extractors, summaries, translations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import RowTool


def _object(**properties: Any) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def _strings(**kw: Any) -> dict[str, Any]:
    return {"type": "array", "items": {"type": "string"}, **kw}


_TEXT = {"type": "string"}
_RECORD = "Record:\n{record}"


def _listed(labels: Mapping[str, str]) -> str:
    return "\n".join(f"- {k}: {v}" for k, v in labels.items())


def classifier(labels: Mapping[str, str], instructions: str = "", **options: Any) -> RowTool:
    """One label of the given ones for each record."""
    system = f"Choose the one label that fits the record best. {instructions}\nLabels:\n{_listed(labels)}"
    return RowTool(system, _RECORD, _object(label={"type": "string", "enum": list(labels)}), "string", "label", options)


def labeler(labels: Mapping[str, str], instructions: str = "", **options: Any) -> RowTool:
    """Any number of the given labels for each record."""
    system = f"Choose every label that fits the record; none if none fits. {instructions}\nLabels:\n{_listed(labels)}"
    schema = _object(labels={"type": "array", "items": {"type": "string", "enum": list(labels)}})
    return RowTool(system, _RECORD, schema, "array<string>", "labels", options)


SPEECH_INTENTS = {
    "assertion": "says how things are",
    "question": "wants to know something",
    "directive": "wants somebody to act",
    "commissive": "binds the speaker to act",
    "expressive": "shows a feeling or attitude",
}
EMOTIONS = {
    "joy": "gladness or delight",
    "trust": "acceptance or confidence",
    "fear": "worry or alarm",
    "surprise": "the unexpected",
    "sadness": "loss or sorrow",
    "disgust": "aversion",
    "anger": "annoyance or rage",
    "anticipation": "expectation of what comes",
}
POLARITIES = {"positive": "favourable on the whole", "neutral": "neither or balanced", "negative": "unfavourable on the whole"}


def speech_intent(**options: Any) -> RowTool:
    return classifier(SPEECH_INTENTS, "The label is the speaker's main intent.", **options)


def plutchik_emotion(**options: Any) -> RowTool:
    return classifier(EMOTIONS, "The label is the strongest emotion of the text.", **options)


def sentiment_polarity(**options: Any) -> RowTool:
    return classifier(POLARITIES, "The label is the polarity of the whole text.", **options)


def scorer(name: str, description: str, low: float = 0, high: float = 10, whole: bool = True, **options: Any) -> RowTool:
    """A number in [low, high] for each record."""
    system = f"Score the record for {name} from {low} to {high}: {description}"
    kind = {"type": "integer" if whole else "number", "minimum": low, "maximum": high}
    return RowTool(system, _RECORD, _object(score=kind), "bigint" if whole else "double", "score", options)


def entity_extractor(definitions: str | Mapping[str, str], **options: Any) -> RowTool:
    """array<struct<name, type>> for each text."""
    listed = definitions if isinstance(definitions, str) else _listed(definitions)
    kind = {"type": "string"} if isinstance(definitions, str) else {"type": "string", "enum": list(definitions)}
    schema = _object(entities={"type": "array", "items": _object(name=_TEXT, type=kind)})
    return RowTool(f"List the named entities of the text with their types.\nTypes:\n{listed}", "Text:\n{record}", schema, "array<struct<name:string,type:string>>", "entities", options)


COMMON_ENTITIES = {
    "person": "people by name",
    "organization": "companies, institutions, teams",
    "brand": "names under which things are sold",
    "product": "goods and services by name",
    "place": "cities, countries, sites",
    "event": "happenings with a name",
    "date": "points or spans of time",
    "amount": "quantities and sums of money",
}


def common_entities(exclude: Sequence[str] = (), add: Mapping[str, str] | None = None, **options: Any) -> RowTool:
    return entity_extractor({k: v for k, v in COMMON_ENTITIES.items() if k not in exclude} | dict(add or {}), **options)


_ASPECT = _object(aspect=_TEXT, sentiment={"type": "string", "enum": list(POLARITIES)}, reason=_TEXT, quote={"type": "string", "minLength": 1}, context=_TEXT)
_ASPECTS = "array<struct<aspect:string,sentiment:string,reason:string,quote:string,context:string>>"


class SentimentExtractor(RowTool):
    """Aspects with sentiments; only those whose quote stands in the text word for word are kept."""

    def batch(self, df: DataFrame, columns: Sequence[str] | None = None, out: str = "result", **options: Any) -> DataFrame:
        (text,) = columns or df.columns
        got = super().batch(df, [text], out, **options)
        return got.withColumn(out, F.filter(out, lambda a: (F.trim(a["quote"]) != "") & F.contains(F.col(text), a["quote"])))


def sentiment_extractor(context: str = "", **options: Any) -> SentimentExtractor:
    system = f"Find the aspects that the text judges, each with its sentiment, the reason and a literal quote. {context}"
    return SentimentExtractor(system, "Text:\n{record}", _object(aspects={"type": "array", "items": _ASPECT}), _ASPECTS, "aspects", options)


def topic_assigner(taxonomy: Mapping[str, Sequence[str]], instructions: str = "", **options: Any) -> RowTool:
    """struct<topic, subtopic>, always a pair of the taxonomy."""
    pairs = [f"{t} / {s}" for t, subs in taxonomy.items() for s in subs]
    tool = RowTool(f"Choose the topic and subtopic of the text. {instructions}", "Text:\n{record}", _object(pair={"type": "string", "enum": pairs}), "string", "pair", options)
    return _Pairs(tool.system, tool.template, tool.schema, tool.result, tool.field, tool.options)


class _Pairs(RowTool):
    def parse(self, asked: DataFrame, out: str) -> DataFrame:
        parts = F.split(F.col(out), " / ", 2)
        return super().parse(asked, out).withColumn(out, F.when(F.col(out).isNotNull(), F.struct(parts[0].alias("topic"), parts[1].alias("subtopic"))))


def summarizer(words: int = 100, **options: Any) -> RowTool:
    return RowTool(f"Summarize the text in about {words} words, in its own language.", "Text:\n{record}", _object(summary={"type": "string", "minLength": 1}), "string", "summary", options)


def keyword_to_prompt(**options: Any) -> RowTool:
    """Raw text: the question that somebody who types the keyword would ask an assistant."""
    return RowTool("Turn the search keyword into the question that its searcher would ask an assistant. Answer with the question alone.", "Keyword: {record}", None, "string", None, options)


def prompt_to_keyword(words: int = 4, **options: Any) -> RowTool:
    return RowTool(f"Turn the question into a search keyword of at most {words} words. Answer with the keyword alone.", "Question: {record}", None, "string", None, options)


# Kinds of sites and of pages; their own short taxonomies.
WEB_TAXONOMY = {
    "media": ["news", "magazine", "blog"],
    "commerce": ["shop", "marketplace", "comparison"],
    "company": ["corporate site", "product site", "support"],
    "community": ["forum", "social network", "reviews"],
    "reference": ["encyclopedia", "documentation", "dictionary"],
    "education": ["school", "course", "research"],
    "government": ["agency", "law", "statistics"],
    "other": ["personal", "unknown"],
}
PAGE_TAXONOMY = {
    "home": ["home page"],
    "product": ["product page", "category page", "pricing"],
    "article": ["news article", "guide", "opinion"],
    "listing": ["ranking", "directory", "search results"],
    "help": ["faq", "documentation", "contact"],
    "company": ["about", "jobs", "legal"],
    "conversion": ["sign-up", "checkout", "lead form"],
    "other": ["error page", "unknown"],
}


def url_classifier(**options: Any) -> RowTool:
    return topic_assigner(WEB_TAXONOMY, "The text is a URL; judge the site.", **options)


def page_classifier(**options: Any) -> RowTool:
    return topic_assigner(PAGE_TAXONOMY, "The text describes a web page; judge the page.", **options)


_ELEMENT_TYPES = {
    "list": ["navigation", "features", "steps", "links", "ingredients", "ranking", "faq", "tags", "contact", "other"],
    "table": ["comparison", "specification", "pricing", "schedule", "statistics", "layout", "results", "contact", "other"],
    "form": ["search", "login", "sign-up", "contact", "newsletter", "checkout", "filter", "booking", "survey", "other"],
}


def element_classifier(kind: str, **options: Any) -> RowTool:
    """struct<type, confidence, reason> of lists, tables or forms; a failure raises."""
    schema = _object(type={"type": "string", "enum": _ELEMENT_TYPES[kind]}, confidence={"type": "number", "minimum": 0, "maximum": 1}, reason=_TEXT)
    return RowTool(f"Say what the {kind} on a web page is for.", f"The {kind} as JSON:\n{{record}}", schema, "struct<type:string,confidence:double,reason:string>", None, {"fail": True} | options)


def generic(instructions: str, schema: Mapping[str, Any], result: str, **options: Any) -> RowTool:
    """Any instructions with a JSON schema and its Spark type; a failed row fails the batch."""
    return RowTool(instructions, _RECORD, schema, result, None, {"fail": True} | options)
