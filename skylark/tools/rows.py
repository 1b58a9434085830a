"""Row tools: a prompt column, a call for each row in bounded parallelism, schema-checked results."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .backend import BACKENDS, Reply, provider_of

MODEL = "stub-1"
USAGE = "struct<inputTokens:bigint,outputTokens:bigint,totalTokens:bigint>"


def fill(template: str, **values: Column | str) -> Column:
    """A template with {name} places filled in one pass, so values may hold anything."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else (values[p] if isinstance(values[p], Column) else F.lit(values[p])) for i, p in enumerate(parts)]
    return F.concat(*cols)


def schema_errors(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """What is wrong with a value under the subset of JSON schema that the tools use."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}
    kind = schema.get("type")
    if kind in kinds and (not isinstance(value, kinds[kind]) or (kind in ("integer", "number") and isinstance(value, bool))):
        return [f"{at}: {kind} expected"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: {value!r} is none of {schema['enum']}")
    if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
        errors.append(f"{at}: {value} is out of range")
    if kind == "string" and len(value.strip()) < schema.get("minLength", 0):
        errors.append(f"{at}: blank")
    if kind == "array":
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            errors.append(f"{at}: {len(value)} items")
        errors += [e for i, v in enumerate(value) for e in schema_errors(v, schema.get("items", {}), f"{at}[{i}]")]
    if kind == "object":
        errors += [f"{at}.{k}: missing" for k in schema.get("required", schema.get("properties", {})) if k not in value]
        errors += [e for k, s in schema.get("properties", {}).items() if k in value for e in schema_errors(value[k], s, f"{at}.{k}")]
    return errors


def ask(model: str, messages: list[dict[str, str]], schema: Mapping[str, Any] | None, params: Mapping[str, Any], retries: int, backend: Any = None) -> tuple[str | None, dict[str, int], str | None]:
    """(text, usage of all attempts, error): up to retries + 1 attempts, errors fed back as system messages."""
    backend = backend or BACKENDS[provider_of(model)]()
    total: dict[str, int] = {}
    error = None
    for _ in range(retries + 1):
        try:
            reply: Reply = backend.complete(model, messages, schema, params)
        except Exception as e:  # the service's own errors count as a failed attempt
            error = f"{type(e).__name__}: {e}"
            continue
        for k, v in reply.usage.items():
            total[k] = total.get(k, 0) + v
        if schema is None:
            return reply.text, total, None
        try:
            wrong = schema_errors(json.loads(reply.text), schema)
        except ValueError as e:
            wrong = [f"no JSON: {e}"]
        if not wrong:
            return reply.text, total, None
        error = "; ".join(wrong[:5])
        messages = [*messages, {"role": "system", "content": f"The last answer did not fit the schema ({error}). Answer again, with JSON that fits."}]
    return None, total, error


def call(df: DataFrame, prompt: Column, schema: Mapping[str, Any] | None, system: str | None = None, model: str = MODEL, params: Mapping[str, Any] | None = None,
         retries: int = 3, concurrency: int = 16, fail: bool = False, backend: Any = None) -> DataFrame:
    """df with reply (text), usage and error. Rows with a null prompt are not asked and have nulls.

    Rows keep their place; `concurrency` calls run at once in each task. fail raises on the first failed row.
    Results belong in a table before they are used twice, since a second evaluation asks again.
    """
    cols = [f for f in df.schema.fields if f.name not in ("reply", "usage", "error")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols] + ["reply string", f"usage {USAGE}", "error string"])
    options = dict(params or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None):
            if text is None:
                return None, None, None
            messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text}]
            got = ask(model, messages, schema, options, retries, backend)
            if fail and got[2]:
                raise RuntimeError(got[2])
            return got[0], {k: got[1].get(k, 0) for k in ("inputTokens", "outputTokens", "totalTokens")}, got[2]

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                done = list(pool.map(one, frame.pop("_prompt")))
                yield frame.assign(**{k: pd.Series([d[i] for d in done], index=frame.index, dtype=object) for i, k in enumerate(("reply", "usage", "error"))})

    return df.select(*[f.name for f in cols], prompt.alias("_prompt")).mapInPandas(run, out)


@dataclasses.dataclass(frozen=True)
class RowTool:
    """A tool that turns each row into a value: instructions, a template over columns, a schema and its Spark type."""

    system: str
    template: str
    schema: Mapping[str, Any] | None
    result: str
    field: str | None = None
    options: Mapping[str, Any] = dataclasses.field(default_factory=dict)

    def batch(self, df: DataFrame, columns: Sequence[str] | None = None, out: str = "result", **options: Any) -> DataFrame:
        """df with `out`, usage and error; empty rows are not asked. One column goes in as text, several as JSON."""
        names = list(columns or df.columns)
        record = F.col(names[0]).cast("string") if len(names) == 1 else F.to_json(F.struct(*names))
        filled = F.array(*[~is_blank(F.col(c).cast("string")) & ~F.col(c).cast("string").isin("{}", "[]") for c in names])
        prompt = F.when(F.exists(filled, lambda x: x), fill(self.template, record=record))
        asked = call(df, prompt, self.schema, self.system, **(dict(self.options) | options))
        return self.parse(asked, out)

    def parse(self, asked: DataFrame, out: str) -> DataFrame:
        if self.schema is None:
            return asked.withColumn(out, F.trim("reply")).drop("reply")
        kind = f"struct<{self.field}:{self.result}>" if self.field else self.result
        parsed = F.from_json("reply", kind)
        return asked.withColumn(out, parsed[self.field] if self.field else parsed).drop("reply")
