"""Values from outside in the form that the tables want."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def retry_after(header: Column, now: Column, most: float = 60.0) -> Column:
    """Seconds to wait by a header that has seconds or an HTTP date, between 0 and ``most``; null where it has neither."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), "^[A-Za-z]+, *| *GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(most)))


def string_or_list(json: Column) -> Column:
    """The strings of a JSON value that is one string or a list of them; null for anything else."""
    plain = F.trim(json)
    one = F.from_json(F.concat(F.lit('{"v":'), plain, F.lit("}")), "v string")["v"]
    return F.when(F.startswith(plain, F.lit("[")), F.from_json(plain, "array<string>")).when(F.startswith(plain, F.lit('"')), F.array(one))


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def _document(text: str) -> str | None:
    """The JSON document in a text, as it stands there."""
    text = text.strip()
    _, opened, rest = text.partition("```")
    fenced = rest.partition("```")[0].removeprefix("json").strip() if opened and "```" in rest else ""
    for whole in (text, fenced):
        try:
            if whole and _DECODER.raw_decode(whole)[1] == len(whole):
                return whole
        except (ValueError, RecursionError):
            pass
    first = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    try:
        return text[first : _DECODER.raw_decode(text, first)[1]] if first >= 0 else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def json_from_prose(x: pd.Series) -> pd.Series:
    """The JSON document of a text: the whole, else the first fenced block, else what begins at the first bracket.

    Null where there is none.  A pandas function, since no built-in one finds the end of a document within a text.
    """
    return x.map(lambda v: None if v is None else _document(v)).astype(object)


def with_defaults(text: Column, ddl: str) -> Column:
    """A JSON object as a struct of ``ddl`` where absent or unfit lists are empty and flags false."""
    schema = T.StructType.fromDDL(ddl)
    value = F.from_json(text, schema)
    empty = {T.ArrayType: lambda t: F.array().cast(t), T.BooleanType: lambda t: F.lit(False)}

    def field(f: T.StructField) -> Column:
        fill = empty.get(type(f.dataType))
        return (F.coalesce(value[f.name], fill(f.dataType)) if fill else value[f.name]).alias(f.name)

    return F.struct(*[field(f) for f in schema.fields])
