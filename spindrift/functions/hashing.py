"""Content hashes, derived ids and redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: keys whose values are not shown.
REDACTED_KEYS = r"(?i)(authorization|cookie|token|secret|password|client.?secret|code|state|verifier)"
REDACTED = "[REDACTED]"


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON; nulls leave no trace, like absent keys."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dedupe_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *parts)


def derived_id(kind: str, *parts: Column | str) -> Column:
    """An id that follows from the natural key, so that a repeated run gives the same one."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00")) for p in parts)), 256)


def redact_map(fields: Column) -> Column:
    """A flat string map with the values of sensitive keys replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(REDACTED_KEYS), F.lit(REDACTED)).otherwise(v))


# Tokens of JSON: white space, a string, a number, a word, a mark.
_TOKEN = re.compile(r'([\x20\t\n\r]+)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null|NaN|-?Infinity)|([\[\]{}:,])')


def redacted_json(text: str) -> str:
    """JSON with sensitive values replaced, rewritten token by token.

    The open brackets are a list, so any depth passes; numbers keep their spelling; a
    sensitive value is left out with all that it holds.  Of a repeated key all values stay.
    """
    out: list[str] = []
    open_: list[str] = []
    #: What may come: a value, a key, a colon, a comma or an end; `first` allows an end at once.
    want, first, hidden_at, hides = "value", False, None, False
    at = 0
    while at < len(text):
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError("not JSON")
        at = token.end()
        blank, string, number, word, mark = token.groups()
        if blank:
            continue
        shown = hidden_at is None
        if mark in ("]", "}"):
            if not open_ or open_[-1] != mark or not (want == "comma" or first):
                raise ValueError("not JSON")
            open_.pop()
            if shown:
                out.append(mark)
            if hidden_at == len(open_):
                hidden_at = None
            want, first = "comma", False
        elif mark == ",":
            if want != "comma" or not open_:
                raise ValueError("not JSON")
            if shown:
                out.append(",")
            want, first = "key" if open_[-1] == "}" else "value", False
        elif mark == ":":
            if want != "colon":
                raise ValueError("not JSON")
            if shown:
                out.append(":")
            want = "value"
        elif want == "key":
            if not string:
                raise ValueError("not JSON")
            name = json.loads(string)
            if shown:
                out.append(json.dumps(name, ensure_ascii=False))
                hides = re.search(REDACTED_KEYS, name) is not None
            want, first = "colon", False
        elif want == "value":
            if shown and hides:
                out.append(json.dumps(REDACTED))
            if mark:
                if shown and hides:
                    hidden_at = len(open_)
                elif shown:
                    out.append(mark)
                open_.append("]" if mark == "[" else "}")
                want, first = ("value", True) if mark == "[" else ("key", True)
            else:
                if shown and not hides:
                    out.append(json.dumps(json.loads(string), ensure_ascii=False) if string else number or word)
                want, first = "comma", False
            hides = False
        else:
            raise ValueError("not JSON")
    if open_ or want != "comma":
        raise ValueError("not JSON")
    return "".join(out)


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """JSON of any depth with the values of sensitive keys replaced; a text that is no JSON
    is replaced whole."""

    def one(text: str) -> str:
        try:
            return redacted_json(text)
        except ValueError:
            return json.dumps(REDACTED)

    return texts.map(one, na_action="ignore")
