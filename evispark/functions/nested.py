"""Nested JSON, walked in Arrow batches: no built-in function goes to any depth."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.text import EVIDENCE_ID


def _load(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _leaves(value, path: str):
    """(path, leaf) in document order, without recursion, so depth costs no stack."""
    todo = [(path, value)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{at}[{k}]", v) for k, v in reversed(list(enumerate(x)))]
        else:
            yield at, x


def string_leaves(column: Column, root: str) -> Column:
    """Every string of a JSON value with its path below `root`; none for no JSON."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(p, x) for p, x in _leaves(_load(t), root) if isinstance(x, str)])

    return walk(column)


def scalars(column: Column, prefix: str) -> Column:
    """Every finite number of a JSON object with its key path, `prefix/key/key`; true and false are 1 and 0, arrays and
    strings stay out."""

    def one(text: str | None) -> list[tuple[str, float]]:
        out, todo = [], [(prefix, _load(text))]
        while todo:
            at, x = todo.pop(0)
            if isinstance(x, dict):
                todo += [(f"{at}/{k}", v) for k, v in x.items()]
            elif isinstance(x, (bool, int, float)) and at != prefix and math.isfinite(x):
                out.append((at, float(x)))
        return sorted(out)

    @F.pandas_udf("array<struct<key:string,value:double>>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return walk(column)


def remap_json(column: Column, ids: Column) -> Column:
    """A JSON value with the evidence ids in all its strings and keys replaced by a map; ids that it lacks become
    `dropped:<id>`."""
    names = re.compile(EVIDENCE_ID)

    def change(value, known: dict):
        new = lambda s: names.sub(lambda m: known.get(m.group(), f"dropped:{m.group()}"), s)
        if isinstance(value, str):
            return new(value)
        if isinstance(value, list):
            return [change(x, known) for x in value]
        return {new(k): change(x, known) for k, x in value.items()} if isinstance(value, dict) else value

    @F.pandas_udf("string")
    def walk(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or (v := _load(t)) is None else json.dumps(change(v, dict(m) if m is not None else {}), ensure_ascii=False, separators=(",", ":")) for t, m in zip(texts, maps)], index=texts.index, dtype=object)

    return walk(column, ids)


def remap_text(text: Column, ids: Column) -> Column:
    """A text with its evidence ids replaced by a map; ids that it lacks become `dropped:<id>`."""
    found = F.regexp_extract_all(text, F.lit(EVIDENCE_ID), F.lit(0))
    new = F.transform(found, lambda i: F.coalesce(F.try_element_at(ids, i), F.concat(F.lit("dropped:"), i)))
    pieces = F.arrays_zip(F.split(text, EVIDENCE_ID, -1).alias("before"), new.alias("id"))
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], F.coalesce(p["id"], F.lit("")))), "")


def key_paths(column: Column, root: str) -> Column:
    """Every key of a JSON value with its path below `root`, in document order; keys below arrays count too."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            out, todo = [], [(root, _load(text))]
            while todo:
                at, x = todo.pop()
                if at != root and not at.endswith("]"):
                    out.append(at)
                if isinstance(x, dict):
                    todo += [(f"{at}.{k}", v) for k, v in reversed(x.items())]
                elif isinstance(x, list):
                    todo += [(f"{at}[{k}]", v) for k, v in reversed(list(enumerate(x)))]
            return out

        return texts.map(one)

    return walk(column)


def override(column: Column, path: str, value: Column) -> Column:
    """A JSON object with the value at a dotted path replaced by another JSON value. A path that isn't there leaves null,
    as a wrong name in an override must not pass unseen."""
    keys = path.split(".")

    @F.pandas_udf("string")
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text: str | None, new: str | None) -> str | None:
            whole = at = _load(text)
            for k in keys[:-1]:
                at = at.get(k) if isinstance(at, dict) else None
            if not isinstance(at, dict) or keys[-1] not in at:
                return None
            at[keys[-1]] = _load(new)
            return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(*x) for x in zip(texts, values)], index=texts.index, dtype=object)

    return put(column, value)
