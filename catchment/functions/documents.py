"""JSON documents: paths, edits, containment, trees. Compression and hashes of values.

Null documents and arguments give null, and so do malformed ones: text that is no JSON, an edit of what is no
object, bytes that are no compressed UTF-8. A tree of such a document has no rows.
"""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_key(document: Column, key: str, value: Column) -> Column:
    """A flat JSON object with one key set (to a JSON text)."""
    old = F.map_filter(F.from_json(document, "map<string,string>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(old, F.create_map(F.lit(key), value.cast("string"))))


def remove_key(document: Column, key: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(document, "map<string,string>"), lambda k, _: k != key))


#: Stands for text that is no JSON (a singleton also where a task unpickles it).
_BROKEN = ...


def _loaded(text: str | None):
    try:
        return _BROKEN if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return _BROKEN


def _of_both(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """``f`` of two documents, null where either is null or malformed."""
    pairs = ((_loaded(x), _loaded(y)) for x, y in zip(a, b))
    return pd.Series([None if x is _BROKEN or y is _BROKEN else f(x, y) for x, y in pairs], dtype=object)


def _patched(old, new):
    if not isinstance(new, dict):
        return new
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


def _holds(whole, part) -> bool:
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and _holds(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(_holds(w, p) for w in whole) for p in part)
    if isinstance(whole, dict):
        return part in whole
    if isinstance(whole, list):
        return part in whole
    return whole == part


def patch(document: Column, change: Column) -> Column:
    """Merge patch: objects are merged key by key, null removes, anything else replaces; null where either is null or malformed."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _of_both(lambda x, y: json.dumps(_patched(x, y), separators=(",", ":")), a, b)

    return run(document, change)


def holds(document: Column, part: Column) -> Column:
    """Deep containment: every key and element of the part is in the document; null where either is null or malformed."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _of_both(_holds, a, b)

    return run(document, part)


def tree(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, kind, atom for every node of the documents; null and malformed documents have none.

    Keys that are no plain words are quoted in paths; atoms are written as in JSON, texts without quotes.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for k, text in zip(frame[key], frame[document]):
                whole = _loaded(text)
                todo = [] if whole is _BROKEN else [("$", whole)]
                while todo:
                    path, node = todo.pop()
                    kind = {dict: "object", list: "array", str: "text", bool: "boolean", int: "integer", float: "real"}.get(type(node), "null")
                    rows.append((k, path, kind, None if isinstance(node, (dict, list)) or node is None else node if isinstance(node, str) else json.dumps(node)))
                    if isinstance(node, dict):
                        todo += [(f"{path}.{n}" if n.isidentifier() else f"{path}.{json.dumps(n)}", v) for n, v in node.items()]
                    elif isinstance(node, list):
                        todo += [(f"{path}[{n}]", v) for n, v in enumerate(node)]
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "atom"])

    kind = dict(df.dtypes)[key]
    return df.select(key, document).mapInPandas(run, f"{key} {kind}, path string, kind string, atom string")


def at_path(document: Column, *path: str | int) -> Column:
    """The value at a path of keys and places, as JSON text; null where the path leads nowhere."""
    return F.to_json(F.try_variant_get(F.try_parse_json(document), _path(path), "variant"))


def text_at(document: Column, *path: str | int) -> Column:
    """The value at a path as plain text."""
    return F.try_variant_get(F.try_parse_json(document), _path(path), "string")


def _path(path: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + p.replace("'", "\\'") + "']" for p in path)


def has_keys(document: Column, keys: list[str], every: bool = True) -> Column:
    """Whether the object has all of ``keys`` at its top, or any; a document that is no object has none."""
    own = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    test = F.size(F.array_intersect(own, F.array(*map(F.lit, keys)))) == len(set(keys)) if every else F.arrays_overlap(own, F.array(*map(F.lit, keys)))
    return F.when(document.isNotNull(), test)


def without_path(document: Column, *path: str) -> Column:
    """The document without the key at a path of keys, by a merge patch."""
    change: dict | None = None
    for key in reversed(path):
        change = {key: change}
    return patch(document, F.lit(json.dumps(change)))


def same_document(a: Column, b: Column) -> Column:
    """Whether two JSON texts are the same document, whatever their white space and order of keys."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


def pack(text: Column) -> Column:
    """zlib-compressed UTF-8."""
    return _packer()(text)


def unpack(data: Column) -> Column:
    return _unpacker()(data)


def _packer():
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else zlib.compress(v.encode()) for v in values])

    return run


def _unpacker():
    def text(data: bytes | None) -> str | None:
        try:
            return None if data is None else zlib.decompress(data).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([text(v) for v in values], dtype=object)

    return run


def register(spark) -> list[str]:
    """Registers the scalar, aggregate and table functions for SQL; returns their names."""

    @F.pandas_udf("double")
    def product(values: pd.Series) -> float:
        return float(values.prod())

    @F.udtf(returnType="k int, v int")
    class Countdown:
        def eval(self, n: int):
            for k in range(n, 0, -1):
                yield k, k * k

    spark.udf.register("zpack", _packer())
    spark.udf.register("zunpack", _unpacker())
    spark.udf.register("product", product)
    spark.udtf.register("countdown", Countdown)
    return ["zpack", "zunpack", "product", "countdown"]
