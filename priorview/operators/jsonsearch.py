"""Find every path in a JSON document whose key contains a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _search(needle: str):
    """The step over batches. Everything it needs is inside, so that it runs on executors that
    do not have this package."""
    import json
    import re

    # One token: a bracket, a comma, a colon, a string, or a number or word.
    token = re.compile(r"""[ \t\n\r]*+(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")"""
                       r"""|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null))""")
    space = re.compile(r"[ \t\n\r]*+")

    def hits(text: str):
        """(path, value text) pairs, or ValueError. The open containers are a list, so depth is
        bounded by memory alone; a value is cut out of the text, not written anew."""
        found, pos = [], 0
        path: list[str] = ["$"]          # parts of the path to the next value
        stack: list[list] = []           # [closing bracket, next index, place in found or None, start]
        pending = None                   # place in found of the value that comes next
        state = "value"
        while state != "end":
            m = token.match(text, pos)
            if not m:
                raise ValueError("no JSON")
            mark, string, plain = m.groups()
            start, pos = m.start(m.lastindex), m.end()
            if state == "key" or state == "first" and stack[-1][0] == "}" and mark != "}":
                if string is None:
                    raise ValueError("a key is missing")
                colon = token.match(text, pos)
                if not colon or colon[1] != ":":
                    raise ValueError("a colon is missing")
                pos, key = colon.end(), json.loads(string)
                path.append(f".{key}")
                if needle in key.lower():
                    pending = len(found)
                    found.append(["".join(path), None])
                state = "value"
                continue
            if state == "first" and mark not in ("]", "}") or state == "item":
                path.append(f"[{stack[-1][1]}]")
                stack[-1][1] += 1
                state = "value"
            if state == "value" and mark in ("[", "{"):
                stack.append(["]" if mark == "[" else "}", 0, pending, start])
                pending, state = None, "first"
                continue
            if state == "value" and mark is None:
                if pending is not None:
                    found[pending][1] = text[start:pos]
                    pending = None
            elif state in ("first", "after") and stack and mark == stack[-1][0]:
                _, _, place, begun = stack.pop()
                if place is not None:
                    found[place][1] = text[begun:pos]
            elif state == "after" and mark == ",":
                state = "key" if stack[-1][0] == "}" else "item"
                continue
            else:
                raise ValueError("no JSON")
            # A value has ended.
            if stack:
                path.pop()
                state = "after"
            else:
                state = "end"
        if space.match(text, pos).end() != len(text):
            raise ValueError("text after the document")
        return found

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    mine = [(p, v, None) for p, v in hits(text)] if text is not None else []
                except ValueError as fault:
                    mine = [(None, None, str(fault))]
                rows += [k] * len(mine)
                out += mine
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())),
                                              *(pa.array(c, pa.string()) for c in cols)], ["doc", "path", "value", "error"])

    return run


def search_keys(docs: DataFrame, key: str, json_col: str, text: str) -> DataFrame:
    """(key, path, value, error): a row for each hit, and one with ``error`` for each document
    that is no JSON.

    A hit's value is its piece of the document. Nesting is unbounded, which built-in expressions
    can not follow, so batches of documents go through Arrow and a tokenizer without recursion;
    a deep or broken document never stops the others. Documents that can not hold a hit are
    not looked at. A null document holds nothing.
    """
    needle = text.lower()
    kind = docs.schema[key].dataType.simpleString()
    # An escaped key may hide the text, so documents with escapes are always read.
    body = F.col(json_col)
    may_hit = F.contains(F.lower(body), F.lit(needle)) | F.contains(body, F.lit("\\"))
    found = docs.where(may_hit).select(F.col(key).alias("doc"), body.alias("body")).mapInArrow(
        _search(needle), f"doc {kind}, path string, value string, error string")
    return found.withColumnRenamed("doc", key)


def find_keys(docs: DataFrame, key: str, json_col: str, text: str) -> DataFrame:
    """(key, path, value) of the hits alone."""
    return search_keys(docs, key, json_col, text).where("error is null").drop("error")
