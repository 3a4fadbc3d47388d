"""The functions by name, for ``spark.sql``: SQL functions, which Catalyst inlines into the plan, one vectorised function, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from kinweave.functions.similarity import similarities
from kinweave.functions.text import FREEMAIL, HONORIFICS, MACHINE_DOMAIN, ORG_SUFFIXES, ROBOT, ROLE, SERVICE_NAME
from kinweave.operators.extract import CHUNK, MOST_BODY, SHARED


def _q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: list[str]) -> str:
    return ", ".join(map(_q, words))


def _swapped(start: str, *pairs: tuple[str, str]) -> str:
    """``start`` with patterns replaced, one after the other."""
    for pattern, by in pairs:
        start = f"regexp_replace({start}, {_q(pattern)}, {_q(by)})"
    return start


_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def _page() -> str:
    text = _swapped("html", (r"(?is)<(script|style).*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|h[1-6]|tr)>", "\n"), ("<[^>]+>", " "))
    for name, letter in _ENTITIES:
        text = f"replace({text}, {_q(name)}, {_q(letter)})"
    return f"nullif({_swapped(text, ('[ \t]+', ' '), ('\n{3,}', '\n\n'), (r'^\s+|\s+$', ''))}, '')"


def definitions() -> dict[str, tuple[str, str, str]]:
    """(parameters, type, body) of each SQL function; the same rules as the columns in ``functions.text``, which tests hold them against."""
    letters = _swapped("lower(name)", ("[\"'’]", ""), (r"[^a-z\s.-]", " "))
    words = f"filter(split({letters}, {_q(r'[\s.]+')}), t -> t <> '' AND t NOT IN ({_list(HONORIFICS)}))"
    org = f"trim({_swapped('lower(name)', (r'[^a-z0-9\s]', ' '), (rf'\b({ORG_SUFFIXES})\b\.?', ''), (r'\s+', ' '))})"
    first, last = "split(name, ' ')[0]", "element_at(split(name, ' '), -1)"
    prefix = "'n:' || kind || ':'"
    other = f"CASE WHEN name IS NULL THEN NULL WHEN size(split(name, ' ')) = 1 THEN {prefix} || {first} ELSE {prefix} || substring({last}, 1, 1) || {first} END"
    domain = "get(split(email, '@'), 1)"
    return {
        "norm_email": ("email STRING", "STRING", f"CASE WHEN contains(email, '@') THEN split(split(lower(trim(email)), '@')[0], {_q(r'\+')})[0] || '@' || split(lower(trim(email)), '@')[1] END"),
        "norm_person": ("name STRING", "STRING", f"nullif(array_join({words}, ' '), '')"),
        "norm_org": ("name STRING", "STRING", f"nullif({org}, '')"),
        "block_keys": ("name STRING, email STRING, kind STRING", "ARRAY<STRING>", f"array_compact(array('e:' || email, 'd:' || {domain}, {prefix} || substring({first}, 1, 1) || {last}, {other}))"),
        "strip_html": ("html STRING", "STRING", _page()),
        "is_freemail": ("email STRING", "BOOLEAN", f"{domain} IN ({_list(FREEMAIL)})"),
        "classify_address": (
            "email STRING, name STRING", "STRING",
            f"CASE WHEN email RLIKE {_q('(?i)' + ROBOT)} OR {domain} RLIKE {_q('(?i)' + MACHINE_DOMAIN)} THEN 'automated' WHEN email RLIKE {_q('(?i)' + ROLE)} THEN 'role' "
            f"WHEN name RLIKE {_q('(?i)' + SERVICE_NAME)} THEN 'automated' ELSE 'human' END",
        ),
    }


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(similarities(a.to_pylist(), b.to_pylist(), [False] * len(a)))


class TextChunks:
    """(chunk, at, text): windows of a body that share some characters, cut at a line end where one lies in their second half. Nothing for null."""

    def eval(self, body: str, most: int = MOST_BODY, width: int = CHUNK, shared: int = SHARED) -> Iterator[tuple]:
        if body is None:
            return
        if not 0 <= shared < width // 2:
            raise ValueError("windows must share less than half of their width")
        text, start, chunk = body[:most], 0, 0
        while True:
            end = start + width
            if end < len(text):
                cut = text.rfind("\n", start, end + 1)
                end = cut if cut > start + width // 2 else end
            yield chunk, start, text[start:end]
            if end >= len(text):
                return
            start, chunk = end - shared, chunk + 1


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session for as long as it lives; their names."""
    made = definitions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("name_similarity", arrow_udf(_similarity, "double"))
    spark.udtf.register("text_chunks", udtf(TextChunks, returnType="chunk int, at int, text string"))
    return [*made, "name_similarity", "text_chunks"]
