"""The scalar functions and the tokeniser for SQL text: SQL functions, which the optimizer expands where they are called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import LOWER, STOPWORDS, UPPER

_V = "ARRAY<DOUBLE>"
_TOKENS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9\\\\x{{80}}-\\\\x{{10FFFF}}]+', 0)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: name, parameters, what is returned, and the body.
FUNCTIONS = [
    ("vec_dot", f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    ("vec_l2", f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"),
    ("vec_ip", f"a {_V}, b {_V}", "DOUBLE", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    ("vec_normalize", f"a {_V}", _V, "transform(a, x -> x / greatest(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)), 1e-12D))"),
    ("text_tokens", "text STRING", "ARRAY<STRING>", _TOKENS),
    ("text_terms", "text STRING", "ARRAY<STRING>", f"filter({_TOKENS}, t -> t NOT IN ({_STOP}))"),
    ("tokenize", "text STRING", "TABLE (position INT, token STRING)", f"SELECT * FROM posexplode({_TOKENS}) AS t(position, token)"),
]


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session: vec_dot, vec_l2 (squared), vec_ip, vec_normalize, text_tokens, text_terms (without stop words), and tokenize, a
    table function for LATERAL joins, with a row for each token. Null arguments give null, and no rows."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
