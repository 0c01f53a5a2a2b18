"""Objects out of damaged JSON text, in stages, each tried only if those before gave none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_object(text: Column) -> Column:
    """A variant, if the text is a JSON object; arrays and scalars give null."""
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def escape_newlines(text: Column) -> Column:
    """Line ends inside quoted strings as \\n; elsewhere they stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, ch: Column) -> Column:
        quote = ~s["escaped"] & (ch == '"')
        quoted = F.when(quote, ~s["quoted"]).otherwise(s["quoted"])
        new = F.when(~s["escaped"] & quoted & (ch == "\n"), F.lit("\\n")).otherwise(ch)
        return F.struct(F.concat(s["out"], new).alias("out"), quoted.alias("quoted"), (~s["escaped"] & (ch == "\\")).alias("escaped"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def stages(text: Column) -> list[Column]:
    """The text as it stands after each repair."""
    t = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    t = F.regexp_replace(F.regexp_replace(t, "```(?:json)?", ""), "^[` \\n\\r\\t]+|[` \\n\\r\\t]+$", "")
    bare = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufeff]", "")
    inner = F.nullif(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1), F.lit(""))
    commas = F.regexp_replace(inner, ",\\s*([}\\]])", "$1")
    quotes = F.regexp_replace(F.regexp_replace(commas, "(?<=[{,\\s])\\s*'([^']+?)'\\s*:", " \"$1\":"), ":\\s*'([^']*?)'", ": \"$1\"")
    return [bare, inner, commas, quotes, F.when(F.contains(quotes, F.lit("\n")), escape_newlines(quotes))]


def extract_json(text: Column) -> Column:
    """The first stage's object, as a variant; null if none has one."""
    return F.coalesce(*(as_object(t) for t in stages(text)))


def coerce(v: Column) -> Column:
    """``struct(raw, value, confidence)`` of one reading, given as a variant: an object as it is, with its confidence
    0.5 if it has none and 0 if that is null; a bare scalar as a value of confidence 0.5; null as nothing, with 0."""
    kind = F.schema_of_variant(v)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    field = lambda name: F.try_variant_get(F.when(is_object, v), f"$.{name}", "string")
    has = F.coalesce(kind.rlike("[<, ]confidence:"), F.lit(False))
    sure = F.when(~has, 0.5).otherwise(F.coalesce(F.try_variant_get(F.when(is_object, v), "$.confidence", "double"), F.lit(0.0)))
    none = v.isNull() | (kind == "VOID")
    scalar = F.when(~none & ~is_object, F.try_variant_get(v, "$", "string"))
    return F.struct(
        F.coalesce(F.when(is_object, field("raw")), scalar, F.lit("")).alias("raw"),
        F.when(is_object, field("value")).otherwise(scalar).alias("value"),
        F.when(none, 0.0).when(is_object, sure).otherwise(0.5).alias("confidence"),
    )


def nest(flat: Column, groups: dict[str, list[str]]) -> Column:
    """A map with dotted keys as a struct of structs, for a known set of keys."""
    return F.struct(*(F.struct(*(F.try_element_at(flat, F.lit(f"{g}.{k}")).alias(k) for k in keys)).alias(g) for g, keys in groups.items()))
