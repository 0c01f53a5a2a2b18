"""Scored fields of any vocabulary onto the target declaration.

``mapped`` takes one row for each document with ``fields``, a map from names to
``struct(value, score)`` and ``names``, their order. Chains of aliases are
ordered coalesces; a list of comments says what the registrar should look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gender, is_iso_date, nationality, relation, split_name, title

THRESHOLD = 0.6

#: The aliases of each target, first hit first. Fixed values.
PERSONS = {
    "child": {"full": ("enfant_nom", "nom"), "family": ("enfant_nom_famille", "nom_famille"), "given": ("enfant_prenoms", "enfant_prenom", "prenoms", "prenom")},
    "father": {"full": ("pere_nom", "pere_nom_complet"), "family": ("pere_nom_famille",), "given": ("pere_prenoms", "pere_prenom")},
    "mother": {"full": ("mere_nom", "mere_nom_complet", "mere_nom_jeune_fille"), "family": ("mere_nom_famille",), "given": ("mere_prenoms", "mere_prenom")},
}
PARENTS = {"father": "pere", "mother": "mere"}
DECLARANT = ("declarant_qualite", "declarant_lien", "declarant")
HANDLED = (
    *(n for p in PERSONS.values() for names in p.values() for n in names), *DECLARANT, "date_naissance", "sexe", "lieu_naissance", "heure_naissance",
    *(f"{p}_{x}" for p in PARENTS.values() for x in ("date_naissance", "nationalite", "profession", "lieu_naissance", "domicile")),
)


def _value(name: str | Column) -> Column:
    own = F.try_element_at("fields", F.lit(name) if isinstance(name, str) else name)["value"]
    return F.when(own != "", F.trim(own))


def _score(name: str | Column) -> Column:
    own = F.try_element_at("fields", F.lit(name) if isinstance(name, str) else name)["score"]
    return F.coalesce(own, F.lit(0.0))


def _comment(name: Column, text: str, value: Column, score: Column) -> Column:
    return F.format_string(f"{text} (%.2f): %s", name, score, value)


def _flag(name: str, asked: Column, threshold: float) -> Column:
    """A comment on a value that is taken though its score is low."""
    return F.when(asked & _value(name).isNotNull() & (_score(name) < threshold), _comment(F.lit(name), "check %s", _value(name), _score(name)))


def _only(name: str | Column, asked: Column | None = None) -> Column:
    """A comment that carries a value which has no place in the declaration."""
    own = F.lit(name) if isinstance(name, str) else name
    return F.when((F.lit(True) if asked is None else asked) & _value(name).isNotNull(), _comment(own, "%s", _value(name), _score(name)))


def _first(names: tuple[str, ...], asked: Column, threshold: float) -> tuple[Column, list[Column]]:
    """The first alias with a text, and flags of all aliases that were looked at until then."""
    value, flags, open_ = F.lit(None).cast("string"), [], asked
    for n in names:
        flags.append(_flag(n, open_, threshold))
        hit = F.nullif(_value(n), F.lit(""))
        value = F.coalesce(value, F.when(open_, hit))
        open_ = open_ & hit.isNull()
    return value, flags


def _person(names: dict, threshold: float) -> tuple[Column, list[Column]]:
    """Given and family name where both are there, else the split of the one there is. A full name is only looked at
    where there is no family name."""
    yes = F.lit(True)
    given, f1 = _first(names["given"], yes, threshold)
    family, f2 = _first(names["family"], yes, threshold)
    full, f3 = _first(names["full"], family.isNull(), threshold)
    family = F.coalesce(family, full)
    lone = F.coalesce(family, given)
    both = F.struct(given.alias("firstname"), family.alias("surname"))
    return F.when(given.isNotNull() & family.isNotNull(), both).when(lone.isNotNull(), split_name(lone)), f1 + f2 + f3


def mapped(reports: DataFrame, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """``doc_id``, the declaration's columns ``child, father, mother, informant`` and ``comments`` in order.

    A value that fails a format (a date that isn't ISO, an unknown sex) is left out of both, as the system described
    does; ``strict`` puts it into the comments.
    """
    yes, comments, out = F.lit(True), [], {}
    for who in ("child", "father", "mother"):
        name, flags = _person(PERSONS[who], threshold)
        comments += flags
        p = PARENTS.get(who)
        dob_name = f"{p}_date_naissance" if p else "date_naissance"
        dob = _value(dob_name)
        comments.append(_flag(dob_name, yes, threshold))
        if strict:
            comments.append(_only(dob_name, ~is_iso_date(dob)))
        own = [name.alias("name"), F.when(is_iso_date(dob), dob).alias("dob")]
        if p is None:
            sex = gender(_value("sexe"))
            comments.append(_flag("sexe", yes, threshold))
            if strict:
                comments.append(_only("sexe", sex.isNull()))
            own.append(sex.alias("gender"))
            comments += [_only("lieu_naissance"), _only("heure_naissance")]
        else:
            country = nationality(_value(f"{p}_nationalite"))
            comments.append(_flag(f"{p}_nationalite", yes, threshold))
            comments.append(F.when(_value(f"{p}_nationalite").isNotNull() & country.isNull(), F.format_string("%s (not mapped): %s", F.lit(f"{p}_nationalite"), _value(f"{p}_nationalite"))))
            comments.append(_flag(f"{p}_profession", yes, threshold))
            own += [country.alias("nationality"), F.nullif(_value(f"{p}_profession"), F.lit("")).alias("occupation")]
            comments += [_only(f"{p}_lieu_naissance"), _only(f"{p}_domicile")]
        out[who] = F.struct(*own)
    # the declarant: its relation is read without a flag, and the first that says one is not repeated as a comment
    related = F.lit(None).cast("string")
    for n in DECLARANT:
        own = relation(_value(n))
        comments.append(_only(n, F.nullif(_value(n), F.lit("")).isNotNull() & ~(related.isNull() & own.isNotNull())))
        related = F.coalesce(related, own)
    out["informant"] = F.struct(related.alias("relation"))
    rest = F.transform(F.filter("names", lambda n: ~n.isin(*HANDLED)), lambda n: _only(n))
    every = F.filter(F.concat(F.array(*comments), rest), lambda c: c.isNotNull())
    return reports.select("doc_id", *(c.alias(k) for k, c in out.items()), every.alias("comments"))


def prefilled(declaration: DataFrame) -> Column:
    """How many of the declaration's targets have a value."""
    parts = [F.col(f"{who}.{f.name}") for who in ("child", "father", "mother", "informant") for f in declaration.schema[who].dataType.fields]
    total = F.lit(0)
    for p in parts:
        total = total + F.when(p.isNotNull(), 1).otherwise(0)
    return total


def with_places(declared: DataFrame, resolutions: DataFrame, countries: DataFrame, least: float = 0.7) -> DataFrame:
    """``declared`` (with ``place``, ``country``) and ``birth_place``: the resolved name, titled, with the country's
    ISO code, where the resolver is sure enough. Each place of a country is looked up once; unknown countries give null."""
    sure = resolutions.where(F.col("confidence") >= least).groupBy("place", "country").agg(F.max_by("name", "confidence").alias("name"))
    out = declared.join(sure, ["place", "country"], "left").join(countries.select("country", "iso3"), "country", "left")
    return out.withColumn("birth_place", F.when(F.col("name").isNotNull(), F.struct(title(F.col("name")).alias("name"), F.col("iso3")))).drop("name", "iso3")


def fields_map(scored: DataFrame) -> DataFrame:
    """Long scored rows to one row for each document, as ``mapped`` takes them. A document's fields are few: its schema's."""
    every = F.array_sort(F.collect_list(F.struct("ord", "field", "value", "score")))
    out = scored.groupBy("doc_id").agg(every.alias("e"))
    pairs = F.transform("e", lambda x: F.struct(x["field"].alias("key"), F.struct(x["value"].alias("value"), x["score"].alias("score")).alias("value")))
    return out.select("doc_id", F.map_from_entries(pairs).alias("fields"), F.transform("e", lambda x: x["field"]).alias("names"))
