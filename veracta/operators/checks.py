"""Validation rules over a record: each a projection that gives findings, all of them in one pass.

A record is one row for each document with ``fields``, a map from a field's name
to ``struct(value, raw)``, and the country pack's ``checks`` (a struct) and
``places`` (an array). No rule joins; only the fuzzy comparisons leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dates_in_text, id_birthdate, number_tokens, read_dates, tokens_to_int
from ..functions.fuzzy import similarity
from ..functions.text import empty, fold

#: Field names that the rules read. Fixed values.
DATES = ("date_enregistrement", "date_naissance", "date_declaration", "date_etablissement", "date_acte", "date_delivrance", "pere_date_naissance", "mere_date_naissance")
ALL_DATES = (*DATES, "date_marge")
REGISTERED = ("date_enregistrement", "date_declaration", "date_etablissement", "date_acte")
REFERENCES = ("annee", "annee_registre", "reference", "acte_numero", "registre", "numero_acte")
NUMBERS = ("nid_numero", "numero_identite", "enfant_nid")
PLACES = ("lieu_naissance", "pere_lieu_naissance", "pere_domicile", "mere_lieu_naissance", "mere_domicile", "gouvernorat", "delegation", "commune", "lieu_delivrance")
NAMES = ("enfant_nom", "nom", "enfant_prenom", "enfant_prenoms", "nom_famille")

CHECKS = "struct<cnin_date:boolean,reference_year:boolean,annee_matches_declaration:boolean,margin_date_matches_birth:boolean,acte_number_words:boolean,id_birthdate_format:string,equal_pairs:array<array<string>>,number_word_pairs:array<array<string>>>"
PLACE_SCORE, PAIR_SCORE, LATE_DAYS, PARENT_AGE = 0.88, 90, 365 * 5, 12


def _get(name: str | Column) -> tuple[Column, Column]:
    """Value (null if absent or empty) and raw text of a field."""
    own = F.try_element_at("fields", F.lit(name) if isinstance(name, str) else name)
    return F.nullif(own["value"], F.lit("")), F.coalesce(own["raw"], F.lit(""))


def finding(field: str | Column, level: str | Column, message: str | Column) -> Column:
    one = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(one(field).alias("field"), one(level).alias("level"), one(message).alias("message"))


def with_dates(records: DataFrame) -> DataFrame:
    """``records`` with ``d`` (for each date field what its value and its raw text say), each field's date, and the ids' dates.

    Each is a column of its own, so that the rules' expressions name it and don't repeat it.
    """
    texts = [t for n in ALL_DATES for t in _get(n)]
    out = records.withColumn("d", read_dates(F.array(*texts))).withColumns({f"d_{n}": _parsed(n) for n in ALL_DATES})
    out = out.withColumn("d_registered", F.coalesce(*(F.col(f"d_{n}") for n in REGISTERED)))
    return out.withColumns({f"id_{n}": id_birthdate(F.coalesce(*_get(n)), F.col("checks.id_birthdate_format"), F.col("d_date_naissance")) for n in NUMBERS})


def _parsed(name: str) -> Column:
    """A field's date: of its value, else of its raw text."""
    k = 2 * ALL_DATES.index(name)
    return F.coalesce(F.col("d")[k]["date"], F.col("d")[k + 1]["date"])


def best_places(records: DataFrame, fallback: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``doc_id, field, value, place, place_score`` of each place field: its nearest name in the record's ``places``.

    A pack without places takes those of another one, ``fallback``, as the system described does; ``strict`` leaves it
    without.

    Each distinct pair of a spelling and a pack is compared once: the distinct step comes before the Arrow function.
    """
    if fallback and not strict:
        records = records.withColumn("places", F.when(F.coalesce(F.size("places"), F.lit(0)) > 0, F.col("places")).otherwise(F.array(*(F.lit(p) for p in fallback))))
    named = records.select("doc_id", "places", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), _get(n)[0].alias("value")) for n in PLACES))).alias("f")).where("f.value is not null")
    named = named.select("doc_id", F.col("f.field").alias("field"), F.col("f.value").alias("value"), "places", F.xxhash64("places").alias("pack"))
    packs = named.groupBy("pack").agg(F.first("places").alias("places"))
    spelled = named.select("pack", "value").distinct().join(packs, "pack")
    pairs = spelled.select("pack", "value", F.posexplode_outer("places").alias("ord", "place"))
    scored = pairs.withColumn("s", similarity(fold(F.col("value")), fold(F.col("place")), "weighted_ratio") / 100)
    # the later of two names that fold alike, in the place of the earlier, as a table keyed by the folded name holds them
    best = scored.groupBy("pack", "value").agg(F.max(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), (-F.col("ord")).alias("o"), "place")).alias("b"))
    best = best.select("pack", "value", F.col("b.place").alias("place"), F.col("b.s").alias("place_score"))
    return named.join(best, ["pack", "value"]).select("doc_id", "field", "value", F.when(F.col("place_score") >= PLACE_SCORE, F.col("place")).alias("place"), "place_score")


def findings(records: DataFrame, fallback: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``doc_id, ord, field, level, message``: every finding, in the order of the rules; ``fallback`` and ``strict`` as for ``best_places``."""
    d = lambda n: F.col(f"d_{n}")
    found: list[Column] = []
    add = lambda *cases: found.append(F.array(*cases))
    sex, _ = _get("sexe")
    add(F.when(sex.isNotNull(), F.when(fold(sex).isin("masculin", "feminin"), finding("sexe", "ok", "valid sex")).otherwise(finding("sexe", "fail", "not a value of the register"))))
    for n in DATES:
        value, _ = _get(n)
        raw = F.col("d")[2 * ALL_DATES.index(n) + 1]
        add(
            F.when(value.isNotNull() & d(n).isNull(), finding(n, "warn", "date can't be read")),
            F.when(d(n).isNotNull() & raw["words"].isNotNull() & raw["digits"].isNotNull(), F.when(raw["words"] == raw["digits"], finding(n, "ok", "words and digits agree")).otherwise(finding(n, "warn", "words and digits differ"))),
        )
    birth, registered = d("date_naissance"), d("registered")
    where = F.coalesce(*(F.when(d(n).isNotNull(), F.lit(n)) for n in REGISTERED), F.lit(REGISTERED[0]))
    both = birth.isNotNull() & registered.isNotNull()
    late = F.datediff(registered, birth)
    add(F.when(both, F.when(birth > registered, finding("date_naissance", "fail", "born after the registration")).when(late > LATE_DAYS, finding(where, "warn", "registered long after the birth")).otherwise(finding("date_naissance", "ok", "birth and registration in order"))))
    for parent in ("pere", "mere"):
        own = d(f"{parent}_date_naissance")
        add(F.when(own.isNotNull() & birth.isNotNull() & (F.datediff(birth, own) / 365.25 < PARENT_AGE), finding(f"{parent}_date_naissance", "warn", "parent too young")))
    for parent in ("pere", "mere"):
        # the card's text is read as its raw form alone, twice over
        _, raw = _get(f"{parent}_cnin")
        inside, own = dates_in_text(F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif(raw, F.lit("")))), d(f"{parent}_date_naissance")
        asked = F.coalesce(F.col("checks.cnin_date"), F.lit(True)) & (F.size(inside) > 0) & own.isNotNull()
        add(F.when(asked, F.when(F.array_contains(inside, own), finding(f"{parent}_cnin", "ok", "card's date is the birth date")).otherwise(finding(f"{parent}_cnin", "warn", "card's date differs"))))
    for n in REFERENCES:
        value, raw = _get(n)
        year = F.regexp_extract(F.concat_ws(" ", value, F.nullif(raw, F.lit(""))), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
        add(F.when(F.coalesce(F.col("checks.reference_year"), F.lit(False)) & registered.isNotNull() & year.isNotNull(), F.when(year == F.year(registered), finding(n, "ok", "year is the act's")).otherwise(finding(n, "warn", "year differs from the act's"))))
    asked = F.col("checks.id_birthdate_format").isin("ddmmyy", "yymmdd", "cyymmdd") & birth.isNotNull()
    done = F.lit(False)
    for n in NUMBERS:
        own = F.col(f"id_{n}")
        usable = own["date"].isNotNull()
        add(F.when(asked & ~done & own.isNotNull(), F.when(~usable, finding(n, "warn", "number's digits are no date")).when(own["date"] == birth, finding(n, "ok", "number holds the birth date")).otherwise(finding(n, "warn", "number's date differs"))))
        done = done | F.coalesce(usable, F.lit(False))
    margin = d("date_marge")
    add(F.when(F.coalesce(F.col("checks.margin_date_matches_birth"), F.lit(False)) & margin.isNotNull() & birth.isNotNull(), F.when(margin == birth, finding("date_marge", "ok", "margin's date is the birth date")).otherwise(finding("date_marge", "warn", "margin's date differs"))))

    def in_words(pair: Column) -> Column:
        (wv, wr), (dv, dr) = _get(pair[0]), _get(pair[1])
        said = tokens_to_int(number_tokens(F.regexp_replace(F.coalesce(wv, wr), "(?i)\\b(n|no|n°|an|numero|numéro|acte)\\b|[°:()]", " ")))
        shown = F.regexp_replace(F.regexp_extract(F.coalesce(dv, dr), r"(\d[\d.\s]*)", 1), r"[^\d]", "").try_cast("long")
        return F.when((said != 0) & (shown != 0), F.when(said == shown, finding(pair[0], "ok", "words are the digits")).otherwise(finding(pair[0], "warn", "words and digits differ")))

    pairs = F.coalesce(F.col("checks.number_word_pairs"), F.array(F.array(F.lit("numero_acte_lettres"), F.lit("numero_acte_marge"))))
    found.append(F.when(F.coalesce(F.col("checks.acte_number_words"), F.lit(False)), F.transform(pairs, in_words)).otherwise(F.array().cast("array<struct<field:string,level:string,message:string>>")))
    year, _ = _get("annee")
    declared, as_int = d("date_declaration"), F.trim(year).try_cast("int")
    add(F.when(F.coalesce(F.col("checks.annee_matches_declaration"), F.lit(False)) & year.isNotNull() & declared.isNotNull(), F.when(as_int.isNull(), finding("annee", "warn", "year is no number")).when(as_int == F.year(declared), finding("annee", "ok", "year is the declaration's")).otherwise(finding("annee", "warn", "year differs from the declaration's"))))
    name = F.coalesce(*(F.when(F.map_contains_key("fields", F.lit(n)), F.lit(n)) for n in NAMES), F.lit(NAMES[0]))
    for n in (name, F.lit("date_naissance"), F.lit("sexe")):
        add(F.when(_get(n)[0].isNull(), finding(n, "warn", "essential field is empty")))
    rows = with_dates(records).select("doc_id", F.posexplode(F.filter(F.flatten(F.array(*found)), lambda x: x.isNotNull())).alias("ord", "f"))
    rows = rows.select("doc_id", "ord", "f.*")

    places = best_places(records, fallback, strict)
    known = F.col("place").isNotNull()
    rows = rows.unionByName(places.select("doc_id", F.lit(900).alias("ord"), "field", F.when(known, "ok").otherwise("warn").alias("level"), F.when(known, "place known").otherwise("place not known").alias("message")))
    return rows.unionByName(equal_pairs(records))


def equal_pairs(records: DataFrame) -> DataFrame:
    """Findings on pairs of fields that the pack wants equal."""
    pair = records.where("checks.equal_pairs is not null").select("doc_id", "fields", F.explode("checks.equal_pairs").alias("p"))
    a, b = (F.coalesce(*_get(F.col("p")[i])) for i in (0, 1))
    both = pair.select("doc_id", F.col("p")[0].alias("field"), a.alias("a"), b.alias("b")).where(~empty(F.col("a")) & ~empty(F.col("b")))
    same = similarity(fold(F.col("a")), fold(F.col("b"))) >= PAIR_SCORE
    return both.withColumn("same", same).select("doc_id", F.lit(500).alias("ord"), "field", F.when(F.col("same"), "ok").otherwise("warn").alias("level"), F.when(F.col("same"), "pair agrees").otherwise("pair differs").alias("message"))


def canonical(merged: DataFrame, places: DataFrame) -> DataFrame:
    """``merged`` with place fields' values as in the gazetteer: what scoring sees, while agreement was on what was read."""
    known = places.where("place is not null").select("doc_id", "field", "place")
    out = merged.join(known, ["doc_id", "field"], "left").withColumn("value_read", F.col("value"))
    return out.withColumn("value", F.coalesce("place", "value")).drop("place")
