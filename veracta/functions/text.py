"""Text normal forms and small classifiers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to: Latin letters that decompose into a plain one and marks. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĀĂĄĆĈĊČĎĒĔĖĘĚĜĞĠĢĤĨĪĬĮİĴĶĹĻĽŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŸŹŻŽ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzAAAAAACEEEEIIIINOOOOOUUUUYAAACCCCDEEEEEGGGGHIIIIIJKLLLNNNOOORRRSSSSTTUUUUUUWYYZZZ"


def empty(c: Column) -> Column:
    """Null and the empty string are both no value."""
    return F.coalesce(c, F.lit("")) == ""


def strip_accents(c: Column) -> Column:
    """Accents off, case kept. Combining marks that stand alone go too."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def fold(c: Column) -> Column:
    """Accents off, lower case; white space as it is."""
    return F.lower(strip_accents(c))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normal(c: Column) -> Column:
    """Folded and squeezed; null to empty."""
    return F.coalesce(squeeze(fold(c)), F.lit(""))


def normal_value(c: Column) -> Column:
    """The form in which two readings are compared: hyphens and full stops are spaces too."""
    return squeeze(F.translate(fold(F.coalesce(c, F.lit(""))), "-.", "  "))


def words(c: Column) -> Column:
    """Words of a normal form; none of an empty one."""
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def slug(c: Column, default: str = "scan") -> Column:
    """A name for files: other characters to _, no _ at the ends, 40 characters at most."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.left(F.when(out == "", F.lit(default)).otherwise(out), F.lit(40))


def title(c: Column) -> Column:
    """A capital wherever letters begin, also after apostrophes and hyphens; small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def split_name(full: Column) -> Column:
    """``struct(firstname, surname)``: words all in capitals, of two letters or more, are the surname; without such
    words, or with no others, it is the last word; a lone word is a surname only in capitals."""
    tokens = F.filter(F.split(F.translate(F.coalesce(full, F.lit("")), ",", " "), "\\s+"), lambda t: t != "")

    def capital(t: Column) -> Column:
        return (F.char_length(t) >= 2) & (t == F.upper(t)) & t.rlike("\\p{Lu}") & ~t.rlike("\\p{Ll}")

    upper, lower = F.filter(tokens, capital), F.filter(tokens, lambda t: ~capital(t))
    n, last = F.size(tokens), F.try_element_at(tokens, F.lit(-1))
    none = F.lit("")
    return (
        F.when(n == 0, F.struct(none.alias("firstname"), none.alias("surname")))
        .when((F.size(upper) > 0) & (F.size(lower) > 0), F.struct(F.array_join(lower, " ").alias("firstname"), F.array_join(upper, " ").alias("surname")))
        .when((n == 1) & (F.size(upper) == 1), F.struct(none.alias("firstname"), last.alias("surname")))
        .when(n == 1, F.struct(last.alias("firstname"), none.alias("surname")))
        .otherwise(F.struct(F.array_join(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), " ").alias("firstname"), last.alias("surname")))
    )


def name_text(name: Column) -> Column:
    """First name and surname of a struct, whichever there are."""
    return F.concat_ws(" ", F.nullif(name["firstname"], F.lit("")), F.nullif(name["surname"], F.lit("")))


def name_key(text: Column) -> Column:
    """A name's words in order of the alphabet, so that printed order doesn't count."""
    return F.array_join(F.array_sort(words(normal(text))), " ")


#: Words for the two values of the register. Fixed values.
MALE, FEMALE = ("masculin", "m", "male", "garcon"), ("feminin", "f", "female", "fille")


def gender(c: Column) -> Column:
    v = F.lower(F.trim(strip_accents(c)))
    return F.when(v.isin(*MALE), "male").when(v.isin(*FEMALE), "female")


def relation(c: Column) -> Column:
    """The declarant's: looked for as a part of any word, father first."""
    v = fold(c)
    return F.when(F.contains(v, F.lit("pere")), "FATHER").when(F.contains(v, F.lit("mere")), "MOTHER")


#: Beginnings of nationality adjectives, and country codes, in the order in which they are tried. Fixed values.
STEMS = {
    "TUNISIEN": "TUN", "MAROCAIN": "MAR", "ALGERIEN": "DZA", "SENEGALAIS": "SEN", "MALIEN": "MLI", "IVOIRIEN": "CIV",
    "CAMEROUNAIS": "CMR", "GABONAIS": "GAB", "GUINEEN": "GIN", "BENINOIS": "BEN", "TOGOLAIS": "TGO", "NIGERIAN": "NGA",
    "NIGERIEN": "NER", "KENYAN": "KEN", "RWANDAIS": "RWA", "MAURITANIEN": "MRT", "MAURICIEN": "MUS", "MALGACHE": "MDG",
    "EGYPTIEN": "EGY", "LIBANAIS": "LBN", "ANGOLAIS": "AGO", "CAPVERDIEN": "CPV", "SEYCHELLOIS": "SYC", "SIERRALEONAIS": "SLE",
    "LIBERIEN": "LBR", "SUDAFRICAIN": "ZAF", "BURKINAB": "BFA", "TCHADIEN": "TCD", "CENTRAFRICAIN": "CAF", "FRANCAIS": "FRA",
    "COMORIEN": "COM", "DJIBOUTIEN": "DJI", "BURUNDAIS": "BDI", "ZAMBIEN": "ZMB", "GHANEEN": "GHA", "GAMBIEN": "GMB",
}


def nationality(c: Column) -> Column:
    """Country code of the first word that begins with a stem. No stem begins another, so one pattern finds it."""
    found = F.regexp_extract(F.upper(strip_accents(c)), f"(?:^|[^A-Z])({'|'.join(STEMS)})", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STEMS.items() for x in kv)), F.nullif(found, F.lit("")))


def is_iso_date(c: Column) -> Column:
    """By shape only."""
    return F.coalesce(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def substantial(text: Column, height: Column, low: int = 80, few: int = 2, many: int = 3) -> Column:
    """Whether a box's text has enough words of three letters or more; low boxes need fewer."""
    n = F.size(F.filter(words(text), lambda w: F.char_length(F.regexp_replace(w, "[^\\p{L}]", "")) >= 3))
    return n >= F.when(height < low, few).otherwise(many)
