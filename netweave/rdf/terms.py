"""Terms of a graph as strings: ``<iri>``, ``_:name``, ``"text"``,
``"text"@en``, ``"5"^^<type>``. A triple table has the columns s, p, o."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
#: Namespaces that are known without a declaration.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#",
    "sosa": "http://www.w3.org/ns/sosa/", "ssn": "http://www.w3.org/ns/ssn/", "geo": "http://www.opengis.net/ont/geosparql#", "unit": "http://qudt.org/vocab/unit/", "dcterms": "http://purl.org/dc/terms/",
}
NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")
_NUMBER = rf'^"([^"]*)"\^\^<{XSD}(?:{"|".join(NUMERIC)})>$'


def iri(value: Column | str) -> Column:
    return F.concat(F.lit("<"), F.lit(value) if isinstance(value, str) else value, F.lit(">"))


def escape(value: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def unescape(value: Column) -> Column:
    value = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    for new, old in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.replace(value, F.lit("\x00"), F.lit("\\"))


def literal(value: Column, kind: str | None = None, lang: str | None = None) -> Column:
    quoted = F.concat(F.lit('"'), escape(value.cast("string")), F.lit('"'))
    return F.concat(quoted, F.lit(f"^^<{XSD}{kind}>" if kind else f"@{lang}" if lang else ""))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def text(term: Column) -> Column:
    """The IRI, blank node name or text of a term."""
    quoted = unescape(F.regexp_extract(term, r'(?s)^"(.*)"(?:@[\w-]+|\^\^<[^>]*>)?$', 1))
    return F.when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2)).when(is_literal(term), quoted).otherwise(term)


def number(term: Column) -> Column:
    """The value of a numeric literal; null for any other term."""
    return F.nullif(F.regexp_extract(term, _NUMBER, 1), F.lit("")).try_cast("double")


def language(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, r'"@([\w-]+)$', 1))


def datatype(term: Column) -> Column:
    typed = F.regexp_extract(term, r'"\^\^(<[^>]*>)$', 1)
    plain = F.when(term.rlike(r'"@[\w-]+$'), f"<{PREFIXES['rdf']}langString>").otherwise(f"<{XSD}string>")
    return F.when(is_literal(term), F.when(typed != "", typed).otherwise(plain))


_STAMP = r'^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$'


def stamp_part(value: Column, part: int) -> Column:
    """Of the text of a date or dateTime its year, month, day, hour, minute, second
    or zone (1 to 7), as they are written; null where there is none."""
    return F.nullif(F.regexp_extract(value, _STAMP, part), F.lit(""))


def instant(term: Column) -> Column:
    """Microseconds since 1970 of a dateTime or date literal, those without a zone
    in UTC and dates at their start; null for any other term."""
    value = F.regexp_extract(term, rf'^"([^"]*)"\^\^<{XSD}date(?:Time)?>$', 1)
    zoned = F.when(stamp_part(value, 7).isNotNull(), value).otherwise(F.concat(value, F.lit("Z")))
    whole = F.when(stamp_part(value, 4).isNotNull(), zoned).when(stamp_part(value, 1).isNotNull(), F.concat(F.substring(value, 1, 10), F.lit("T00:00:00"), F.coalesce(stamp_part(value, 7), F.lit("Z"))))
    return F.unix_micros(whole.try_cast("timestamp")).cast("double")
