"""RDF terms as N-Triples strings in columns: <iri>, _:blank, "text", "text"@lang, "text"^^<datatype>, <<( s p o )>>.

Equality of strings is term equality, so joins need no typed struct; values are taken out where an expression needs them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NUMERIC = ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger",
           "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
_LIT = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(ltr|rtl))?|\^\^<([^>]*)>)?$'


def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~t.startswith("<<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_triple(t: Column) -> Column:
    return t.startswith("<<(")


def _unescape(c: Column) -> Column:
    plain = c
    for a, b in (("\\\\", "\u0001"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\u0001", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(F.instr(c, "\\") > 0, plain).otherwise(c)


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lexical(t: Column) -> Column:
    """STR: the text of a literal or the address of an IRI; null for others."""
    return F.when(is_literal(t), _unescape(F.regexp_extract(t, _LIT, 1))).when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LIT, 2))


def direction(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LIT, 3))


def datatype(t: Column) -> Column:
    """IRI text of a literal's datatype."""
    dt = F.regexp_extract(t, _LIT, 4)
    return F.when(is_literal(t), F.when(dt != "", dt).when(lang(t) != "", F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string")))


def is_numeric(t: Column) -> Column:
    return is_literal(t) & datatype(t).isin(*[XSD + n for n in NUMERIC])


def number(t: Column) -> Column:
    return F.when(is_numeric(t), lexical(t).try_cast("double"))


def timestamp(t: Column) -> Column:
    return F.when(is_literal(t) & datatype(t).isin(XSD + "dateTime", XSD + "date"), lexical(t).try_cast("timestamp"))


def boolean(t: Column) -> Column:
    """Effective boolean value; null (an error) for other terms."""
    d = datatype(t)
    return (F.when(d == XSD + "boolean", lexical(t).isin("true", "1")).when(is_numeric(t), F.coalesce(number(t) != 0, F.lit(False)))
            .when(d.isin(XSD + "string", RDF + "langString"), F.length(lexical(t)) > 0))


def make_iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def make_string(c: Column, tail: Column | None = None) -> Column:
    return F.concat(F.lit('"'), escape(c), F.lit('"'), tail if tail is not None else F.lit(""))


def make_typed(c: Column, dt: str) -> Column:
    return F.concat(F.lit('"'), escape(c), F.lit(f'"^^<{dt}>'))


def make_number(c: Column, integer: Column | bool = False) -> Column:
    whole = make_typed(c.cast("long").cast("string"), XSD + "integer")
    broken = make_typed(c.cast("string"), XSD + "double")
    if isinstance(integer, bool):
        return whole if integer else broken
    return F.when(integer, whole).otherwise(broken)


def make_boolean(c: Column) -> Column:
    return F.when(c, F.lit(f'"true"^^<{XSD}boolean>')).when(~c, F.lit(f'"false"^^<{XSD}boolean>'))


def sort_key(t: Column) -> Column:
    """Order of terms: unbound, blank, IRI, literal (numbers by value, times, then text), triple."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(is_literal(t), 3).otherwise(4)
    return F.struct(kind.alias("k"), number(t).alias("n"), timestamp(t).alias("t"), F.coalesce(lexical(t), t).alias("s"), t.alias("x"))
