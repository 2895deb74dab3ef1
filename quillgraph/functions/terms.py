"""Terms as columns.

A term is one string in its canonical written form: <iri>, _:label, or a quoted literal that may be
followed by @lang or ^^<datatype>. Equal strings are equal terms, so joins need a single key, and
kind, lexical form and datatype are read off by the expressions here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of public vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = f"<{RDF}type>"
SCHEMA_PREDICATES = (f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>", f"<{RDFS}domain>", f"<{RDFS}range>")
SCHEMA_TYPES = tuple(f"<{OWL}{n}>" for n in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Ontology"))


def iri(text: str) -> str:
    return f"<{text}>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def literal(text: str, datatype: str = "", lang: str = "") -> str:
    return f'"{escape(text)}"' + (f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


def iri_of(*parts: Column | str) -> Column:
    return F.concat(F.lit("<"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(">"))


def literal_of(value: Column, datatype: str = "") -> Column:
    """A literal term of a column; null stays null."""
    text = value.cast("string")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"' + (f"^^<{datatype}>" if datatype else "")))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """The text of a literal, the address of an IRI, the label of a blank node."""
    body = F.substring(t, F.lit(2), F.length(t) - F.length(F.substring_index(t, '"', -1)) - 2)
    plain = body
    for a, b in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.when(is_literal(t), F.when(plain.contains("\\"), body).otherwise(plain)).when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.substring(t, F.lit(3), F.length(t)))


def datatype(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r'(?s)^".*"\^\^<([^>]*)>$', 1), F.lit(""))


def lang(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1), F.lit(""))


def kind_rank(t: Column) -> Column:
    """Order of kinds: unbound, blank, IRI, literal."""
    return F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)


def order_keys(t: Column) -> list[Column]:
    """Ascending sort keys of a term; numbers by value among themselves."""
    number = F.when(datatype(t).isin(*(XSD + n for n in ("integer", "decimal", "double", "int", "long"))), lexical(t).try_cast("double"))
    return [kind_rank(t).asc(), number.asc_nulls_first(), lexical(t).asc(), t.asc()]


def local_name(t: Column) -> Column:
    """What follows the last # or / of the lexical form."""
    return F.regexp_extract(lexical(t), r"([^/#]*)$", 1)


def reader_name(t: Column) -> Column:
    """What follows the last #, or else the last /; a # fragment may hold a /."""
    u = lexical(t)
    return F.when(u.contains("#"), F.substring_index(u, "#", -1)).otherwise(F.substring_index(u, "/", -1))


def in_namespaces(t: Column, namespaces: tuple[str, ...]) -> Column:
    """Whether an IRI is in one of the namespaces or is one's root, written without its last sign."""
    out = F.lit(False)
    for n in namespaces:  # on the term as written: only literals have anything to undo
        out = out | t.startswith(f"<{n}") | (t == iri(n.rstrip("/#")))
    return is_iri(t) & out


def is_schema(p: Column, o: Column) -> Column:
    return p.isin(*SCHEMA_PREDICATES) | ((p == TYPE) & o.isin(*SCHEMA_TYPES))


def shown(o: Column) -> Column:
    """An object for comparison: a literal's quoted text without its datatype, an IRI's local name."""
    return F.when(is_literal(o), F.concat(F.lit('"'), lexical(o), F.lit('"'))).when(is_iri(o), local_name(o)).otherwise(o)


def folded(text: Column) -> Column:
    """White space folded, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def folded_name(text: Column) -> Column:
    return folded(F.replace(text, F.lit("_"), F.lit(" ")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def safe_id(text: Column) -> Column:
    return F.translate(text, " -.", "___")


def snake(text: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])([A-Z])", r"_$1")), " -", "__")


def class_name(text: Column) -> Column:
    """PascalCase stays; other names have their parts capitalised and joined."""
    parts = F.transform(F.filter(F.split(text, r"[_\-\s.]+"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return F.when(text.rlike(r"^[A-Z][A-Za-z0-9]*$"), text).otherwise(F.array_join(parts, ""))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))


def goal_and_story(text: Column) -> Column:
    """struct(goal, story): a message cut at its first full stop and space."""
    cut = F.split(text, r"\. ", 2)
    return F.struct(F.when(F.size(cut) > 1, F.concat(cut[0], F.lit("."))).otherwise(text).alias("goal"), F.when(F.size(cut) > 1, F.get(cut, F.lit(1))).otherwise(F.lit("")).alias("story"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the distinct words of two folded texts; 0 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    x, y = words(a), words(b)
    return ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
