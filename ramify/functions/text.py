"""Name, URL and text expressions. Everything is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# White space that counts as blank at the ends of a field.
_BLANKS = " \t\n\r\x0b\x0c\u00a0\ufeff"


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(_BLANKS))


# --- numbers and defaults -----------------------------------------------------


def parse_int(text: Column | str) -> Column:
    """Leading integer of a string: blanks, sign and digits; the tail is ignored."""
    return F.regexp_extract(_col(text), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def grouped_integer(n: Column | str) -> Column:
    """1000000 as 1,000,000."""
    return F.format_number(_col(n), 0)


def default_name(name: Column | str, node_id: Column | str) -> Column:
    """A missing or blank name becomes Unknown_<id>."""
    trimmed = strip(name)
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.concat(F.lit("Unknown_"), _col(node_id).cast("string")))


def default_rank(rank: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(rank), F.lit("")), F.lit("no rank"))


def default_root_name(name: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit("Life"))


def unnamed(name: Column | str) -> Column:
    """Nested JSON nodes: only a null name is replaced."""
    return F.coalesce(_col(name), F.lit("Unnamed"))


def truncate_name(name: Column | str, length: int) -> Column:
    return F.substring(_col(name), 1, length)


def titlecase(name: Column | str) -> Column:
    """Upper-case every ASCII letter that starts an ASCII word; leave the rest.

    A word starts at each change from a non-word to a word character, so the
    letter after an apostrophe, a hyphen or an accented letter is a start.
    """
    pieces = F.split(_col(name), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    raised = F.transform(
        pieces,
        # Bytes from 'a' up to '{', which follows 'z': a lower-case ASCII start.
        lambda p: F.when((p >= "a") & (p < "{"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p),
    )
    return F.array_join(raised, "")


# --- scientific and common names ------------------------------------------------

# Name sources that list scientific names only.
SCIENTIFIC_SOURCES = [
    "NCBI",
    "NCBI Taxonomy",
    "NCBI:txid",
    "NCBI Taxonomy Browser",
    "Catalogue of Life",
    "COL",
    "ITIS",
    "Integrated Taxonomic Information System",
]

# Fixed pattern: endings of Latin genus names.
LATIN_GENUS = r"(?i)^[A-Z][a-z]+(us|um|a|is|es|ae|i|ii|iii)$"


def is_scientific_name(name: Column | str) -> Column:
    """One Latin-looking word, or a capitalised word and one or two lower-case ones."""
    text = strip(name)
    words = F.split(text, r"\s+")
    first = F.try_element_at(words, F.lit(1))
    head, tail = F.substring(first, 1, 1), F.substring(first, 2, 1 << 30)
    one_word = (first != F.lower(first)) & (first != F.upper(first)) & first.rlike(LATIN_GENUS)
    rest = F.slice(words, 2, 2)
    several = (
        (head == F.upper(head))
        & (tail == F.lower(tail))
        & F.forall(rest, lambda w: w == F.lower(w))
    )
    return F.coalesce(
        F.when(F.length(text) == 0, F.lit(False))
        .when(F.size(words) == 1, one_word)
        .when(F.size(words).isin(2, 3), several)
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def is_common_name(name: Column | str, source: Column | str) -> Column:
    """Not from a scientific-only source and not of scientific form."""
    upper = F.upper(F.coalesce(_col(source), F.lit("")))
    listed = F.lit(False)
    for s in SCIENTIFIC_SOURCES:
        listed = listed | F.contains(upper, F.lit(s.upper()))
    present = F.length(F.coalesce(_col(name), F.lit(""))) > 0
    return present & ~listed & ~is_scientific_name(name)


# --- URLs ---------------------------------------------------------------------


def uri_component(text: Column | str) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) alone."""
    out = F.url_encode(_col(text))
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def uri_decode(text: Column | str) -> Column:
    """Percent-decoding; malformed input is returned unchanged, null as ''."""
    col = _col(text)
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col, F.lit(""))


def deep_link(path_names: Column | str) -> Column:
    """'#' and the encoded path; '' for an empty path."""
    path = F.array_join(_col(path_names), "/")
    return F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("#"), uri_component(path)))


def shard_key(path_names: Column | str) -> Column:
    """Path of encoded names; a slash inside a name ends up as %252F."""
    parts = F.transform(_col(path_names), lambda n: uri_component(F.replace(n, F.lit("/"), F.lit("%2F"))))
    return F.array_join(parts, "/")


# Search pages of the known providers.
PROVIDERS = {
    "google": "https://www.google.com/search?q=",
    "wikipedia": "https://en.wikipedia.org/wiki/Special:Search?search=",
    "gbif": "https://www.gbif.org/species/search?q=",
    "ncbi": "https://www.ncbi.nlm.nih.gov/taxonomy/?term=",
    "col": "https://www.catalogueoflife.org/data/search?q=",
    "inat": "https://www.inaturalist.org/search?q=",
}


def provider_url(provider: Column | str, name: Column | str) -> Column:
    """Search page of a provider for a name; an unknown provider means google."""
    known = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    base = F.coalesce(F.try_element_at(known, _col(provider)), F.lit(PROVIDERS["google"]))
    return F.concat(base, uri_component(name))


# --- text shown for a node ------------------------------------------------------


def node_card(leaf_count: Column | str, level: Column | str) -> Column:
    """'1,000,000 leaves • Level 3'."""
    leaves = F.when(_col(leaf_count) > 0, F.concat(grouped_integer(leaf_count), F.lit(" leaves")))
    depth = F.concat(F.lit("Level "), _col(level).cast("string"))
    return F.concat_ws(" • ", leaves, depth)


def node_tooltip(leaf_count: Column | str, level: Column | str) -> Column:
    """'Level: 3 • Descendants: 12' (the count is the leaf count)."""
    return F.concat(
        F.lit("Level: "),
        F.coalesce(_col(level).cast("string"), F.lit("")),
        F.lit(" • Descendants: "),
        grouped_integer(F.coalesce(_col(leaf_count), F.lit(0))),
    )


def json_node(struct: Column | str) -> Column:
    """Compact JSON that keeps null fields."""
    return F.to_json(_col(struct), {"ignoreNullFields": "false"})


def highlight(text: Column | str, query: str) -> Column:
    """Wrap the first hit in <mark>; without one, each letter of a fuzzy match."""
    col = _col(text)
    if not query:
        return col
    at = F.instr(F.lower(col), query.lower())
    n = len(query)
    direct = F.concat(
        F.substring(col, F.lit(1), at - 1),
        F.lit("<mark>"),
        F.substring(col, at, F.lit(n)),
        F.lit("</mark>"),
        F.substring(col, at + n, F.lit(1 << 30)),
    )
    # One pass: up to each letter nothing but other characters. A text that lacks a
    # letter does not match and stays as it is.
    steps = "".join(rf"([^\x{{{ord(c):x}}}]*+)(\x{{{ord(c):x}}})" for c in query)
    marked = "".join(f"${2 * i + 1}<mark>${2 * i + 2}</mark>" for i in range(n))
    return F.when(at > 0, direct).otherwise(F.regexp_replace(col, "(?isu)^" + steps, marked))
