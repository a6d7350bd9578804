"""Column expressions over text: tokens, symbols, ids, documents, lines, protocol messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.schema import LANGUAGE_OF

#: Line ends as Python's splitlines has them; one at the very end begins no further line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used (a lambda's variable is not copied)."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What stands between identifiers: all but ASCII letters, digits and underscores. The predefined class is the same
#: set in Java and, measured here, about 20 times as fast as the set spelt out.
SEPARATOR = r"\W+"
#: Whether any identifier of a text has parts.
HAS_PARTS = "_|[a-z0-9][A-Z]"


def plain_tokens(text: Column) -> Column:
    """The identifiers of a text in lower case, with single spaces between."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATOR, " ")))


def tokenize_code(text: Column) -> Column:
    """Identifiers in lower case, each followed by its snake_case and then its camelCase parts; null text has none.

    Texts without parts, such as prose, are only split; the others go through array functions token by token.
    """
    plain = once(plain_tokens(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))
    return F.when(text.rlike(HAS_PARTS), _tokens_with_parts(text)).otherwise(plain)


def _tokens_with_parts(text: Column) -> Column:
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda x: x != "")
    none = F.array().cast("array<string>")

    def parts(x: Column) -> Column:
        snake = F.when(F.contains(x, F.lit("_")), F.filter(F.split(x, "_"), lambda y: y != "")).otherwise(none)
        camel = F.when(x.rlike("[a-z0-9][A-Z]"), F.split(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), " ")).otherwise(none)
        return F.transform(F.concat(F.array(x), snake, camel), F.lower)

    return F.flatten(F.transform(raw, parts))


_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])")
#: For bytes of UTF-8, of which those beyond ASCII stand between identifiers: identifiers as they are, in lower case, and by the kinds of their characters.
_KEPT = bytes(c if c < 128 and (chr(c).isalnum() or chr(c) == "_") else 32 for c in range(256))
_LOWER, _KINDS = _KEPT.lower(), bytes(ord("A" if chr(c).isupper() else "a" if chr(c).isalnum() else chr(c)) for c in _KEPT)


def tokenize(text: str) -> list[str]:
    """The same tokens of one string, for queries on the driver, encoders and postings."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = raw.translate(_KINDS)
    if b"_" not in kinds and b"aA" not in kinds:
        return raw.translate(_LOWER).decode().split()
    out: list[str] = []
    for word, kind in zip(raw.translate(_KEPT).decode().split(), kinds.decode().split(), strict=True):
        out.append(word)
        if "_" in kind:
            out += filter(None, word.split("_"))
        if "aA" in kind:
            out += _CAMEL.sub(" ", word).split(" ")
    return " ".join(out).lower().split(" ")


def normalize_symbol(symbol: Column, arrows: bool = True) -> Column:
    """Trimmed, with :: (and ->) as dots."""
    s = F.replace(F.trim(symbol), F.lit("::"), F.lit("."))
    return F.replace(s, F.lit("->"), F.lit(".")) if arrows else s


def normalized(symbol: str, arrows: bool = True) -> str:
    s = symbol.strip().replace("::", ".")
    return s.replace("->", ".") if arrows else s


def symbol_suffixes(symbol: Column) -> Column:
    """All dotted suffixes of a normalised symbol, longest first."""
    return once(F.split(symbol, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def last_segment(symbol: Column) -> Column:
    return F.element_at(F.split(symbol, r"\."), -1)


def matches_symbol(callee_norm: Column, target: str) -> Column:
    """A normalised callee equals the target or ends with it after a dot."""
    t = normalized(target)
    return (callee_norm == t) | callee_norm.endswith("." + t)


def matches_definition(name: Column, class_chain: Column, target: str) -> Column:
    """Bare targets match names; dotted ones a suffix of the qualified name, or a name in a class whose chain ends so."""
    t = normalized(target, arrows=False)
    if "." not in t:
        return name == t
    chain = F.replace(F.coalesce(class_chain, F.lit("")), F.lit("::"), F.lit("."))
    full = F.when(chain != "", F.concat(chain, F.lit("."), name)).otherwise(name)
    full = F.replace(full, F.lit("::"), F.lit("."))
    head, _, last = t.rpartition(".")
    inside = (name == last) & (chain != "") & ((chain == head) | chain.endswith("." + head))
    return (full == t) | full.endswith("." + t) | inside


def splitlines(text: Column) -> Column:
    """Lines without their ends; the empty text has none."""
    lines = F.split(text, LINE_END, -1)
    return once(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (1-based, both included) as one text; null where there are none."""
    first = F.greatest(start, F.lit(1))
    return F.when(first <= F.least(end, F.size(lines)), F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n"))


def qualified_name(class_chain: Column, name: Column) -> Column:
    return F.concat_ws("::", F.nullif(class_chain, F.lit("")), name)


def chunk_id(repo: Column, file: Column, class_chain: Column, name: Column) -> Column:
    return F.concat_ws("::", F.nullif(repo, F.lit("")), file, F.nullif(class_chain, F.lit("")), name)


def render_document(file: Column, class_chain: Column, name: Column, docstring: Column, code: Column) -> Column:
    """The text that is searched: labelled lines, those of empty fields left out."""
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    return F.concat_ws("\n", F.concat(F.lit("File: "), file), line("Class: ", class_chain), F.concat(F.lit("Method: "), name), line("Docstring: ", docstring), F.concat(F.lit("Code:\n"), code))


def code_of_document(document: Column) -> Column:
    """What follows the first code label, or else the whole document."""
    at = F.instr(document, "Code:\n")
    return F.when(at > 0, F.substr(document, at + 6)).otherwise(document)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(file: Column) -> Column:
    """The last suffix in lower case, with its dot; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(file, r"[^/.][^/]*?(\.[^./]+)$", 1))


def language_of(file: Column) -> Column:
    """The language of a path by its extension, null if it has none."""
    pairs = [F.lit(x) for kv in sorted(LANGUAGE_OF.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(file))


def strip_string_literal(raw: Column) -> Column:
    """The contents of a Python string literal, trimmed; any other text is only trimmed."""
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    pattern = r"(?s)^[bBrRuUfF]{0,3}(\"\"\"|'''|\"|')(.*)\1$"
    inner = F.when(trimmed.rlike(pattern), F.regexp_extract(trimmed, pattern, 2)).otherwise(raw)
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def go_receiver(raw: Column) -> Column:
    """The type of a Go receiver such as (s *Server)."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(raw, r"^[() ]+|[() ]+$", ""), r"(\S+)\s*$", 1), r"^\*+", "")


# --- language-server messages -------------------------------------------------------------


def encode_message(body: Column) -> Column:
    """A JSON body framed by its length in bytes."""
    return F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def path_to_uri(path: Column) -> Column:
    p = posix_path(path)
    return F.concat(F.lit("file://"), F.when(p.rlike("^[A-Za-z]:"), F.concat(F.lit("/"), p)).otherwise(p))


def uri_to_path(uri: Column) -> Column:
    path = F.url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^/(?=[A-Za-z]:)", "")


_POINT = "struct<line: int, character: int>"
_RANGE = f"struct<start: {_POINT}, end: {_POINT}>"
_LOCATION = f"struct<uri: string, targetUri: string, range: {_RANGE}, targetSelectionRange: {_RANGE}, targetRange: {_RANGE}>"


def parse_locations(result: Column) -> Column:
    """Locations or location links, one or a list, as (file, start_line, start_character, end_line, end_character).

    Lines become 1-based. What has no address or start is left out, a range without its end ends where it starts;
    no result gives an empty list.
    """
    text = F.trim(F.coalesce(result, F.lit("[]")))
    many = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{_LOCATION}>")

    def one(x: Column) -> Column:
        span = F.coalesce(x["range"], x["targetSelectionRange"], x["targetRange"])
        first, zero = span["start"], F.lit(0)
        last = F.when(span["end"]["line"].isNull(), first).otherwise(span["end"])
        return F.struct(
            uri_to_path(F.coalesce(x["uri"], x["targetUri"])).alias("file"), (first["line"] + 1).alias("start_line"), F.coalesce(first["character"], zero).alias("start_character"),
            (last["line"] + 1).alias("end_line"), F.coalesce(last["character"], zero).alias("end_character"),
        )

    found = F.transform(F.coalesce(many, F.array().cast(f"array<{_LOCATION}>")), one)
    return F.filter(found, lambda x: x["file"].isNotNull() & x["start_line"].isNotNull())


def hover_text(contents: Column) -> Column:
    """Hover contents as text: a string, an object with a value, or a list of these by lines."""
    v = F.try_parse_json(contents)
    plain = lambda x: F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string"))
    single = lambda x: F.coalesce(F.try_variant_get(x, "$.value", "string"), plain(x), F.lit(""))
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), single)
    listed = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(v.isNull(), F.lit("")).otherwise(F.when(listed, F.array_join(many, "\n")).otherwise(F.coalesce(single(v), F.lit(""))))
