"""Column functions over text: built-in expressions, but for the tokens of HTML
(``markup``)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from quillmere.functions.scalars import let, literal_array, literal_map

# Unicode white space: (?U) makes Java's \s cover it, bar four separators.
SPACE = r"\s\x1C-\x1F"
HORIZONTAL_SPACE = r"[^\S\n]\x1C-\x1F"
# The same characters as a plain string, for trimming.
SPACE_CHARS = "".join(
    chr(c)
    for lo, hi in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                   (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    for c in range(lo, hi + 1)
)
WORD = r"\p{L}\p{N}_"
QUOTES = {"“": '"', "”": '"', "`": '"', "‘": "'", "’": "'"}
KEPT_PUNCTUATION = r".,!?;:\-()\[\]'" + '"'

# The language hint vocabulary and character ranges.
ENGLISH_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
ACCENTED = "[àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]"
CYRILLIC = "[А-Яа-я]"
CHINESE = "[一-龯]"

# File extension to document type.
EXTENSION_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".md": "md", ".markdown": "md",
    ".html": "html", ".htm": "html", ".csv": "csv", ".xlsx": "xlsx", ".xls": "xlsx",
}

# Named character references, from Python's table of HTML's; & itself comes last.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items() if name != "amp"} | {"&apos;": "'"}

BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|"
    "header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))


def clean_text(text: Column) -> Column:
    """Typographic quotes to ASCII, foreign characters dropped, runs of
    sentence marks cut to the last one, white space squeezed."""
    quoted = text
    for mark, ascii_mark in QUOTES.items():
        quoted = F.replace(quoted, F.lit(mark), F.lit(ascii_mark))
    kept = F.regexp_replace(quoted, f"(?U)[^{WORD}{SPACE}{KEPT_PUNCTUATION}]+", "")
    single = F.regexp_replace(kept, r"[.!?]+([.!?])", "$1")
    return F.coalesce(squeeze(single), F.lit(""))


def standardise_text(text: Column) -> Column:
    """Words only, single-spaced, lower case."""
    return F.lower(squeeze(F.regexp_replace(text, f"(?U)[^{WORD}{SPACE}]+", "")))


def lower_strip(text: Column) -> Column:
    return strip(F.lower(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+"))


def sentence_count(text: Column) -> Column:
    """Non-blank stretches between sentence marks, one match each."""
    return F.regexp_count(text, F.lit(f"(?U)[^.!?{SPACE}][^.!?]*"))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: p.rlike(f"(?U)[^{SPACE}]")))


def english_word_count(text: Column) -> Column:
    """How many of the common English words occur, also inside other words."""
    words = literal_array(ENGLISH_WORDS)
    return let(F.lower(text), lambda t: F.size(F.filter(words, lambda word: F.contains(t, word))))


def profile(text: Column) -> dict[str, Column]:
    """The text statistics kept with documents and chunks."""
    return {
        "word_count": word_count(text),
        "char_count": F.char_length(text),
        "paragraph_count": paragraph_count(text),
        "sentence_count": sentence_count(text),
        "english_word_count": english_word_count(text),
        "has_accented_chars": text.rlike(ACCENTED),
        "has_cyrillic": text.rlike(CYRILLIC),
        "has_chinese": text.rlike(CHINESE),
    }


def estimated_chunks(length: Column, size: int = 1000, overlap: int = 200) -> Column:
    step = size - overlap
    return F.when(length == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.ceil(length / F.lit(step)))
    ).cast("long")


def fits_chunk(length: Column, size: int = 1000) -> Column:
    return length <= F.lit(size)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(EXTENSION_TYPES), file_extension(path)), F.lit("txt"))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise."""
    as_text = content.cast("string")
    return strip(
        F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    )


def _resolve(entity: Column) -> Column:
    """One character reference, or itself where it means nothing."""
    named = literal_map(ENTITIES)
    decimal = F.regexp_extract(entity, r"^&#([0-9]{1,7});$", 1).try_cast("long")
    hexadecimal = F.conv(F.nullif(F.regexp_extract(entity, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.lit("")), 16, 10)

    def character(point: Column) -> Column:
        usable = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    numbered = let(F.coalesce(decimal, hexadecimal.try_cast("long")), character)
    return F.coalesce(F.try_element_at(named, entity), numbered, entity)


def unescape(text: Column) -> Column:
    """Resolve the character references that occur in the text; the ampersand
    is last so that an escaped reference is resolved once."""
    ampersand = r"&(?:amp|#38|#[xX]26);"

    def resolve(t: Column) -> Column:
        found = F.filter(
            F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#?[0-9A-Za-z]+;"), F.lit(0))),
            lambda e: ~e.rlike(f"^{ampersand}$"),
        )
        return F.aggregate(found, t, lambda acc, e: F.replace(acc, e, _resolve(e)))

    return F.regexp_replace(let(text, resolve), ampersand, "&")


def html_to_text(html: Column) -> Column:
    """Visible text, one line per block element."""
    from quillmere.functions.markup import visible_text

    blanks = F.regexp_replace(visible_text(html), f"(?U)[{HORIZONTAL_SPACE}]+", " ")
    return strip(F.regexp_replace(blanks, r" ?\n[ \n]*", "\n"))


# Markdown marks and what stays of them, applied in order.
MARKDOWN_RULES = (
    (r"(?m)^ {0,3}(?:```|~~~)[^\n]*\n?", ""),
    (r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]*[^\n]*\n?", ""),  # where a reference leads
    (r"(?m)^([^\n]*[^\s>#*+=-][^\n]*)\n(?:=+|-+)[ \t]*$", "$1"),  # an underlined heading
    (r"(?m)^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),
    (r"(?m)^#{1,6}[ \t]+([^\n]*?)[ \t]*#*$", "$1"),
    (r"(?m)^[ \t]*(?:>[ \t]?)+", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(?m)^[ \t]*[0-9]+\.[ \t]+", ""),
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    (r"!\[[^\]\n]*\]\[[^\]\n]*\]", ""),
    (r"\[([^\]\n]+)\]\([^)\n]*\)", "$1"),
    (r"\[([^\]\n]+)\]\[[^\]\n]*\]", "$1"),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"(^|[\s(\"'*])_([^_\s](?:[^_\n]*[^_\s])?)_($|[\s).,;:!?\"'*])", "$1$2$3"),
    (r"`([^`\n]+)`", "$1"),
    (r"<((?:https?|ftp|mailto):[^<>\s]+)>", "$1"),
    (r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--(?:[^-]|-[^-])*-->|<[!?][^<>]*>", ""),  # any other "<" is text
)

# The same for an engine that goes back: possessive parts keep what they have read,
# or a line would cost the square of its length, and a comment a call a character.
_POSSESSIVE = {
    r"(?m)^([^\n]*[^\s>#*+=-][^\n]*)\n(?:=+|-+)[ \t]*$":
        r"(?m)^([ \t\x0B\f\r>#*+=-]*+[^\s>#*+=-][^\n]*+)\n(?:=++|-++)[ \t]*+$",
    r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--(?:[^-]|-[^-])*-->|<[!?][^<>]*>":
        r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--(?:[^-]|-[^-])*+-->|<[!?][^<>]*>",
}


def markdown_to_text(markdown: Column) -> Column:
    text = markdown
    for pattern, kept in MARKDOWN_RULES:
        # (?d): only \n ends a line
        text = F.regexp_replace(text, _POSSESSIVE.get(pattern, pattern).replace("(?m)", "(?md)"), kept)
    return strip(text)


def csv_records(content: Column) -> Column:
    """Records of a CSV text, blank lines left out; quoted line breaks stay
    inside their record, and quotes that stay open hold all that follows."""
    lines = F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"\n\z", "")
    return F.regexp_extract_all(lines, F.lit(r'(?:"[^"]*+(?:"|\z)|[^"\n]++)++'), F.lit(0))


def csv_columns(header: Column) -> Column:
    """Names in a header record; a comma inside quotes parts nothing."""
    fields = F.regexp_extract_all(F.concat(header, F.lit(",")), F.lit(r'((?:"[^"]*+"|[^",]++)*+),'), F.lit(1))
    bare = lambda f: F.regexp_replace(F.trim(F.regexp_replace(f, "\n", " ")), r'^"(.*)"$', "$1")
    return F.transform(fields, lambda f: F.trim(F.replace(bare(f), F.lit('""'), F.lit('"'))))


def csv_digest_of(name: Column, records: Column, rows: Column, sample: int = 10) -> Column:
    """Readable digest from the leading records and the number of rows."""

    def digest(r: Column) -> Column:
        lines = F.concat(F.lit("Sample data:\n"), F.array_join(F.slice(r, 2, sample), "\n"))
        return F.when(
            rows >= 0,
            F.concat(
                F.lit("CSV Data from "), name, F.lit(":\n\nColumns: "), F.array_join(csv_columns(F.element_at(r, 1)), ", "),
                F.lit("\nTotal rows: "), rows.cast("string"), F.lit("\n\n"),
                F.when(rows > 0, lines).otherwise(F.lit("")),
            ),
        )

    return let(records, digest)


def csv_digest_text(name: Column, content: Column, sample: int = 10) -> Column:
    """Readable digest of one CSV file: columns, row count, leading rows."""
    return let(csv_records(content), lambda r: csv_digest_of(name, r, F.size(r) - 1, sample))
