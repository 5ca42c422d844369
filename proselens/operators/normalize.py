"""Text-normalising projections. Each keeps line numbers; all but entity decoding keep offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselens.functions.text import decode_entities, masked

HTML_BLOCKS = r"(?isdU)<(script|style)[^>]*>.*?</\1>"
HTML_TAGS = r"(?s)<[^>]+>"
FENCED = r"(?s)```.*?```"
INLINE = r"`[^`\n]*`"


def strip_html(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Visible text: script and style blocks and tags become blanks of the same height, entities are decoded: all of HTML, without a
    semicolon too, or those given only, as reference and character, one after the other."""
    bare = masked(masked(text, HTML_BLOCKS), HTML_TAGS)
    if entities is None:
        return decode_entities(bare)
    for reference, character in entities.items():
        bare = F.replace(bare, F.lit(reference), F.lit(character))
    return bare


def visible(text: Column, path: Column | None = None, as_html=False) -> Column:
    """strip_html for paths that end with .html or .htm, or for all texts."""
    if as_html is True:
        return strip_html(text)
    if path is None:
        return text
    return F.when(F.lower(path).rlike(r"\.html?$"), strip_html(text)).otherwise(text)


def fold_quotes(text: Column) -> Column:
    for curly, straight in zip("‘’“”", "''\"\""):
        text = F.replace(text, F.lit(curly), F.lit(straight))
    return text


def mask_code(text: Column) -> Column:
    """Closed fenced blocks, then inline code, become blanks; an unclosed fence stays text."""
    fenced = F.when(F.contains(text, F.lit("```")), masked(text, FENCED)).otherwise(text)
    return F.when(F.contains(text, F.lit("`")), masked(fenced, INLINE)).otherwise(text)


def prepared(text: Column) -> Column:
    """What phrase rules match against."""
    return mask_code(fold_quotes(F.coalesce(text, F.lit(""))))


def newlines(text: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
