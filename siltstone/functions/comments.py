"""Comments of script files, whose block comments run over lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted string up to its end or the line's, a line comment, a block comment, or what lies between. Together
#: they cover a content. Repetitions are possessive, so long strings need no deep stack.
PIECE = r""""(?:\\[^\n]|[^"\\\n])*+"?|'(?:\\[^\n]|[^'\\\n])*+'?|`(?:\\[^\n]|[^`\\\n])*+`?|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|[^"'`/]++|/"""


def stripped_content(content: Column) -> Column:
    """What lies outside comments; of a block comment its line feeds stay, so lines keep their numbers.

    A quote ends with its line, a block comment doesn't. Contents without a comment sign stay as they are."""
    feeds = lambda p: F.repeat(F.lit("\n"), F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    kept = F.transform(F.regexp_extract_all(content, F.lit(PIECE), F.lit(0)), lambda p: F.when(p.startswith("//"), "").when(p.startswith("/*"), feeds(p)).otherwise(p))
    return F.when(content.contains("//") | content.contains("/*"), F.array_join(kept, "")).otherwise(content)
