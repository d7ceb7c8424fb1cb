"""Column functions on text. White space and word characters are those of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

_BLANK = r"[\s\x1c-\x1f]"
#: Stands for the space after an abbreviation while sentences are split.
_HELD = "\u0001"
#: Words after which a period ends no sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "vs", "al", "etc", "fig", "eq", "sec", "vol")
#: How a running header or footer begins.
RUNNING_LINES = (r"\d+$", r"page\s+\d+", r"\d+\s+of\s+\d+", r"(?:proceedings|journal|conference|vol\.|arxiv)", r"preprint", r"under review", r"\w+\s+et\s+al\.")
#: Typographic characters and what is written for them.
LETTERS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--"}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|(?<!{_BLANK}){_BLANK}+\z", "")


def is_running_line(line: Column) -> Column:
    """Whether a line looks like a page header or footer: not blank, at most 150 characters, and begins like one."""
    bare = strip(line)
    return (bare != "") & (F.length(bare) <= 150) & bare.rlike(rf"(?iU)\A(?:{'|'.join(RUNNING_LINES)})")


def without_running_lines(page: Column) -> Column:
    """A page without running lines among its first two and last two lines."""
    near_edge = lambda i, lines: (i < 2) | (i >= F.size(lines) - 2)
    return let(F.split(page, "\n", -1), lambda lines: F.array_join(F.filter(lines, lambda x, i: ~(near_edge(i, lines) & is_running_line(x))), "\n"))


def cleaned(text: Column) -> Column:
    """Words broken at line ends joined, runs of line breaks cut to two, ligatures and typographic marks spelled out, lone letters on a line dropped."""
    out = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    for mark, plain in LETTERS.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return strip(F.regexp_replace(out, r"\n[a-zA-Z]\n", "\n"))


def tokens(text: Column) -> Column:
    """Lower-case words and numbers (with decimals) of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*+"), F.lit(0)), lambda t: F.length(t) > 1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n", -1), strip), lambda p: p != "")


def sentences(text: Column, in_a_row: bool = True) -> Column:
    """Pieces that end with a period and white space, unless an abbreviation stands before it.

    in_a_row: also if that one comes right after another ("al. al. x" is one piece). If not, the white space after an
    abbreviation counts for that one only, so that of several in a row every second one ends its piece.
    """
    before = r"(?<!\S)" if in_a_row else r"\A|\s"
    held = F.regexp_replace(text, rf"(?iU)({before})({'|'.join(ABBREVIATIONS)})(\.*|\s+)\.\s+", f"$1$2$3.{_HELD}")
    end = lambda i, pieces: F.when(i < F.size(pieces) - 1, ".").otherwise("")
    whole = let(F.split(held, r"(?U)\.\s+", -1), lambda pieces: F.transform(pieces, lambda p, i: F.concat(strip(F.replace(p, F.lit(_HELD), F.lit(" "))), end(i, pieces))))
    return F.filter(whole, lambda s: s != "")


def title_of(text: Column) -> Column:
    """The first line of more than 10 characters that begins with no digit, or ''."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    return F.coalesce(F.get(F.filter(lines, lambda x: (F.length(x) > 10) & ~x.rlike(r"(?U)\A\d")), F.lit(0)), F.lit(""))
