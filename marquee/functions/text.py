"""Text functions as Column expressions; Unicode normal forms, which Spark has
no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
#: A task holds the texts of so many rows at once as strings.
ROWS = 64


def by_row(f: Callable[[str], object], kind: T.DataType, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A function of a string as one of columns; null stays null. Arrow batches
    are worked on ROWS at a time, so that no batch of whole texts becomes strings."""

    @F.arrow_udf(kind)
    def run(c: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else f(x) for x in c.slice(a, ROWS).to_pylist()], arrow) for a in range(0, len(c), ROWS)]
        return pa.concat_arrays(parts or [pa.array([], arrow)])

    return run


def of_text(f: Callable[[str], str]) -> Callable[[Column], Column]:
    return by_row(f, T.StringType(), pa.string())


def collapse(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def folded(c: Column) -> Column:
    """Lower case with collapsed white space. Exact for text without letters
    whose case folding is longer than themselves, such as sharp s; for those
    see ``casefolded``."""
    return collapse(F.lower(c))


@of_text
def casefolded(x: str) -> str:
    return " ".join(x.casefold().split())


def beside_ascii(c: Column | str, plain: Column, other: Callable[[Column], Column]) -> Column:
    """``plain`` for texts of ASCII only, which have one normal form and are not
    sent to Python, ``other`` for the rest. ``c`` may be a name, as for Spark's
    own functions."""
    c = F.col(c) if isinstance(c, str) else c
    is_ascii = F.coalesce(~c.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.when(is_ascii, plain).otherwise(other(F.when(~is_ascii, c)))


@of_text
def composed(x: str) -> str:
    return " ".join(unicodedata.normalize("NFC", x).split())


def nfc_collapsed(c: Column) -> Column:
    """Normal form C, then collapsed white space."""
    return beside_ascii(c, F.trim(F.regexp_replace(c, r"[\x09-\x0D\x1C-\x20]+", " ")), composed)


RUN = "[a-z0-9]+"


@of_text
def decomposed(x: str) -> str:
    return " ".join(re.findall(RUN, unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()))


def ascii_tokens(c: Column) -> Column:
    """Compatibility decomposition, ASCII only, lower case, runs of letters and
    digits joined by blanks."""
    return beside_ascii(c, F.array_join(F.regexp_extract_all(F.lower(c), F.lit(RUN), 0), " "), decomposed)


@of_text
def letters_only(x: str) -> str:
    """Compatibility decomposition, case-folded, letters and digits only."""
    return "".join(k for k in unicodedata.normalize("NFKD", x).casefold() if k.isalnum())


def slug(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one hyphen, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("section"))


def clean_label(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def entity_id(uri: Column) -> Column:
    """Q-number at the end of an entity URI, else null."""
    return F.nullif(F.regexp_extract(uri, r"/(Q\d+)$", 1), F.lit(""))


def last_part(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\b[\w'-]+\b"), 0))


def without_markup(c: Column) -> Column:
    """HTML without comments, scripts, styles and tags; white space collapsed."""
    for pattern in ("(?s)<!--.*?-->", r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", "(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: What the scanner stops at, by name.
TOKENS = {
    "comment": r"<!--.*?-->",
    "open": r"\{\{",
    "close": r"\}\}",
    "link": r"\[\[",
    "unlink": r"\]\]",
    "outside": r"\[https?://[^\s\]]+\s+(?=[^\]]+\])",
    "bracket": r"\]",
    "quotes": r"'{2,5}",
    "line": r"<[bB][rR]\s*/?>",
    "tag": r"<[^>]+>",
}
SCAN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in TOKENS.items()), re.S)
#: Which opening a closing token ends.
ENDS = {"close": "open", "unlink": "link", "bracket": "outside"}


def readable(text: str) -> str:
    """Readable text of wiki markup, in one pass with a stack: comments and
    templates go, at any depth, links keep their labels, tags go but what they
    hold stays. Openings that nothing closes stay as they are written."""
    stack: list[tuple[str, str, list[str]]] = [("", "", [])]  # kind, as written, what it holds

    def end(kind: str) -> None:
        """Closes the innermost opening of this kind; those within stay."""
        while True:
            inner, written, held = stack.pop()
            if inner == kind:
                break
            stack[-1][2].extend([written, *held])
        if kind == "link":
            whole = "".join(held)
            label = whole.partition("|")[2] if "|" in whole.strip("|") else whole
            stack[-1][2].append(label)
        elif kind == "outside":
            stack[-1][2].extend(held)

    at = 0
    for m in SCAN.finditer(text):
        stack[-1][2].append(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if kind in ENDS.values():
            stack.append((kind, m[0], []))
        elif kind in ENDS:
            if any(x[0] == ENDS[kind] for x in stack):
                end(ENDS[kind])
            else:
                stack[-1][2].append(m[0])
        elif kind == "line":
            stack[-1][2].append(" ")
    stack[-1][2].append(text[at:])
    return " ".join("".join(x for _, written, held in stack for x in (written, *held)).split())


#: ``readable`` of a column.
without_wikitext = of_text(readable)


def citation_markers(c: Column) -> Column:
    """Names of the references in order, each once; nameless ones as inline."""
    pattern = r"""(?is)<ref(?:\s+name\s*=\s*["']?([^\s/>"']+)["']?)?[^>]*?(?:/>|>.*?</ref>)"""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.when(x == "", "inline").otherwise(x)))


def infobox_years(c: Column) -> Column:
    """Years 18xx to 20xx of the ``released`` line of an infobox, distinct."""
    line = F.regexp_extract(c, r"(?im)^\s*\|\s*released\s*=\s*(.*)$", 1)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(r"(?<!\d)(?:18|19|20)\d{2}(?!\d)"), 0), lambda y: y.cast("int"))))


def packs(sizes: list[int], limit: int) -> list[int]:
    """The pack of each piece: a pack takes pieces, a blank between them, as
    long as what it has and the next one stay within the limit."""
    out: list[int] = []
    pack = total = 0
    for n in sizes:
        if total and total + n > limit:
            pack, total = pack + 1, 0
        total += n + (total > 0)
        out.append(pack)
    return out


def paragraphs_packed(c: Column, limit: int = 1500) -> Column:
    """Paragraphs (separated by blank lines) joined up to ``limit`` readable
    characters; a paragraph is never split and empty ones go."""

    def packed(text: str) -> list[str]:
        sized = [(p.strip(), len(readable(p))) for p in re.split(r"\n\s*\n", text)]
        kept = [x for x in sized if x[1]]
        joined: dict[int, list[str]] = {}
        for (paragraph, _), k in zip(kept, packs([n for _, n in kept], limit), strict=True):
            joined.setdefault(k, []).append(paragraph)
        return ["\n\n".join(x) for x in joined.values()]

    return by_row(packed, T.ArrayType(T.StringType()), pa.list_(pa.string()))(c)


#: Fixed list: top-level sections that hold references only.
REFERENCE_SECTIONS = ("notes", "references", "external links", "see also", "bibliography", "works cited")
#: A line that is a heading: as many equals signs behind the name as before it.
HEADING = re.compile(r"(?m)^(?P<level>={2,6})[^\S\n]*(?P<name>[^\n]*?)[^\S\n]*(?P=level)[^\S\n]*$")


def outline(levels: list[int], names: list[str]) -> list[list[str]]:
    """The path of each heading: its name below the path of the nearest open
    heading of a smaller level. A heading whose level skips some below that one
    passes only its own name on to what is below itself."""
    stack: list[tuple[int, list[str]]] = []  # open headings: level, what they pass on
    out = []
    for level, name in zip(levels, names, strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        above, passed = stack[-1] if stack else (0, [])
        out.append([*passed, name])
        stack.append((level, out[-1] if above == level - 1 else [name]))
    return out


def slug_of(name: str) -> str:
    """``slug`` of one string."""
    return "-".join(re.findall("[a-z0-9]+", name.lower())) or "section"


@F.udtf(returnType="locator string, title string, content string, ordinal int")
class WikiSections:
    """Sections of a wiki page: the lead, then every headed section with the
    path of its heading (see outline). Reference sections and sections without
    readable text are left out."""

    def eval(self, text: str):
        if text is None:
            return
        heads = list(HEADING.finditer(text))
        names = [" ".join(m["name"].split()) for m in heads]
        paths = [["Lead"], *outline([len(m["level"]) for m in heads], names)]
        starts, ends = [0, *(m.end() for m in heads)], [*(m.start() for m in heads), len(text)]
        n = 0
        for path, a, b in zip(paths, starts, ends, strict=True):
            references = a > 0 and path[0].lower() in REFERENCE_SECTIONS
            if not references and readable(text[a:b]):
                yield "/".join(map(slug_of, path)), " / ".join(path), text[a:b], n
                n += 1
