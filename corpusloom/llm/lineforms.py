"""The form of a line of text, and of a page made of such lines.

`line_form` tells prose from list entries, table rows and unreadable or machine
text by shape alone.  `page_form` adds up the lines of a page's body and applies
the combined rules that separate pages of prose from lists, tables and junk.
Both work on plain strings inside Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter

PROSE, HEADING, ENTRY, CELLS, JUNK, LABELS = "P", "H", "E", "C", "J", "L"

_BULLET = re.compile(r"(?:[*•·▪◦‣–—-]|\d{1,4}[.)]|[a-zA-Z][.)]|\[[ xX]?\]|\(\d+\))\s+\S")
_COUNTED = re.compile(r"\S.{0,60} \(\d+\)\Z")
_URL = re.compile(r"https?://\S+|\Awww\.\S+")
_MARKDOWN = re.compile(r"\[[^\]]+\]\(\S+\)|<a\s")
_TAGS = re.compile(r"(?:[#@][\w-]+\s*){2,}\Z")
_LOG = re.compile(r"(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d\S* (?:\[?[A-Z]+\]?|\S+=)")
_HEX = re.compile(r"[0-9a-fA-F]{6,}[: ]\s*(?:[0-9a-fA-F]{2,4} ?){4,}")
_CODE = re.compile(r"function ?\w*\(|=>|\bvar \w+ ?=|[;{}]\s*[;{}]|\w\(\w*\)\{|\breturn \w+[\[(;]")
_LONG_TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{48,}")
_REPEATED = re.compile(r"(\S)\1{6,}")
_SYMBOLS = str.maketrans("", "", "^|~_\\/`;:<>=#$%&*@{}[]+")
_ODD_INSIDE = re.compile(r"\S*?(?:\w[\^|~_\\/`;:!.,'*]+[^\W\d_]|(?<!\S)[\^|~_\\/`;:.,']+\w|[\^~_\\`|])\S*")
_WORDISH = re.compile(r"[^\W\d_]")
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûãõåæøœаеёиоуыэюя]", re.I)
_LEADER = re.compile(r"\.{4,}")
_WIDE = re.compile(r"\S {2,}(?=\S)")
_SENTENCE_END = re.compile(r"[.!?…][\"”“»’)\]]*\Z")
_NOT_PLAIN = re.compile(r"[|\t^~_\\{}\[\]<>=#$@;/`+*]|\.\.\.\.|  ")
_CELL_ROW = re.compile(r"\|(?: [^|]* \|){2,}\Z")
_SKU = re.compile(r"(?:SKU|Art\.?|Item|Ref\.?|No\.?)[ :#-]*\d{2,}")


def line_form(line: str) -> str:
    """Form of one stripped, non-blank line.

    `P` prose, `H` a short line without mark (a heading or a bare entry),
    `E` a list entry, `L` a line of several labels or links, `C` a row of
    cells, `J` unreadable or machine text.
    """
    n = len(line)
    if n >= 24 and _SENTENCE_END.search(line, n - 4) and not _NOT_PLAIN.search(line) and line.count(" ") >= 4 and not _BULLET.match(line):
        return PROSE
    words = line.split()
    nw = len(words)
    letters = len(_WORDISH.findall(line)) if n < 4000 else sum(map(str.isalpha, line))
    # --- cells
    if "\t" in line and nw >= 2:
        return CELLS
    if line[0] == "|" and _CELL_ROW.match(line):
        return CELLS
    if set(line) <= set("-+|= :"):
        return CELLS if n > 2 else HEADING
    if n >= 12 and _symbols(line, n, letters):
        return JUNK
    if _LEADER.search(line) and letters and not _REPEATED.search(line.replace(".", "")):
        return CELLS
    if _LOG.match(line) or _HEX.match(line):
        return JUNK
    if n > 24 and (_CODE.search(line) and sum(c in "(){}[];=" for c in line) > 0.08 * n):
        return JUNK
    if len(_WIDE.findall(line)) >= 2 and max(len(c) for c in re.split(r" {2,}", line)) <= 30 and letters < 0.95 * n:
        if not _symbolic(line, n, letters, words):
            return CELLS
    # --- unreadable
    if _symbolic(line, n, letters, words):
        return JUNK
    for sep in (";", ","):
        k = line.count(sep)
        if k >= 2 and not _SENTENCE_END.search(line):
            cells = line.split(sep)
            tight = sum(1 for c in cells[1:] if c[:1] != " ")
            if tight >= 0.8 * k and max(map(len, cells)) <= 40:
                return CELLS
    # --- entries and labels
    if _URL.search(line):
        rest = _URL.sub("", line).strip(" -–—:()[]|<>*•\t")
        if rest.count(" ") <= 10:
            return ENTRY
    if _MARKDOWN.search(line) and nw < 16:
        return ENTRY
    if _TAGS.match(line):
        return LABELS
    if _SKU.match(line):
        return ENTRY
    if _BULLET.match(line) and (nw <= 8 or not _SENTENCE_END.search(line)):
        return ENTRY
    if n < 80 and _COUNTED.match(line) and nw <= 7:
        return ENTRY
    for sep in (" | ", " > ", " / ", "; ", " · ", " • "):
        k = line.count(sep)
        if k >= 2 or (k and sep == " > "):
            if k and n / (k + 1) <= 45 and not (sep == "; " and _SENTENCE_END.search(line)):
                return LABELS
    k = line.count(", ")
    if k >= 3 and not _SENTENCE_END.search(line) and nw <= 1.7 * (k + 1):
        return LABELS
    # --- running text and headings
    if nw <= 4 and n <= 48:
        return PROSE if _SENTENCE_END.search(line) and nw >= 3 else HEADING
    if nw >= 5 and (_SENTENCE_END.search(line) or nw >= 7):
        return PROSE
    return HEADING


def _symbols(line: str, n: int, letters: int) -> bool:
    """Whether a line is made of signs rather than of letters and digits."""
    return letters < 0.35 * n and sum(map(str.isdigit, line)) < 0.3 * n and n - len(line.translate(_SYMBOLS)) > 0.2 * n


def _symbolic(line: str, n: int, letters: int, words: list[str]) -> bool:
    """Whether a line is unreadable: symbols, runs of one sign, encoded bytes,
    words with signs strewn in, or letters that form no words."""
    if _REPEATED.search(line) and not _LEADER.search(line):
        longest = max(len(m.group()) for m in _REPEATED.finditer(line))
        if longest >= 8 or longest > 0.3 * n:
            return True
    if n >= 48 and len(words) <= max(2, n // 40) and _LONG_TOKEN.search(line) and not _URL.search(line):
        return True
    if len(words) >= 3:
        if n - len(line.translate(_SYMBOLS)) > 0.04 * n and len(_ODD_INSIDE.findall(line)) >= max(3, 0.35 * len(words)) and not _URL.search(line) and " / " not in line and " | " not in line:
            return True
        long = [w for w in words if len(w) >= 4 and w.isalpha() and w.isascii()]
        if len(long) >= 2 and len(long) >= 0.4 * len(words):
            if sum(1 for w in long if not _VOWEL.search(w)) > 0.4 * len(long):
                return True
    return False


_TERM = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def dominance(terms: list[str], common: frozenset[str], top: int = 3) -> float:
    """Repetition by dominant terms: the share of the characters of all terms
    that repeats of the `top` most repeated terms cover, beyond their first
    occurrence.  Common words and those of one or two letters do not dominate."""
    total = sum(map(len, terms))
    repeats = sorted(((c - 1) * len(t) for t, c in Counter(terms).items() if c > 1 and len(t) > 2 and t not in common), reverse=True)
    return sum(repeats[:top]) / total if total else 0.0


#: Fixed thresholds of the combined rules of `page_form`.
MOST = 0.5  # share of the body's characters that decides its form
DOMINANT = 0.31  # coverage by dominant terms from which lines of bare terms are stuffing
DOMINANT_TERMS = 36  # terms of such lines below which nothing is called stuffing: on a line or two, terms come back by chance
SPARSE = 0.12  # share of common words below which a line consists of bare terms
TITLE_WORDS = 6.2  # mean words a line below which unmarked lines are entries, not sentences


def page_form(body: list[str], common: frozenset[str], repetition: bool = True) -> tuple[str, dict[str, float], list[str]]:
    """Form of a page by its stripped, non-blank body lines: `prose`, `list`,
    `table`, `junk`, `keywords` (stuffing, which counts as junk) or `empty`.

    The repetition of dominant terms decides first: lines without common words
    that make up most of the body, and in which a few terms come back throughout,
    are stuffing whatever their form.  Then the form with most characters counts.  Returns the form, the
    shares it was decided by, and the form of each line.  `common` are the common
    words of all languages, lower case; `repetition` false leaves that rule out.
    """
    if not body:
        return "empty", {}, []
    forms: list[str] = []
    chars: Counter[str] = Counter()
    count: Counter[str] = Counter()
    loose_words = loose_lines = bare_chars = n_words = n_common = 0
    bare: list[str] = []
    for line in body:
        form = line_form(line)
        forms.append(form)
        words = line.lower().split()
        shared = sum(map(common.__contains__, words))
        n_words += len(words)
        n_common += shared
        if shared < SPARSE * len(words) and form not in (ENTRY, CELLS, JUNK):
            terms = _TERM.findall(line.lower())
            if len(terms) >= 2 and sum(map(common.__contains__, terms)) < SPARSE * len(terms):
                bare += terms
                bare_chars += len(line)
        if form in (PROSE, HEADING) and not _SENTENCE_END.search(line):
            loose_lines += 1
            loose_words += line.count(" ") + 1
            if form == PROSE:
                form = "U"  # unmarked: a sentence without its point, or a long title
        chars[form] += len(line)
        count[form] += 1
    total = sum(chars.values())
    shares = {"dominance": dominance(bare, common), "bare": bare_chars / total, "common": n_common / n_words if n_words else 0.0, **{f: c / total for f, c in chars.items()}}
    if repetition and bare_chars > MOST * total and shares["dominance"] >= DOMINANT and len(bare) >= DOMINANT_TERMS:
        return "keywords", shares, forms
    entries = chars[ENTRY] + chars[LABELS]
    prose = chars[PROSE]
    marked = entries + chars[CELLS] + chars[JUNK] + prose
    unmarked = chars["U"] + chars[HEADING]
    # unmarked lines: entries when short on the mean and many, else sentences or headings
    if loose_lines >= 3 and loose_words / loose_lines < TITLE_WORDS and (unmarked > 0.5 * total or entries > prose):
        entries += unmarked
    elif chars["U"]:
        prose += unmarked
    elif unmarked and not marked:
        entries += unmarked if count[HEADING] >= 3 else 0
        prose += unmarked if count[HEADING] < 3 else 0
    best = max((prose, "prose"), (entries, "list"), (chars[CELLS], "table"), (chars[JUNK], "junk"))
    return best[1], shares, forms
