"""Lines of text as pages: which are furniture (running lines, page numbers) and which are body."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from .names import edits

# Characters that scanning takes for others, marks that break a word, and how page numbers are dressed.
DIGIT_LIKE = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9", "q": "9", "Z": "2", "z": "2", "b": "6", "G": "6"})
LETTER_LIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "|": "l", "(": "c", "6": "b"})
_LETTERS = re.compile(rf"(?:[^\W\d_]|[{re.escape(''.join(map(chr, LETTER_LIKE)))}])+")
BREAKS = "-­‐¬"
MARKER = re.compile(r"\s*<!--\s*page\s+(\d+)\s*-->\s*$|\f\s*$")
NUMBER = r"(?:\d{1,4}|[0-9lIOoSsBgqZzb|]{1,4})"
ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
DRESS = re.compile(rf"^[\W_]*(?:(page|p|pg|seite|s|blatt|folio)\b\.?\s*)?({NUMBER})(?:\s*(?:of|von|sur|de|/|\|)\s*({NUMBER}))?[\W_]*$", re.IGNORECASE)
TAIL = re.compile(rf"^(.*?\S)(?:\s*[-–—|·.,:/]+\s*|\s{{2,}}|\s+)(?:(?:page|p|pg|seite|s|blatt)\b\.?\s*)?({NUMBER})(?:\s*(?:of|von|/)\s*{NUMBER})?\W*$", re.IGNORECASE)
HEAD = re.compile(rf"^\W*(?:(?:page|p|pg|seite|s|blatt)\b\.?\s*)?({NUMBER})(?:\s*(?:of|von|/)\s*{NUMBER})?(?:\s*[-–—|·.:/]+\s*|\s{{2,}})(\S.*)$", re.IGNORECASE)


def roman_value(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    return sum(-values[a] if values[a] < values.get(b, 0) else values[a] for a, b in zip(text, text[1:] + " "))


def page_values(line: str) -> tuple[set[int], bool]:
    """The numbers that a line may hold alone, and whether it is dressed; none if it holds more than a number."""
    s = line.strip()
    bare = s.strip("-–—[](){}· ")
    values = set()
    if bare and ROMAN.match(bare):
        values.add(roman_value(bare))
    m = DRESS.match(s)
    if m and (s[-1] != "." or m[1]):
        raw = m[2].translate(DIGIT_LIKE)
        if raw.isdigit() and (re.search(r"\d", m[2]) or m[1] or m[3] or bare != s or m[2] in ("l", "I", "|")):
            values.add(int(raw))
    return values, bool(m and (m[1] or m[3])) or bare != s


def furniture_key(line: str) -> str:
    """A line without its page number, as it is compared between pages."""
    s = line.strip()
    for pattern, group in ((TAIL, 1), (HEAD, 2)):
        m = pattern.match(s)
        if m and re.search(r"[^\W\d_]{3}", m[group]):
            number = m[3 - group].translate(DIGIT_LIKE)
            if number.isdigit() and (re.search(r"\d", m[3 - group]) or len(m[3 - group]) == 1):
                s = m[group]
                break
    return re.sub(r"[\W_]+", " ", s.translate(LETTER_LIKE).lower()).strip()


def furniture_word(line: str) -> str:
    """The first word of a line, as it is counted to tell running lines from text that repeats."""
    m = _LETTERS.search(line)
    return m[0].translate(LETTER_LIKE).lower() if m else ""


def similar_keys(a: str, b: str) -> bool:
    """Keys that a misread character or two set apart."""
    most = max(1, min(3, len(a) // 8))
    return abs(len(a) - len(b)) <= most and min(len(a), len(b)) >= 6 and (a[:2] == b[:2] or a[-2:] == b[-2:]) and edits(a, b, most) <= most


class _Near:
    """Keys of running lines, to be looked up by a similar one; similar keys share two letters at the beginning or the end."""

    def __init__(self, pages: dict[str, set[int]]):
        self.pages = pages
        self.by_end: dict[tuple[int, str], list[str]] = defaultdict(list)
        for key in pages:
            self.by_end[0, key[:2]].append(key)
            self.by_end[1, key[-2:]].append(key)

    def elsewhere(self, key: str, page: int) -> bool:
        """Whether a key that is similar but not equal stands on another page."""
        most = max(1, min(3, len(key) // 8))
        seen = set()
        for other in (*self.by_end[0, key[:2]], *self.by_end[1, key[-2:]]):
            if other != key and other not in seen and abs(len(other) - len(key)) <= most:
                seen.add(other)
                if self.pages[other] - {page} and similar_keys(key, other):
                    return True
        return False


class AnyWord:
    """Before words are counted, every first word may begin a running line."""

    def __contains__(self, word: str) -> bool:
        return True


@dataclass
class Line:
    number: int
    text: str
    page: int
    kind: str  # marker, blank, running_line, page_number or body


#: Lines at the top and the bottom of a page that may be furniture.
EDGE = 3


def read_lines(text: str, heads=AnyWord(), edge: int = EDGE) -> list[Line]:
    """The lines of a text with their page and kind.

    Only the first and last ``edge`` lines of a page can be furniture. A page
    number must fit the others of the text (its distance to the page's place is
    that of another one, or it is the only one and dressed or small); a running
    line must be found on another page, but for its number and a misread
    character or two, and begin with a word of ``heads``. Texts without page
    markers have no furniture.
    """
    lines, page = [], 0
    for i, s in enumerate(text.split("\n"), 1):
        if MARKER.match(s):
            page += 1
            lines.append(Line(i, s, page, "marker"))
        else:
            lines.append(Line(i, s, page, "body" if s.strip() else "blank"))
    if not page:
        return lines
    pages: dict[int, list[Line]] = defaultdict(list)
    for x in lines:
        if x.kind == "body":
            pages[x.page].append(x)
    numbers: list[tuple[int, Line, set[int], bool]] = []
    for p, own in pages.items():
        for x in {id(y): y for y in own[:edge] + own[-edge:]}.values():
            values, dressed = page_values(x.text)
            if values:
                numbers.append((p, x, values, dressed))
    shifts = Counter(v - p for p, _, values, _ in numbers for v in values)
    for p, x, values, dressed in numbers:
        if dressed or any(shifts[v - p] > 1 for v in values) or (len(numbers) == 1 and min(values) < 1000):
            x.kind = "page_number"
    edges: dict[str, set[int]] = defaultdict(set)
    found: list[tuple[Line, str]] = []
    for p, own in pages.items():
        rest = [x for x in own if x.kind == "body"]
        for x in {id(y): y for y in rest[: edge - 1] + rest[1 - edge :]}.values():
            if not x.text.lstrip().startswith("#"):
                key = furniture_key(x.text)
                if re.search(r"[^\W\d_]{3}", key):
                    edges[key].add(p)
                    found.append((x, key))
    near = _Near(edges)
    for x, key in found:
        if furniture_word(x.text) in heads and (len(edges[key]) > 1 or near.elsewhere(key, x.page)):
            x.kind = "running_line"
    return lines
