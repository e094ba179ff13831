"""String expressions of the engine, built from Spark's own functions (no Python workers).

All take and give columns. A null argument gives null unless said otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that one token of text is taken to have.
CHARS_PER_TOKEN = 3.67
#: Extensions that name files, and those that also end the names of technologies.
FILE_EXTENSIONS = r"\.(md|markdown|py|ts|tsx|json|ya?ml|toml|sh|bash|zsh|txt|csv|tsv|pdf|docx?|xlsx?|pptx?|log|ini|cfg|conf|env|lock|sql|rs|go|rb|java)$"
SCRIPT_EXTENSIONS = r"\.(jsx?|mjs|cjs)$"
WORD = r"[\p{L}\p{N}_]"


def collapse(s: Column) -> Column:
    """White space trimmed and runs of it made one space."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def fold_case(s: Column) -> Column:
    """Lower case, with the one common letter whose folding is longer."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def entity_key(name: Column, kind: Column) -> Column:
    """``kind:name`` with the name case-folded and its white space collapsed."""
    return F.concat(kind, F.lit(":"), fold_case(collapse(name)))


def slugify(s: Column, longest: int = 60) -> Column:
    """ASCII letters and digits joined by hyphens, cut at a hyphen; ``untitled`` if nothing is left."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(whole, 1, longest)
    shorter = F.regexp_extract(head, "^(.+)-[^-]*$", 1)
    cut = F.when(F.length(whole) <= longest, whole).when(shorter != "", shorter).otherwise(head)
    return F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)


def title_slug(s: Column) -> Column:
    """The slug of a meeting's title: letters of any script stay."""
    kept = F.regexp_replace(fold_case(s), r"[^\p{L}\p{N}_\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "untitled").otherwise(slug)


def estimate_tokens(s: Column) -> Column:
    """Length over characters per token, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(s) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def tokens_to_chars(tokens: Column) -> Column:
    """The characters that so many tokens may take, cut off."""
    return F.floor(tokens * F.lit(CHARS_PER_TOKEN)).cast("int")


def paragraphs(s: Column) -> Column:
    """The parts between blank lines, trimmed, without empty ones."""
    trimmed = F.transform(F.split(s, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def concept_of_path(path: Column) -> Column:
    """The id of a document by its path within the bundle."""
    return F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"\.md$", "")


def utc_day(seconds: Column) -> Column:
    """The day of an instant in seconds since 1970, in the session's zone, which is UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def word_count(s: Column) -> Column:
    """Number of runs of characters that are no white space."""
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))


def query_terms(s: Column) -> Column:
    """Terms of a user's query: signs become spaces, terms of one character go; order, case and repetition stay."""
    return F.filter(F.split(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+"), lambda t: F.length(t) > 1)


def index_terms(s: Column) -> Column:
    """Terms of a text as the keyword index holds them: lower case, runs of letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def snippet(s: Column, width: int = 240) -> Column:
    flat = collapse(s)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("...")))


def is_substantive(s: Column) -> Column:
    """Whether three word characters remain without the lines of code fences; false for null."""
    bare = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?m)^\s*```[\w-]*\s*$", "")
    return F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}_]", "")) >= 3


def is_file_like(s: Column) -> Column:
    """Whether a name is that of a file or an address; a capitalised word before a script's extension is a technology."""
    n = F.trim(F.coalesce(s, F.lit("")))
    stem = F.regexp_replace(n, f"(?i){SCRIPT_EXTENSIONS}", "")
    technology = stem.rlike(r"^\p{Lu}[\p{L}\p{N}]*$")
    return n.rlike(r"(?i)^(https?://|www\.)") | n.rlike(f"(?i){FILE_EXTENSIONS}") | (n.rlike(f"(?i){SCRIPT_EXTENSIONS}") & ~technology)


def error_class(s: Column) -> Column:
    """An error without paths and numbers, its first part of at most 80 characters; ``unknown`` for null and empty."""
    first = F.element_at(F.split(s, r" \| "), 1)
    paths = F.regexp_replace(first, r"/[^\s'\"]*", "<path>")
    joined = F.regexp_replace(paths, r"\S*<path>\S*(?:\s+\S*<path>\S*)*", "<path>")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(F.substring(F.regexp_replace(joined, r"\d+", "N"), 1, 80))


def masked_finding(s: Column) -> Column:
    """A validator's message without what it quotes."""
    return F.regexp_replace(F.regexp_replace(s, "`[^`]*`", "`...`"), "nothing is at the link's target: .*", "broken link")


def directory(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*/", "")


def clean_id(s: Column) -> Column:
    """A concept id as a caller may write it: trimmed, without ``.md`` and outer slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"\.md$", ""), "^/+|/+$", "")


def file_uri(path: Column) -> Column:
    """``file://`` with the path percent-encoded."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def uri_path(uri: Column) -> Column:
    """The decoded path of a ``file://`` address; null for any other."""
    raw = F.replace(F.substring(uri, 8, 1 << 20), F.lit("+"), F.lit("%2B"))
    return F.when(F.startswith(uri, F.lit("file://")), F.try_url_decode(raw))


def markdown_links(body: Column) -> Column:
    """The targets of the markdown links of a text, in order."""
    return F.regexp_extract_all(body, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))


def sentences(s: Column) -> Column:
    """A text split after ``.``, ``!`` or ``?`` before white space and a capital or an opening mark."""
    return F.split(s, r"(?<=[.!?])\s+(?=[A-Z(\"'\[])")


def paragraphs(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def hard_cut(s: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter; none of an empty text."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))
    return F.when(F.length(s) > 0, pieces).otherwise(F.array().cast("array<string>"))


def date_prefix(s: Column) -> Column:
    """The date that an instant's text begins with; empty if it begins with none."""
    return F.when((F.length(s) >= 10) & (F.substring(s, 5, 1) == "-"), F.substring(s, 1, 10)).otherwise("")


def without_markup(html: Column) -> Column:
    """The text of an HTML page: comments, scripts, styles and tags cut, common entities decoded."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?(</\1\s*>|$)", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n"), r"(?s)<[^>]*>", " ")
    marks = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
    s = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), marks.items(), s)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t\x0B\f\r]+", " "), r"\s*\n\s*", "\n"))


def normal_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def replacement_share(s: Column) -> Column:
    """The share of characters that stand for undecodable bytes."""
    lost = F.length(s) - F.length(F.replace(s, F.lit("�"), F.lit("")))
    return F.when(F.length(s) > 0, lost / F.length(s)).otherwise(0.0)


def relevance_label(score: Column, weak: float = 0.2) -> Column:
    """``weak`` below the threshold, else the score as a whole percentage."""
    return F.when(score < weak, "weak").otherwise(F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%")))


def highlight(s: Column, query: str, stop: frozenset[str] = frozenset("and are but for from not the was with you".split())) -> Column:
    """The text, escaped for HTML, with the query's words of three letters and more in ``<mark>``; longer words first."""
    words = sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) >= 3 and w not in stop}, key=lambda w: (-len(w), w))
    safe = F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, rf"(?i)\b({'|'.join(words)})\b", "<mark>$1</mark>") if words else safe


def link_path(concept_id: Column) -> Column:
    """The link that leads to a concept from anywhere in the bundle."""
    return F.concat(F.lit("/"), concept_id, F.lit(".md"))


def mail_parts(s: Column) -> Column:
    """The parts of an address's local part, in lower case; empty for what is no address."""
    local = F.regexp_extract(F.trim(s), r"^([^@\s]+)@[^@\s]+\.[^@\s]+$", 1)
    return F.filter(F.split(F.lower(local), r"[^\p{L}\p{N}_]+"), lambda p: p != "")


def zoned_instant(s: Column) -> Column:
    """Whether a text is an ISO-8601 instant with a zone; false for null."""
    return F.coalesce(s.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(s).isNotNull(), F.lit(False))
