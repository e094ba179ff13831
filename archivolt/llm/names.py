"""Reading and comparing the spellings of names: people, and things named by words."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Titles and degrees, letters that do not decompose, legal forms, common words of
# organisations, and short forms of given names.
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame herr frau mme mlle monsieur madame sr sra don dona doctor phd md jr junior senior esq mba msc bsc dds ii iii".split())
LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})
LEGAL = {
    "limited": "ltd", "ltd": "ltd", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc",
    "gmbh": "gmbh", "mbh": "gmbh", "ag": "ag", "sa": "sa", "kg": "kg", "ohg": "ohg", "bv": "bv", "nv": "nv", "spa": "spa", "srl": "srl", "sarl": "sarl", "sas": "sas", "oy": "oy", "ab": "ab", "pty": "pty", "gesellschaft": "gmbh",
}
BUSINESS = frozenset(
    "analytics architects association bank capital centre clinic college consulting council design development energy engineering finance foods foundation group harbour holdings hospital institute instruments insurance international "
    "investments laboratories library logistics management manufacturing media ministry museum office partners pharma printing properties publishing railways research robotics school services shipping software solutions "
    "studios systems technologies textiles trading transport university ventures works".split()
)
CONTRACTIONS = {"mfg": "manufacturing", "intl": "international", "mgmt": "management", "svcs": "services", "svc": "services", "labs": "laboratories", "bldg": "building", "dept": "department", "mkt": "marketing", "ctr": "centre"}
NICKNAMES = {
    "al": "albert alexander alfred", "alex": "alexander alexandra", "sasha": "alexander alexandra", "sandy": "alexander alexandra", "andy": "andrew andreas", "tony": "anthony antonio", "art": "arthur", "barb": "barbara", "ben": "benjamin",
    "benny": "benjamin", "bea": "beatrice", "bernie": "bernard", "bert": "albert robert", "bill": "william", "billy": "william", "will": "william", "willy": "wilhelm william", "willi": "wilhelm", "liam": "william", "bob": "robert", "bobby": "robert",
    "rob": "robert", "robbie": "robert", "cathy": "catherine katherine", "charlie": "charles charlotte", "chuck": "charles", "carl": "charles", "chris": "christopher christian christina", "kit": "christopher katherine", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david",
    "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "don": "donald", "dora": "theodora", "thea": "theodora", "theo": "theodora theodore", "ed": "edward edwin", "eddie": "edward",
    "ted": "edward theodore", "ned": "edward", "eliza": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "fran": "francisca frances francis", "frank": "francis franklin", "paca": "francisca", "paquita": "francisca", "fred": "frederick alfred", "freddy": "frederick", "freddie": "frederick",
    "gabi": "gabriela", "gaby": "gabriela", "gabby": "gabriela", "geoff": "geoffrey", "gus": "augustus gustav", "hank": "henry", "harry": "henry harold", "hans": "johannes", "jack": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer",
    "jess": "jessica", "jo": "josephine joanna", "josie": "josephine", "josy": "josephine", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "jonny": "jonathan", "johnny": "john", "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kay": "katherine", "ken": "kenneth", "larry": "lawrence lorenzo", "len": "leonard", "lenny": "leonard", "leo": "leonard leonardo", "lou": "louis louise",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret", "matt": "matthew", "max": "maximilian maxwell", "mike": "michael", "mick": "michael", "mickey": "michael", "mia": "maria", "nat": "nathaniel natalie", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "klaus": "nicholas", "claus": "nicholas", "pat": "patricia patrick", "patty": "patricia", "patti": "patricia", "tricia": "patricia", "trish": "patricia",
    "pete": "peter", "phil": "philip", "pina": "giuseppina", "giusy": "giuseppina", "giusi": "giuseppina", "ray": "raymond", "ron": "ronald", "ros": "rosalind", "roz": "rosalind", "rosie": "rosalind", "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel samantha", "mandy": "amanda", "stef": "stefan", "steffen": "stefan", "steve": "steven stefan", "sue": "susan susanna", "susie": "susan susanna", "susan": "susanna",
    "suzy": "susanna", "sanna": "susanna", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tori": "victoria", "vicky": "victoria", "vicki": "victoria", "vic": "victor victoria", "vik": "viktor", "uli": "ulrike ulrich", "ulli": "ulrike ulrich", "ulla": "ulrike", "wally": "walter", "zack": "zachary", "lex": "alexander", "ximmy": "ximena", "tamy": "tamara", "tammy": "tamara", "kat": "katherine",
}


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(LETTERS)) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most + 1`` if it is larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # only cells at most ``most`` off the diagonal can be on a short path
    far = most + 1
    size = len(b)
    before: list[int] = []
    last = [j if j <= most else far for j in range(size + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(size, i + most)
        row = [far] * (size + 1)
        row[0] = i if i <= most else far
        least = row[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            d = last[j - 1] + (x != y)
            if last[j] < d:
                d = last[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < d:
                d = before[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
        before, last = last, row
    return min(last[-1], far)


def deletions(word: str) -> set[str]:
    """The word and all it becomes with one letter less; words one edit apart share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def near_words(a: str, b: str) -> bool:
    """Spellings of one invented word: equal, one edit apart, or two in long words of one first letter."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 0 if short < 5 else 1 if short < 9 or a[0] != b[0] else 2
    return bool(most) and edits(a, b, most) <= most


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: its beginning, a fixed contraction, or four letters and more of it in order."""
    if len(short) >= len(word) or len(short) < 3 or short[0] != word[0]:
        return False
    if word.startswith(short) or CONTRACTIONS.get(short) == word:
        return True
    rest = iter(word)
    return len(short) >= 4 and all(c in rest for c in short) and not any(c in "aeiou" for c in short[2:-1])


#: How much more frequent a word must be than one that is a slip for it, and occurrences from which a word is established.
RATIO, ESTABLISHED = 4, 3


class Words:
    """What is known of words: how many names tell them (``weights``), the far more frequent word that one is a slip for (``slips``), and which are ``common``."""

    def __init__(self, weights: dict[str, int], slips: dict[str, str] | None = None, common: frozenset[str] | set[str] = frozenset()):
        self.weights, self.slips, self.common = weights, slips or {}, common

    def snap(self, word: str) -> str:
        """The far more frequent word that is one edit away, else the word."""
        return self.slips.get(word, word)

    def established(self, word: str) -> bool:
        return self.weights.get(word, 0) >= ESTABLISHED


def comparable(m: int, n: int) -> bool:
    """Whether words of ``m`` and ``n`` occurrences are both established and about as frequent, so that neither is a slip for the other."""
    m, n = sorted((m, n))
    return m >= ESTABLISHED and n < RATIO * m


@dataclass
class Name:
    """A read spelling. ``head``: surname, or the word that names a thing; ``words``:
    given name, or the words beside the head; ``weak``: too little to be linked but by being the only one."""

    head: str
    words: tuple[str, ...] = ()
    initial: str = ""
    middle: str = ""
    legal: str = ""
    weak: bool = False
    weights: tuple[int, ...] = ()

    @property
    def normal(self) -> str:
        return "|".join((self.head, " ".join(self.words), "" if self.words else self.initial, "weak" if self.weak else ""))


def person_tokens(name: str) -> list[str]:
    """The long words of a person's name, as they are counted: the given name first where a comma tells it."""
    before, _, after = _person_text(name)[0].partition(",")
    return [t for part in (after, before) for t in re.findall(r"[^\W\d_]+", part) if len(t) > 1 and t not in TITLES]


def _person_text(name: str) -> tuple[str, bool]:
    s = fold(name).strip()
    s = re.sub(r"\([^)]*\)", " ", s)
    if "@" in s:
        return re.sub(r"[._+\d-]+", " ", s.split("@")[0]).strip(), True
    return re.sub(r"\s[-–—|/]\s.*$", "", s), False


def read_person(name: str, words: Words) -> Name | None:
    """A person's name: title, degree, unit and diacritics cut, order found, given name freed of typing errors and nicknames."""
    text, mail = _person_text(name)
    before, comma, after = text.partition(",")
    parts = [[t for t in re.findall(r"[^\W\d_]+", p) if t not in TITLES] for p in (before, after)]
    if comma and parts[1] and parts[0]:
        family = [t for t in parts[0] if len(t) > 1]
        given = [t for t in parts[1] if len(t) > 1]
        singles = [t for t in parts[1] + parts[0] if len(t) == 1]
        if not family:
            return None
        head, given = "".join(family), given[:1]
    else:
        tokens = parts[0] + parts[1]
        longs, singles = [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]
        if not longs:
            return None
        if len(longs) == 1:
            head, given = longs[0], []
            if mail and not singles and len(head) > 4:
                singles, head = [head[0]], head[1:]
        else:
            snapped = [words.snap(t) for t in longs]
            score = [words.weights.get(s, 0) for s in snapped]
            first = max(range(len(longs)), key=lambda i: (score[i], -i)) if max(score) > 0 else 0
            if first not in (0, len(longs) - 1):
                first = 0
            given = [longs[first]]
            head = "".join(t for i, t in enumerate(longs) if i != first)
    if given:
        g = words.snap(given[0])
        full = tuple(NICKNAMES[g].split()) if g in NICKNAMES else (g,)
        if len(full) > 1:
            known = [f for f in full if words.established(f)]
            full = tuple(sorted(known or full))
        return Name(head, full, full[0][0], "".join(singles[:1]))
    return Name(head, (), singles[0] if singles else "", "".join(singles[1:2]), weak=True)


def thing_text(name: str) -> str:
    s = fold(name)
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?", lambda m: m[0].replace(".", ""), s)
    s = re.sub(r"(?:&|\band)\s*(?:co|company)\b\.?", " co ", s)
    return s


def thing_tokens(name: str) -> list[str]:
    """The words of a thing's name, as they are counted."""
    return [t for t in re.findall(r"[^\W\d_]+|\d+", thing_text(name)) if t not in LEGAL and t not in ("the", "and")]


@lru_cache(200_000)
def invented(word: str) -> bool:
    """Whether a word may be the name that tells a thing: long, and no business word, short form or slip of one."""
    return len(word) >= 5 and word not in BUSINESS and word not in CONTRACTIONS and not any(shortens(word, b) or abs(len(word) - len(b)) <= 1 and edits(word, b, 1) <= 1 for b in BUSINESS)


def suffixes(name: str) -> list[str]:
    """The words that a thing's name of one word may end in."""
    tokens = [t for t in re.findall(r"[^\W\d_]+|\d+", thing_text(name)) if t not in LEGAL and t not in ("the", "and")]
    return [t[c:] for t in tokens for c in range(4, len(t) - 3)] if len(tokens) <= 2 else []


def read_thing(name: str, kind: str, words: Words) -> Name | None:
    """The name of an organisation, project or system: legal form, articles and the kind's own word cut, typing errors in common words mended."""
    tokens = re.findall(r"[^\W\d_]+|\d+", thing_text(name))
    legal = "".join(LEGAL[t] for t in tokens if t in LEGAL)
    plain = [t for t in tokens if t not in LEGAL and t not in ("the", "and", kind, "project")]
    if not plain:
        plain = [t for t in tokens if t not in ("the", "and")]
    if not plain:
        return None
    common = lambda w: w in BUSINESS or w in words.common
    mended = []
    for t in plain:
        s = t if common(t) else words.snap(t)
        if s == t and not common(t) and len(t) >= 5:
            s = next((b for b in sorted(BUSINESS) if abs(len(b) - len(t)) <= 1 and edits(t, b, 1) <= 1), t)
        mended.append(s if common(s) else t)
    if len(mended) == 1 and not common(mended[0]):
        whole = mended[0]
        cuts = range(4, len(whole) - 3)
        tails = [(c, whole[c:]) for c in cuts if common(whole[c:])] or [(c, words.snap(whole[c:])) for c in cuts if len(whole) - c >= 5 and common(words.snap(whole[c:]))]
        tails = tails or [(c, whole[c:]) for c in cuts if len(whole) - c >= 5 and words.established(whole[c:])]
        if tails:
            mended = [whole[: tails[0][0]], tails[0][1]]
    rest = [i for i, t in enumerate(mended) if not common(t) and len(t) >= 5 and not any(shortens(t, b) for b in BUSINESS)]
    at = min(rest, key=lambda i: (words.weights.get(mended[i], 0), -len(mended[i]))) if rest else max(range(len(mended)), key=lambda i: (not common(mended[i]), len(mended[i]), -i))
    beside = []
    for i, t in enumerate(mended):
        if i != at:
            wide = [] if t in BUSINESS or kind != "organization" and t not in CONTRACTIONS else [CONTRACTIONS[t]] if t in CONTRACTIONS else [w for w in BUSINESS if len(t) >= 3 and w.startswith(t)]
            beside.append(wide[0] if len(wide) == 1 else t)
    letters = kind == "organization" and len(plain) == 1 and 3 <= len(plain[0]) <= 6 and not legal and not common(plain[0])
    return Name(mended[at], tuple(beside), legal=legal, weak=letters)


def same_word(a: str, b: str) -> bool:
    return a == b or near_words(a, b) or shortens(a, b) or shortens(b, a)


def same_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the words beside two heads are the same, in any order, or one is the other's acronym."""
    for x, y in ((a, b), (b, a)):
        if len(x) == 1 and len(y) > 1 and x[0] == "".join(w[0] for w in y):
            return True
    if len(a) != len(b):
        return False
    left = list(b)
    for w in sorted(a, key=lambda w: w not in left):
        hit = next((v for v in left if v == w), None) or next((v for v in left if same_word(w, v)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def same_person(a: Name, b: Name) -> bool:
    """Two full names of one person: near surnames, and given names that agree."""
    if not near_words(a.head, b.head):
        return False
    if set(a.words) & set(b.words):
        return True
    for x, m in zip(a.words, a.weights or (0,) * len(a.words)):
        for y, n in zip(b.words, b.weights or (0,) * len(b.words)):
            if min(len(x), len(y)) >= 4 and not comparable(m, n) and edits(x, y, 1) <= 1:
                return True
    return False


def same_thing(a: Name, b: Name) -> bool:
    """Two names of one thing: near heads and the same words beside them."""
    return near_words(a.head, b.head) and same_words(a.words, b.words)
