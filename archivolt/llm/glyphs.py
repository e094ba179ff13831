"""Misread characters: which words a strange word may have been before it was scanned."""

from __future__ import annotations

# What is seen -> what was printed, for single letters and for letters that run together.
CONFUSED = {
    "0": "oO", "1": "lit", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "bg", "9": "gq", "(": "c", ")": "j", "[": "l", "|": "li", "!": "li", "$": "s", "@": "a", "€": "e", "¢": "c", "{": "c", "<": "c",
    "a": "oäeu", "b": "hl6", "c": "eo", "d": "a", "e": "coa", "f": "t", "g": "qy9", "h": "bn", "i": "ljt", "j": "i", "k": "h", "l": "itf1", "m": "n", "n": "uhr", "o": "aecö", "p": "n", "q": "g", "r": "nt", "s": "ß5", "t": "flr", "u": "nvüo", "v": "yru",
    "w": "vu", "x": "k", "y": "vg", "z": "2", "ä": "a", "ö": "o", "ü": "u", "ß": "bs", "é": "e", "è": "e",
    "rn": "m", "vv": "w", "li": "h", "cl": "d", "ii": "uünH", "nn": "m", "ri": "n", "in": "m", "iii": "m", "ni": "m", "tl": "h", "lc": "k", "ln": "h", "ci": "a", "ol": "d", "fi": "h", "ft": "n", "uu": "w", "il": "ü", "1i": "h", "l1": "h", "ss": "ß", "lt": "h", "lo": "b", "ic": "k",
    "m": "rnn", "w": "v", "d": "ac", "h": "bn", "k": "hx",
}
JOINED = {"m": ("rn", "nn", "in"), "w": ("vv",), "h": ("li",), "d": ("cl",), "u": ("ii",), "n": ("ri",)}


#: Confusions a word may hold at most, and letters from which it may hold more than one.
CONFUSIONS, LONG = 2, 5


def _rules() -> dict[str, list[tuple[int, str]]]:
    """By the first letter seen: (letters seen, what was printed)."""
    out: dict[str, list[tuple[int, str]]] = {}
    for table in (CONFUSED, JOINED):
        for seen, printed in table.items():
            for meant in printed:
                out.setdefault(seen[0], []).append((len(seen), seen, meant))
    return {c: [(n, seen, meant) for n, seen, meant in sorted(set(rules))] for c, rules in out.items()}


_BY_FIRST = _rules()


def first_letters(word: str) -> set[str]:
    """The letters that a word seen as ``word`` may begin with."""
    return {word[:1], *(meant[0] for _, seen, meant in _BY_FIRST.get(word[:1], ()) if word.startswith(seen))}


class Trie:
    """Words, to be looked up by what scanning made of them."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def readings(self, word: str, most: int | None = None) -> dict[str, int]:
        """The words that may have been printed where ``word`` was read, with the least number of confusions; not the word itself."""
        most = (CONFUSIONS if len(word) >= LONG else 1) if most is None else most
        out: dict[str, int] = {}
        stack = [(self.root, 0, 0)]
        size = len(word)
        while stack:
            node, at, cost = stack.pop()
            if at == size:
                found = node.get("")
                if found is not None and cost and cost < out.get(found, most + 1):
                    out[found] = cost
                continue
            same = node.get(word[at])
            if same is not None:
                stack.append((same, at + 1, cost))
            if cost < most:
                for n, seen, meant in _BY_FIRST.get(word[at], ()):
                    if n == 1 or word.startswith(seen, at):
                        to = node
                        for c in meant:
                            to = to.get(c)
                            if to is None:
                                break
                        else:
                            stack.append((to, at + n, cost + 1))
        out.pop(word, None)
        return out
