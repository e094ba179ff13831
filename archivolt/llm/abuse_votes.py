"""Words freed of their disguises, and the lexicon and pattern voters on abusive content.

Texts are read a batch at a time: each text is cut into tokens and sentence ends,
each different token is freed of case, diacritics, look-alike letters, digits for
letters and masks once, and the voters are computed over arrays of word classes.
The lexicons are general ones of four languages; what they miss is left to the
classifier of :mod:`.abuse`.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np

from .names import LETTERS, deletions, edits

# Letters of other scripts that look Latin, digits and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухкмтвніјѕԁɡοαεικνρτυχ", "aeopcyxkmtbhijsdgoaeiknptux")
LEET = str.maketrans("0134578@$!€", "oieastbasie")
HIDDEN = re.compile("[​-‏‪-‮⁠-⁤﻿­️]|\x1b?\\[\\d+m")
_TOKENS = re.compile(r"\n|\r|[.!?…]+(?=\s)|[\w@$€*]+(?:![\w@$€*]+)*").findall
_ENDS = frozenset("\n\r.!?…")


def _lexicon(text: str) -> frozenset[str]:
    return frozenset(text.split())


# General lexicons in English, French, German and Spanish, without diacritics.
#: Words that insult whoever they are said to.
INSULTS = _lexicon(
    "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit halfwit nitwit dunce loser losers scumbag scumbags parasite parasites coward cowards clown bastard bastards bitch whore slut asshole assholes arsehole dickhead wanker douchebag cunt dumbass shithead motherfucker tosser maggot maggots lowlife twat prick jackass numbskull weasel "
    "abruti abrutie abrutis cretine debile connard connards connasse salaud salope ordure ordures raclure minable bouffon andouille enfoire pourriture "
    "trottel vollpfosten vollidiot depp schwachkopf dummkopf drecksack dreckskerl arschloch wichser hurensohn miststuck versager parasit abschaum feigling blodmann penner idioten spasti "
    "idiota idiotas imbecil imbeciles cretino estupido inutil cabron cabrones gilipollas escoria parasito payaso cobarde desgraciado capullo pendejo malnacido"
)
#: Words that belittle.
SLIGHTS = _lexicon("worthless pathetic filthy brainless useless disgusting miserable spineless wretched stupid dumb vile hirnlos hirnloser hirnlose nutzlos nutzloser nutzlose erbarmlich erbarmlicher erbarmliche dreckiger dreckige miserabler pauvre sale pitoyable degoutant stupide inutile asqueroso asquerosa maldito maldita patetico patetica blod bloder blode")
YOU = _lexicon("you your yours yourself yourselves u ur tu toi te ton ta tes vous votre vos dich dir dein deine deiner deinen deinem bist hast wirst warst kannst willst sollst musst ihr euch euer eres usted ustedes tus contigo ti vas")
DU = _lexicon("du")  # German for you, but a French article
PERSONS = _lexicon("you your u her him his she he me my i us we tu toi te ton ta moi je elle il dich dir dein mir ich mich sie er ihn ihr mi yo ti ella el tus")
#: Words of sexual acts and nakedness, and those that leave no doubt.
SEXUAL = _lexicon("undress undressed undressing naked nude nudes topless thighs underwear moan moaned moaning horny sex sexy orgasm porn porno cock pussy tits lick licked licking bed nackt nackte nackten nacktbild nacktbilder ausziehen kussen deshabiller deshabilla nu nue nus nues lecher caresser sexe sexo desnuda desnudo desnudas desnudos desvestir desvestirte besarte lamer tetas caliente ropa")
EXPLICIT = _lexicon("horny nudes orgasm porn porno cock pussy tits blowjob moaned tetas nacktbild nacktbilder fuck fucked fucking ficken gefickt baiser follar")
#: What groups of people are called, what those who hate them liken them to, and what they want done to them.
GROUPS = _lexicon("foreigners immigrants migrants refugees newcomers strangers outsiders natives people folk auslander fremde fremden zugezogene zugezogenen fluchtlinge migranten leute etrangers immigres refugies gens extranjeros inmigrantes forasteros refugiados gente")
DEHUMAN = _lexicon("vermin filth plague scum animals rats cockroaches liars thieves criminals subhuman breed vermine voleurs menteurs criminels cafards rats ungeziefer dreck diebe lugner verbrecher pack gesindel ratten plaga ladrones mentirosos criminales alimanas ratas escoria")
BLOOD = _lexicon("blood genes nature birth sang genes naissance natur blut gene geburt sangre genes nacimiento naturaleza")
EXPEL = _lexicon("driven expelled deported exterminated eradicated wiped crawled swamp enferme expulse chasse vertrieben ausgewiesen eingesperrt raus encerrarlos echarlos expulsarlos fuera humans human humains menschen humanos")
ARE = _lexicon("are were sont etaient sind waren son eran")
#: Violence and death, paying for something, and where somebody is to be found.
VIOLENT = _lexicon("kill hang drown shoot choke bleed burn beat smash break rot dead strangle hurt creve pends etouffe etouffes saigner tuer casser erstick erstickst verreck verrecke verrecken bluten hang toten brechen muerete muere ahorcate atragantes sangrar matar romper romperte")
REVENGE = _lexicon("regret suffer bleed sorry regretter payer saigner souffrir bereuen bussen bezahlen bluten lamentar pagar sangrar")
#: Mention of words rather than use, other senses, one's own feelings, kindness.
CITES = _lexicon("word words mot mots wort worter palabra palabras quote quotes quoted cites cited policy charte leitlinie richtlinie norma forbid forbids forbidden interdit verboten prohibe complaint statistics counts novel chapter roman novela capitulo film agencies mediation harassment delits delitos straftaten")
SELF = _lexicon("feel felt myself question frage pregunta apologies excuse")
THINGS = _lexicon("process host disk terminal server daemon firewall query abort clinic screening vaccine pest contract mandatory pflicht consent leaflet anatomy medical dose biology species colour paint wall beige")
KIND = _lexicon("welcome wonderful praise praised lobt grossartig merveilleux maravilloso thanks thank merci danke gracias helpful hilfe great")


def _phrases(text: str) -> frozenset[tuple[str, str]]:
    return frozenset(tuple(x.split()) for x in text.split("|"))


#: Set expressions by two words in a row: of contempt and hate, of knowing where somebody is, of sexual acts.
CONTEMPT = _phrases(
    "shut up|zip it|drop dead|dropped dead|waste of|make me|get lost|go hang|hang yourself|kill yourself|jump off|choke on|rot in|burn in|crawl back|wish you|hope you|nobody asked|people like|kind of|not people|not human|like rats|"
    "tais toi|ferme la|ferme ta|pends toi|espere que|de merde|va te|comme toi|halt das|das maul|die klappe|hang dich|wie du|cierra la|la boca|ojala te|nadie te|vete al|de mierda|como tu"
)
WHERE = _phrases("know where|sais ou|weiss wo|se donde")
INTERCOURSE = _phrases("had sex|have sex|having sex|sex with|tuvieron sexo|tener sexo|faire l|firent l|zog sich")
PHRASES = (CONTEMPT, WHERE, INTERCOURSE)

_CLASSES = (INSULTS, SLIGHTS, YOU, DU, PERSONS, SEXUAL, EXPLICIT, GROUPS, DEHUMAN, BLOOD, EXPEL, ARE, VIOLENT, REVENGE, CITES, SELF, THINGS, KIND)
_INSULT, _SLIGHT, _YOU, _DU, _PERSON, _SEXUAL, _EXPLICIT, _GROUP, _DEHUMAN, _BLOOD, _EXPEL, _ARE, _VIOLENT, _REVENGE, _CITE, _SELF, _THING, _KIND = (1 << i for i in range(len(_CLASSES)))
_DISGUISED, _SINGLE = 1 << len(_CLASSES), 1 << len(_CLASSES) + 1

#: The voters, and what each says where it says anything: 1 abusive, -1 not.
VOTERS = ("insult", "insult_you", "disguised", "slighted", "slight_you", "phrase", "violence", "threat", "sexual", "explicit", "likened", "expelled", "cites", "self", "things", "kind")
SAYS = (1,) * 12 + (-1,) * 4


def _squeeze(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


_SQUEEZED = {_squeeze(w): w for w in sorted(INSULTS)}
_MASKS: dict[tuple[str, str, int], str] = {(w[0], w[-1], len(w)): w for w in sorted(INSULTS) if len(w) >= 4}
_NEAR: dict[str, list[str]] = {}
for _w in sorted(INSULTS):
    if len(_w) >= 6:
        for _d in deletions(_w):
            _NEAR.setdefault(_d, []).append(_w)


def _slip(word: str) -> str | None:
    """The insult that a word drags out or misspells."""
    found = _SQUEEZED.get(_squeeze(word)) if re.search(r"(.)\1\1", word) else None
    if not found and len(word) >= 6:
        found = next((w for d in deletions(word) for w in _NEAR.get(d, ()) if edits(word, w, 1) <= 1 and not w.startswith(word) and not word.startswith(w)), None)
    return found


def plain_word(token: str) -> tuple[str, bool]:
    """A token without case, diacritics and disguises, and whether it is an insult in disguise."""
    s = token.lower()
    alike = False
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(LETTERS))
        s = "".join(c for c in s if not unicodedata.combining(c))
        latin = s.translate(LOOKALIKES)
        alike = latin != s and any("a" <= c <= "z" for c in s)
        s = latin
    if s in INSULTS:
        return s, alike
    core = s.strip("!") if "*" in s.strip("*!") else s.strip("!*")
    if "*" in core:
        m = re.fullmatch(r"([a-z])(\*{2,})([a-z])", core)
        word = _MASKS.get((m[1], m[3], len(core))) if m else None
        return (word, True) if word else (core.replace("*", ""), False)
    if any(c.isalpha() for c in core) and not core.isalpha():
        found = _SQUEEZED.get(_squeeze(core.translate(LEET)))
        return (found, True) if found else (core, False)
    found = _slip(core)
    return (found, True) if found else (core, False)


def word_hash(word: str) -> int:
    """A 64-bit number of a word."""
    raw = word.encode("utf-8", "replace")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of ordered pairs of hashed words."""
    with np.errstate(over="ignore"):
        z = first * _PAIR ^ (second >> np.uint64(7)) + second
        return z * np.uint64(0xBF58476D1CE4E5B9) ^ z >> np.uint64(29)


_PHRASE_KEYS = [np.unique(pair_hash(*(np.array([word_hash(p[i]) for p in sorted(phrases)], dtype=np.uint64) for i in (0, 1)))) for phrases in PHRASES]


@dataclass
class Sentences:
    """The sentences of a batch of texts. ``words``: hashed words, one sentence after the other;
    ``start``: where each begins; ``text``: the text of each; ``votes``: a bit for each voter that fires."""

    words: np.ndarray
    start: np.ndarray
    text: np.ndarray
    votes: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.words)))

    def keys(self) -> np.ndarray:
        """A number for each sentence: equal for sentences of equal words in equal order."""
        with np.errstate(over="ignore"):
            place = (np.arange(len(self.words)) - np.repeat(self.start, self.sizes)).astype(np.uint64)
            mixed = pair_hash(self.words, place * _PAIR + np.uint64(11))
            total = np.add.reduceat(mixed, self.start) if len(self.start) else mixed[:0]
            return pair_hash(total, self.sizes.astype(np.uint64)).astype(np.int64)


class Reader:
    """Reads texts into :class:`Sentences`; what a token means is kept, up to ``most`` different tokens at a time."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {"\n": 0}
        self.names, self.hashes, self.classes = ["\n"], [0], [0]

    def _learn(self, token: str) -> int:
        if token[0] in _ENDS:
            self.ids[token] = 0
            return 0
        word, hidden = plain_word(token)
        mask = sum(1 << i for i, c in enumerate(_CLASSES) if word in c)
        self.ids[token] = at = len(self.names)
        self.names.append(word)
        self.hashes.append(word_hash(word))
        self.classes.append(mask | _DISGUISED * hidden | _SINGLE * (len(token) == 1 and token.isalpha()))
        return at

    def _spaced(self, flat: np.ndarray) -> np.ndarray:
        """Closes insults that are spelt with gaps; other runs of single letters stay."""
        single = (np.array(self.classes, dtype=np.int64)[flat] & _SINGLE) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
        gone = np.zeros(len(flat), dtype=bool)
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s < 4:
                continue
            letters = "".join(self.names[i] for i in flat[s:e])
            # a lone letter before or after may be a word of its own
            for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
                found = _SQUEEZED.get(_squeeze(letters[a : len(letters) - b]))
                if found and e - s == len(letters):
                    token = f"{found[0]}{'*' * (len(found) - 2)}{found[-1]}"
                    flat[s + a] = at = self.ids.get(token, -1) if token in self.ids else self._learn(token)
                    self.names[at], self.hashes[at] = found, word_hash(found)
                    gone[s + a + 1 : e - b] = True
                    break
        return flat[~gone]

    def __call__(self, texts: list[str | None]) -> Sentences:
        if len(self.names) > self.most:
            self._clear()
        ids, get = [], self.ids.get
        bounds = [0]
        for text in texts:
            if text:
                s = text.lower()
                if not s.isascii():
                    s = unicodedata.normalize("NFKC", HIDDEN.sub("", s))
                elif "[" in s:
                    s = HIDDEN.sub("", s)
                tokens = _TOKENS(s)
                own = [get(t) for t in tokens]
                if None in own:
                    own = [self._learn(t) if i is None and t not in self.ids else self.ids[t] for t, i in zip(tokens, own)]
                ids += own
            ids.append(0)
            bounds.append(len(ids))
        flat = np.array(ids, dtype=np.int64)
        # the text of each token travels along while tokens are closed up
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        joint = self._spaced(flat)
        if len(joint) != len(flat):  # ends are never removed: count them to find the texts again
            owner = self._owners(flat, joint, owner)
        flat = joint
        classes, hashes = np.array(self.classes, dtype=np.int64)[flat], np.array(self.hashes, dtype=np.uint64)[flat]
        word = flat > 0
        sentence = np.cumsum(~word)[word]
        owner, classes, hashes = owner[word], classes[word], hashes[word]
        start = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, int)
        return Sentences(hashes, start, owner[start], _votes(classes, hashes, start))

    @staticmethod
    def _owners(flat: np.ndarray, joint: np.ndarray, owner: np.ndarray) -> np.ndarray:
        before = owner[flat == 0]
        return before[np.cumsum(joint == 0) - (joint == 0)]


def _votes(classes: np.ndarray, hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A bit for each voter that fires, for each sentence."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(classes))))

    def within(a: int, b: int, gap: int) -> np.ndarray:
        """Tokens of class ``a`` with one of class ``b`` at most ``gap`` words after them in the sentence."""
        out = np.zeros(len(classes), dtype=bool)
        for g in range(1, gap + 1):
            out[:-g] |= (classes[:-g] & a > 0) & (classes[g:] & b > 0) & (number[:-g] == number[g:])
        return out

    def near(a: int, b: int, gap: int) -> np.ndarray:
        return within(a, b, gap) | within(b, a, gap)

    keys = pair_hash(hashes[:-1], hashes[1:])
    inside = number[:-1] == number[1:]
    contempt, where, acts = (np.logical_or.reduceat(np.append(np.isin(keys, known) & inside, False), start) for known in _PHRASE_KEYS)
    seen = np.bitwise_or.reduceat(classes, start)
    token = lambda x: np.logical_or.reduceat(x, start)
    has = lambda c: seen & c > 0
    fires = (
        has(_INSULT),
        has(_INSULT) & has(_YOU) | token(within(_DU, _INSULT | _SLIGHT, 1)),
        has(_DISGUISED),
        token(within(_SLIGHT, _INSULT, 2)),
        token(near(_SLIGHT, _YOU, 3)),
        contempt & has(_YOU | _INSULT | _GROUP),
        token(near(_VIOLENT, _YOU, 3)),
        where & has(_REVENGE | _VIOLENT) | has(_REVENGE) & has(_VIOLENT),
        has(_SEXUAL) & has(_PERSON),
        has(_EXPLICIT) | acts,
        token(within(_ARE | _GROUP, _DEHUMAN, 5)),
        token(within(_ARE | _GROUP, _EXPEL, 5)) | has(_GROUP) & has(_BLOOD | _VIOLENT),
        has(_CITE),
        token(near(_SELF, _PERSON, 3)),
        has(_THING),
        has(_KIND),
    )
    return sum(f.astype(np.int64) << i for i, f in enumerate(fires))
