"""Rules for Czech prose: masks, sentences, words, syllables, readability and untranslated English.

Plain versions, one text at a time, of what `paperflow.functions.prose` does with columns.
Offsets are code points, ends exclusive. A null text is the empty text."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import regex

MASK = "￼"
ECHO_CHARS = 8

# Abbreviations, months, prefixes, function words, endings, thresholds.
ABBREVIATIONS = frozenset(
    """tj. tzv. tzn. atd. apod. např. mj. resp. popř. event. cca. cca č. čís. str. s. obr. tab. kap. odd. sv. roč. vyd. zn. hod. min. sek. mld. mil. tis.
    st. stol. n.l. př.n.l. viz srov. angl. lat. dr. ing. mgr. bc. mudr. rndr. phdr. judr. prof. doc. ph.d. csc. drsc. m.j. tel. ul. nám.""".split()
)
MONTHS = frozenset(
    """ledna února března dubna května června července srpna září října listopadu prosince
    leden únor březen duben květen červen červenec srpen říjen listopad prosinec""".split()
)
PREFIXES = "přes roz bez pod nad pro ne na za do po vy ob od".split()
VOWELS = "aáeéěiíoóuúůyý"
AUXILIARIES = "je jsou byl byla bylo byli byly bude budou bývá bývají".split()
PARTICIPLE_ENDINGS = "án ána áno áni ány en ena eno eni eny ěn ěna ěno ěni ěny nut nuta nuto nuti nuty t ta to ti ty".split()
NOT_PARTICIPLES = frozenset("to ta ty ti tu sto sta kdy nikdy jen ven den plen len sen sten ten teď".split())
REFLEXIVE_ENDINGS = "uje ují á ají í aly ala alo ily ila ilo".split()
AMBIGUOUS = frozenset("a i o u v s k z to ten ta no on do by be my se si za pro pod nad".split())
ENGLISH_WORDS = frozenset(
    """the an and or but of in at to for with without from as into over under between among about after before during through per both each other some any all
    is are was were been being has have had does did this that these those it its they them their we our you your he she his her which who whom whose when where
    while than then there here not can could may might will would should must more most less also however therefore because if so such very just only what how
    why every another""".split()
)
CZECH_WORDS = frozenset(
    """ale nebo že jsou jsem jsme jste byl byla bylo byly byli být není nebyl nebyla na od po při před ve ke ze jako který která které kteří kterou kterého když
    protože aby tedy také však ještě už jen více méně mezi podle kolem díky tento tato toto tyto tomu této těchto jejich jeho její oni ony nás jim jej ji mu
    jsemli nikoli velmi právě zatímco proto tam tady kde jak proč každý další jiný stejný takže""".split()
)
CZECH_ENDINGS = "ých ém ému ost ostí ovat ování ání ení ěji ější ových ovým ám ami ách ku ce ci".split()
ENGLISH_ENDINGS = "ing tion tions ment ments ness ity ities ously edly ally ical ized ised ization".split()

ENGLISH_LIMITS = {"min_tokens": 5, "english_hard": 0.25, "czech_hard": 0.08, "max_czech_words": 1, "mixed_min_tokens": 8, "mixed_warn": 0.3, "run_tokens": 6, "run_english_words": 2}
#: rule: metric, warn, hard, and whether the bad side lies below. A null hard limit never fails.
READABILITY = {
    "R1": ("mean_sentence_words", 16, 20, False), "R2": ("longest_sentence_words", 25, 34, False), "R3": ("long_sentences", 1, 3, False), "R4": ("mean_syllables", 2.6, 2.9, False),
    "R5": ("share_4_syllables", 0.25, 0.35, False), "R6": ("share_5_syllables", 0.06, 0.1, False), "R7": ("passive_share", 0.2, 0.35, False),
    "reflexive_passive": ("reflexive_share", 0.3, None, False), "R9": ("composite", 50, 40, True),
}
LONG_SENTENCE_WORDS = 30


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(map(regex.escape, words)) + ")"


END_RUN = regex.compile(r"[.!?…]+")
STARTS_NEXT = regex.compile(r"\s+[\p{Lu}\p{N}„\"“”‚‘»«']|\s*\Z")
NEXT_WORD = regex.compile(r"\s*(\p{L}+)")
SHORT_DATE = regex.compile(r"\p{N}{1,2}\.\s?\p{N}{1,2}\.")
WORD_BEFORE = regex.compile(r"[\p{L}\p{N}.]*\Z")
DIGITS_BEFORE, NUMBER_BEFORE, NUMBER_AFTER = regex.compile(r"\p{N}{1,4}\Z"), regex.compile(r"\p{N}\s*\Z"), regex.compile(r"\s*\p{N}")
INITIAL_BEFORE = regex.compile(r"(?:\A|[^\p{L}])\p{Lu}\Z")
LINE_BREAKS, A_LETTER, NO_LETTER, DIPHTHONG = regex.compile(r"\n+"), regex.compile(r"\p{L}"), regex.compile(r"\P{L}+"), regex.compile("ou|au|eu")
LETTERS = regex.compile(r"[\p{L}'’]+")
COUNTABLE = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*")
GUARDED_PREFIX = regex.compile(_any(sorted(PREFIXES, key=len, reverse=True)) + f"(?=[{VOWELS}])")
NUCLEI = regex.compile(f"[{VOWELS}#]")
SYLLABIC = regex.compile(f"(?<=[^{VOWELS}#])(?:[rl](?![{VOWELS}#])|m\\Z)")
PASSIVE = regex.compile(rf"(?<!\p{{L}}){_any(AUXILIARIES)}(?!\p{{L}})\s+(?:\p{{L}}+\s+){{0,2}}(\p{{L}}*{_any(PARTICIPLE_ENDINGS)})(?!\p{{L}})")
REFLEXIVE = regex.compile(rf"(?<!\p{{L}})se(?!\p{{L}})\s+\p{{L}}+?{_any(REFLEXIVE_ENDINGS)}(?!\p{{L}})")
CZECH_ENDING, ENGLISH_ENDING = regex.compile(_any(CZECH_ENDINGS) + r"\Z"), regex.compile(_any(ENGLISH_ENDINGS) + r"\Z")
CZECH_MARK = regex.compile("[áčďéěíňóřšťúůýž]", regex.I)
# What is masked.
MASKS = {
    "url": regex.compile(r"https?://\S+"), "doi": regex.compile(r"10\.\d{4,9}/\S+"), "paren": regex.compile(r"\([^()]{0,200}\)"),
    "number": regex.compile(r"(?<![\p{L}\p{N}])[−–-]?\p{N}[\p{N}\s.,]*[%‰×]?(?![\p{L}\p{N}])"),
}


def lower_same_length(text: str) -> str:
    """Lower case, letter by letter, leaving those whose lower form has another length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def echoes(text: str, title: str) -> list[tuple[int, int]]:
    """Spans of `text` that repeat ECHO_CHARS or more characters of the title: the longest first, then what follows it."""
    low, source, at, out = lower_same_length(text), lower_same_length(unicodedata.normalize("NFC", title)), 0, []
    while len(low) - at >= ECHO_CHARS:
        m = SequenceMatcher(None, source, low[at:], autojunk=False).find_longest_match()
        if m.size < ECHO_CHARS:
            break
        out.append((at + m.b, at + m.b + m.size))
        at = out[-1][1]
    return out


def mask(text: str | None, kinds: tuple[str, ...] = ("url", "doi"), title: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """`text` with spans of the kinds, and of the title's echoes, overwritten by MASK at the same length; the spans by place.

    The order is url, doi, paren, echo, number; what one has masked the next leaves alone."""
    out, spans = text or "", []

    def hide(kind: str, found: list[tuple[int, int]]) -> None:
        nonlocal out
        for a, b in found:
            out = out[:a] + MASK * (b - a) + out[b:]
            spans.append((kind, a, b))

    for kind in ("url", "doi", "paren", "echo", "number"):
        if kind == "echo":
            if title and len(title) >= ECHO_CHARS:
                hide(kind, echoes(out, title))
        elif kind in kinds:
            hide(kind, [m.span() for m in MASKS[kind].finditer(out) if MASK not in m[0]])
    return out, sorted(spans, key=lambda s: s[1])


def _ends_sentence(text: str, a: int, b: int) -> bool:
    if not STARTS_NEXT.match(text, b):
        return False
    before = text[max(0, a - 16) : a]
    word = lower_same_length(WORD_BEFORE.search(before)[0])
    if word in ABBREVIATIONS or word + text[a:b] in ABBREVIATIONS:
        return False
    if text[a:b] != ".":
        return True
    near, digits = before[-8:], DIGITS_BEFORE.search(before)
    if NUMBER_BEFORE.search(near) and NUMBER_AFTER.match(text[b : b + 8]):
        return False
    if digits:
        following = NEXT_WORD.match(text, b)
        if not following or not following[1][0].isupper() or lower_same_length(following[1]) in MONTHS or SHORT_DATE.match(text, a - len(digits[0])):
            return False
    return not INITIAL_BEFORE.search(before)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences, trimmed. A line break ends one; abbreviations, ordinals, dates, decimals and initials don't."""
    text = text or ""
    cuts = {m.end() for m in END_RUN.finditer(text) if _ends_sentence(text, *m.span())} | {m.end() for m in LINE_BREAKS.finditer(text)} | {len(text)}
    out, at = [], 0
    for cut in sorted(cuts):
        piece = text[at:cut]
        body = piece.strip()
        if body:
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, a + len(body)))
        at = cut
    return out


@lru_cache(maxsize=100_000)
def syllables(word: str) -> int:
    """Czech syllables: vowel nuclei, diphthongs as one unless a prefix ends inside, syllabic r, l and final m; at least 1."""
    w = NO_LETTER.sub("", lower_same_length(unicodedata.normalize("NFC", word)))
    if not w:
        return 0
    m = GUARDED_PREFIX.match(w)
    cut = m.end() if m else 0
    body = "".join(DIPHTHONG.sub("#", part) for part in (w[:cut], w[cut:]))
    return max(1, len(NUCLEI.findall(body)) + len(SYLLABIC.findall(body)))


def passive(sentence: str) -> bool:
    for m in PASSIVE.finditer(sentence):
        word = m[1].lower()
        if len(word) >= 5 and word not in NOT_PARTICIPLES and not word.endswith(("ost", "ostí")):
            return True
    return False


def readability(text: str | None, long_words: int = LONG_SENTENCE_WORDS) -> dict[str, float]:
    """Counts, means and shares of a text; all zero (composite 150) if it has no sentence."""
    text = text or ""
    parts = [text[a:b] for a, b in sentences(text)]
    lengths = [len(COUNTABLE.findall(p)) for p in parts]
    counts = [syllables(w) for w in COUNTABLE.findall(text) if A_LETTER.search(w)]
    share = lambda n, of: n / of if of else 0.0
    mean_words, mean_syllables = share(sum(lengths), len(parts)), share(sum(counts), len(counts))
    return {
        "n_sentences": len(parts), "n_words": sum(lengths), "mean_sentence_words": mean_words, "longest_sentence_words": max(lengths, default=0),
        "long_sentences": sum(n > long_words for n in lengths), "mean_syllables": mean_syllables,
        "share_4_syllables": share(sum(c >= 4 for c in counts), len(counts)), "share_5_syllables": share(sum(c >= 5 for c in counts), len(counts)),
        "passive_share": share(sum(map(passive, parts)), len(parts)), "reflexive_share": share(sum(bool(REFLEXIVE.search(p)) for p in parts), len(parts)),
        "composite": 100 - (2.0 * mean_words + 25 * (mean_syllables - 2.0)),
    }


@dataclass(frozen=True)
class Evidence:
    """What one sentence says about its language."""

    tokens: int
    czech_words: int
    marked: int
    english: float
    czech: float


def evidence(sentence: str) -> Evidence:
    words = LETTERS.findall(lower_same_length(sentence))
    clear = [w for w in words if w not in AMBIGUOUS]
    marked, n = sum(bool(CZECH_MARK.search(w)) for w in words), max(len(words), 1)
    czech_words = sum(w in CZECH_WORDS for w in clear)
    english = sum(w in ENGLISH_WORDS for w in clear) + 0.5 * sum(bool(ENGLISH_ENDING.search(w)) and not CZECH_MARK.search(w) for w in clear)
    czech = czech_words + marked + 0.5 * sum(bool(CZECH_ENDING.search(w)) for w in clear)
    return Evidence(len(words), czech_words, marked, english / n, czech / n)


def english_findings(text: str | None, title: str | None = None, limits: dict[str, float] = ENGLISH_LIMITS) -> list[tuple[str, str, int, int]]:
    """(rule, severity, start, end): echoes of the title, sentences left in English, mixed ones, and long English runs."""
    hidden, spans = mask(text, ("url", "doi", "paren", "number"), title)
    found = [("title_echo", "warn", a, b) for kind, a, b in spans if kind == "echo"]
    for a, b in sentences(hidden):
        e = evidence(hidden[a:b])
        if e.tokens >= limits["min_tokens"] and e.english >= limits["english_hard"] and e.czech <= limits["czech_hard"] and not e.marked and e.czech_words <= limits["max_czech_words"]:
            found.append(("untranslated", "hard", a, b))
        elif e.tokens >= limits["mixed_min_tokens"] and e.english >= limits["mixed_warn"] and e.marked:
            found.append(("mixed", "warn", a, b))
    low, run, islands = lower_same_length(hidden), [], []
    for m in LETTERS.finditer(low):
        plain = m[0].isascii()
        if run and (not plain or MASK in low[run[-1].end() : m.start()]):
            islands.append(run)
            run = []
        if plain:
            run.append(m)
    for run in [*islands, run]:
        if len(run) >= limits["run_tokens"] and sum(m[0] in ENGLISH_WORDS and m[0] not in AMBIGUOUS for m in run) >= limits["run_english_words"]:
            found.append(("run", "hard", run[0].start(), run[-1].end()))
    return sorted(found, key=lambda f: f[2])
