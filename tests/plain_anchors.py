"""A plain version, one text at a time and by tokens, of `paperflow.functions.anchors`."""

from __future__ import annotations

from dataclasses import dataclass

import plain_prose as prose
import regex

# Units, words of quantity, periods, counted nouns, months, anchoring phrases and limits. A trailing * stands for any ending.
UNIT_SIGNS = "% ‰ ×".split()
UNIT_WORDS = "x krát procent* promile milion* miliard* tisíc* bod*".split()
ALWAYS_UNITS = "% ‰ × x krát procent* promile".split()
FRACTIONS = "dvojnásob* trojnásob* polovin* třetin* čtvrtin* pětin* desetin*".split()
PERIODS = "let letý leté letých letém měsíc* týdn* týden dní dnů dnech hodin* minut* sekund*".split()
COUNTED = """lidí osob* účastník* pacient* studentů dětí domácností škol* zvířat myší včel vzorků domů provinci* zemí měst* obcí stát* region* nemocnic* úmrtí
    případ*""".split()
MONTHS = "ledna února března dubna května června července srpna září října listopadu prosince".split()
PHRASES = [
    "v praxi to znamená", "prakticky to znamená", "je to zhruba jako", "jinými slovy", "pro představu", "představte si", "což znamená", "to znamená", "pro srovnání",
    "zaokrouhleno", "podobně jako", "odpovídá to", "na každých", "z každých", "u každého", "je to jako", "přibližně", "neboli", "zhruba", "řádově", "což je", "čili", "tedy",
    "to je", "asi", "tj", "jeden z", "dva z", "každ* * z", "z deseti", "z dvaceti", "z padesáti", "z sta", "z stovky", "z tisíce", "než",
]
RATES = ["na sto*", "na tisíc*", "na deset*", "na dvacet*", "na padesát*", "na milion*"]
ANCHOR_WORDS, PAREN_WORDS, PAREN_CHARS, LOOKAHEAD = 3, 4, 200, 1

TOKEN = regex.compile(r"(?P<digits>\p{N}+)|(?P<word>\p{L}+)|(?P<sign>[^\p{N}\p{L}])")
BLANKS, GROUPING, DECIMAL, MINUS = frozenset("   \t\n"), frozenset("   ."), frozenset(".,"), frozenset("−–-")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Number:
    start: int
    end: int
    unit: str = ""
    spelled: bool = False


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup or "", m[0], *m.span()) for m in TOKEN.finditer(prose.lower_same_length(text))]


def among(word: str, listed: list[str]) -> bool:
    return any(word.startswith(x[:-1]) if x.endswith("*") else word == x for x in listed)


class Reader:
    """Looks at the tokens of a text by their numbers; beyond either end there is an empty sign."""

    def __init__(self, text: str):
        self.line = tokens(text)

    def at(self, n: int) -> Token:
        return self.line[n] if 0 <= n < len(self.line) else Token("sign", "", -1, -1)

    def past_blank(self, n: int) -> int:
        return n + (self.at(n).text in BLANKS)

    def unit_at(self, n: int) -> int:
        """How many tokens of a unit stand at n."""
        here = self.at(n)
        if here.text in UNIT_SIGNS or (here.kind == "word" and among(here.text, UNIT_WORDS)):
            return 1
        if here.text == "p" and self.at(n + 1).text == ".":
            last = self.past_blank(n + 2)
            return last + 2 - n if self.at(last).text == "b" and self.at(last + 1).text == "." else 0
        return 0

    def numerals(self) -> list[Number]:
        """Numbers in digits. A run of more than three digits is a year or a code, and so are digits that touch letters; groups of three join."""
        out, n = [], 0
        while n < len(self.line):
            here = self.at(n)
            if here.kind != "digits":
                n += 1
                continue
            last = n
            if len(here.text) <= 3:
                while self.at(last + 1).text in GROUPING and self.at(last + 2).kind == "digits" and len(self.at(last + 2).text) == 3:
                    last += 2
            if self.at(last + 1).text in DECIMAL and self.at(last + 2).kind == "digits":
                last += 2
            place = self.past_blank(last + 1)
            wide = self.unit_at(place)
            if wide and self.at(place + wide).kind in ("word", "digits"):
                wide = 0
            end = place + wide - 1 if wide else last
            free = len(here.text) <= 3 and self.at(n - 1).kind != "word" and self.at(end + 1).kind not in ("word", "digits")
            if free:
                start = n - (self.at(n - 1).text in MINUS and self.at(n - 2).kind == "sign")
                out.append(Number(self.at(start).start, self.at(end).end, "".join(self.at(k).text for k in range(place, place + wide))))
            n = end + 1
        return out

    def dates(self) -> list[tuple[int, int]]:
        """Spans of a day with the name of its month, or with month and year in digits."""
        out = []
        for n, t in enumerate(self.line):
            if t.kind == "digits" and len(t.text) <= 2 and self.at(n + 1).text == ".":
                month = self.past_blank(n + 2)
                year = self.past_blank(month + 2)
                if self.at(month).text in MONTHS:
                    out.append((t.start, self.at(month).end))
                elif self.at(month).kind == "digits" and self.at(month + 1).text == "." and self.at(year).kind == "digits" and len(self.at(year).text) == 4:
                    out.append((t.start, self.at(year).end))
        return out

    def words(self, start: int, end: int) -> list[Token]:
        return [t for t in self.line if t.kind != "sign" and start <= t.start and t.end <= end]


def phrase_end(words: list[Token], phrase: str) -> int | None:
    """Where the first occurrence of a phrase ends, by words."""
    parts = phrase.split()
    for k in range(len(words) - len(parts) + 1):
        if all(p == "*" or among(w.text, [p]) for p, w in zip(parts, words[k:], strict=False)):
            return words[k + len(parts) - 1].end
    return None


def enough(text: str, least: int) -> bool:
    return len(prose.COUNTABLE.findall(text)) >= least


def tangible(scope: str) -> bool:
    """Whether a stretch of text relates a number to something: a phrase with enough words after it, or a rate."""
    words = Reader(scope).words(0, len(scope))
    if any(phrase_end(words, r) is not None for r in RATES):
        return True
    ends = (phrase_end(words, p) for p in PHRASES)
    return any(end is not None and enough(scope[end:], ANCHOR_WORDS) for end in ends)


def explained_beside(tail: str) -> bool:
    """Whether what follows a number opens with a bracket of enough words, or has a dash with enough words after it."""
    opening = tail.lstrip()
    if opening.startswith("(") and len(tail) - len(opening) <= 2:
        inside, closed, _ = opening[1:].partition(")")
        if closed and "(" not in inside and len(inside) <= PAREN_CHARS and enough(inside, PAREN_WORDS):
            return True
    dash = min((k for k in (tail.find("—"), tail.find("–")) if k >= 0), default=-1)
    return dash >= 0 and enough(tail[dash + 1 :], ANCHOR_WORDS)


def severity(read: Reader, text: str, number: Number, sentence: int, dates: list[tuple[int, int]]) -> str | None:
    """hard, or warn for the size of a sample; null for dates, ages, durations, temperatures, and fractions that restate a number.

    sentence: where the sentence with the number begins."""
    if number.spelled:
        before = text[sentence : number.start]
        words = Reader(before).words(0, len(before))
        restates = any(w.kind == "digits" for w in words) and any(phrase_end(words, p) is not None for p in PHRASES)
        return None if restates else "hard"
    if number.unit and (among(number.unit, ALWAYS_UNITS) or number.unit.startswith("p.")):
        return "hard"
    after = next((k for k, t in enumerate(read.line) if t.start >= number.end), len(read.line))
    following = read.at(read.past_blank(after))
    if any(a <= number.start and number.end <= b for a, b in dates):
        return None
    if following.kind == "word" and among(following.text, PERIODS):
        return None
    if following.text == "°" and read.at(read.past_blank(read.past_blank(after) + 1)).text == "c":
        return None
    at, words = read.past_blank(after), 0
    while words < 3 and read.at(at).kind == "word":
        if among(read.at(at).text, COUNTED):
            return "warn"
        at, words = at + 1, words + 1
        if read.at(at).text not in BLANKS:
            break
        while read.at(at).text in BLANKS:
            at += 1
    return "hard"


def numbers(text: str) -> list[Number]:
    """Numbers in digits and fractions in words, outside addresses and DOIs."""
    read = Reader(prose.mask(text)[0])
    spelled = [Number(t.start, t.end, spelled=True) for t in read.line if t.kind == "word" and among(t.text, FRACTIONS)]
    return sorted([*read.numerals(), *spelled], key=lambda x: (x.start, x.end))


def unanchored(text: str | None) -> list[tuple[str, int, int]]:
    """(severity, start, end) of the numbers that neither their sentence, after them, nor the next makes tangible."""
    text = text or ""
    if not regex.search(r"\p{N}|(?i)násob|polovin|tin", text):
        return []
    read, spans, out, now = Reader(text), prose.sentences(text), [], 0
    dates = read.dates()
    for number in numbers(text):
        while now < len(spans) and spans[now][1] <= number.start:
            now += 1
        inside = now < len(spans) and spans[now][0] <= number.start
        level = severity(read, text, number, spans[now][0] if inside else number.start, dates)
        if level is None:
            continue
        if inside:
            tail = text[number.end : spans[now][1]]
            if explained_beside(tail) or any(tangible(s) for s in (tail, *(text[a:b] for a, b in spans[now + 1 : now + 1 + LOOKAHEAD]))):
                continue
        out.append((level, number.start, number.end))
    return out
