"""Personal data in free text: a skip-chain conditional random field.

Spans that might be personal data are over-generated by their mere look: every group of digits, everything around
an @, every street name and post box, every pair of capitalised words.  Most of them are none (dates, part and version numbers,
firms, places).  The spans of a record are the nodes of a field, their tokens sharing one label.  Successive spans of a line
share a potential, and so do successive occurrences of the same or a similar token (equal but for case; an initial and the
name it may stand for) anywhere in the record, so that what is recognised once is recognised throughout.  Loopy message passing
over chain and skip edges gives the beliefs; a span becomes an entity if a kind is believed rather than none.

No feature names the form that produced a span.  The features are the span's shape (lengths of its groups, separators), what
words are in the collection (followed by many family names, standing after initials, ending the names of firms; counted over all
rows) and the words around.  Labels come from ``CUES`` in the words around some of the spans.  A first fit sees only
the spans' own features, so that shape has to explain what the cues say; what it is sure of labels the rest, and the second fit
sees the words around too, and the edges.  Weights are fitted by pseudo-likelihood on at most ``FIT_RECORDS`` rows, drawn by
chance; every record is searched as a whole.

Defined results: null and empty texts give nothing and stay as they are; an entity found twice in a
place is one row; overlapping spans are settled for the longer one, then the earlier; rows sent twice
are searched each; a kind that the fitting rows never show is believed where its strict form stands; empty tables give nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

FIT_RECORDS = 5000
SENT = 1 << 18
SWEEPS, DAMPING = 6, 0.3
SLOTS = 1 << 14
#: Belief from which the first fit labels a span for the second.
SURE = 0.8
#: Different words before a word that never follows an initial, for it to end names of firms or places; most of them stand before no other word.
TYPE_FIRSTS = 5
KINDS = ("none", "email", "phone", "id_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: What a span of each look may be.
LOOKS = ("at", "number", "place", "name")
ALLOWED = np.array([[1, 1, 0, 0, 0, 0], [1, 0, 1, 1, 0, 0], [1, 0, 0, 0, 1, 0], [1, 0, 0, 0, 0, 1]], bool)
#: Words that end the names of firms, places and undertakings (general ones; more are learned).
DESIGNATORS = frozenset(
    "Trust Energy Institute Holding Holdings Union Group Partners Works Systems Labs Inc Ltd LLC PLC Corp Corporation Company GmbH AG SA University College Bank Foundation Association Society Council Agency Commission"
    " Bay Harbour Valley Beach Road Lane Drive Sq Square Avenue Walk Close Court Street Hill Box Project".split()
)
_ROADS = r"Road|Lane|Drive|Sq\.|Square|Avenue|Walk|Close|Court|Street|St\.|Way|Row|Place|Terrace|Crescent|Gardens|Rd\b|Ave\b|Blvd\b|Ln\b"
_CAP = r"\p{Lu}[\p{L}'-]*"
_STREET = rf"(?:{_CAP} ){{1,3}}(?:{_ROADS})"
_FRENCH = rf"(?:rue|avenue|boulevard|place|chemin|quai) (?:de la |des |du |de |d')?{_CAP}"
_GERMAN = r"\p{Lu}\p{L}*(?:weg|straße|strasse|gasse|platz|allee|ring)"
_WATERS = "Bay|Harbour|Valley|Beach|Springs|Falls|Hills|Heights"
_ORG = "|".join(sorted(DESIGNATORS - {"Bay", "Harbour", "Valley", "Beach"}))
_TOWN = rf"{_CAP}(?: (?:{_WATERS})\b)?(?! (?:{_ORG})\b)"
#: Strict forms: they only say where a span begins and ends.
FORMS = {
    "email": regex.compile(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*(?:@| ?[\[({<] ?at ?[\])}>] ?)[\p{L}\p{N}-]+(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?)[\p{L}\p{N}-]+)*(?:\.| ?[\[({<] ?dot ?[\])}>] ?)\p{L}{2,}(?![\p{L}\p{N}])", regex.I),
    "phone": regex.compile(
        r"(?<![\p{L}\p{N}.+-])(?:(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{2,5}){2,5}|\(\d{2,4}\) ?\d{3}[ -]\d{4}|\d{3}/\d{3} ?\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|0\d(?:[ .]\d\d){4}|\d{10})(?![\p{L}\p{N}]|[./-]\d)"
    ),
    "id_number": regex.compile(
        r"(?<![\p{L}\p{N}./-])(?<!\d )(?:\d{3}-\d\d-\d{4}|\d{9}|\p{Lu}\d{8,9}|\p{Lu}{2} ?\d\d ?\d\d ?\d\d ?\p{Lu}|\d \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{3}\.\d{3}\.\d{3}-\d\d)(?![\p{L}\p{N}]|[./-]\d| \d)"
    ),
    "address": regex.compile(
        rf"(?<![\p{{L}}\p{{N}}])(?:\d+ ?[a-z]? (?:{_STREET}|{_FRENCH}|{_GERMAN})|(?:{_STREET}|{_FRENCH}|{_GERMAN}) \d+[a-z]?\b|P\.? ?O\.? ?Box \d+|Postfach \d+|BP \d+)"
        rf"(?:, (?:Apt\.?|Unit|Flat|Suite) ?#?\w+)?(?:,? \d{{4,5}} {_TOWN}|, {_TOWN}(?:,? \d{{4,5}}\b)?)?"
    ),
}
#: Whatever has the look, where no strict form fits.
LOOSE = {
    "at": regex.compile(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?"),
    "number": regex.compile(r"(?<![\p{L}\p{N}.+/-])(?:\p{Lu}{1,2} ?)?[+(]?\d(?:[ ./()-]{0,2}\d){4,}(?: ?\p{Lu}\b)?(?![\p{L}\p{N}])"),
    "place": regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_STREET}|{_FRENCH}|{_GERMAN})(?![\p{{L}}\p{{N}}])"),
}
_LOOK_OF = {"email": "at", "phone": "number", "id_number": "number", "address": "place"}
_UPPER = r"\p{Lu}{2,}(?:-\p{Lu}{2,})*"
_TITLE = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
PAIR = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'@_-])(?:({_TITLE}) ({_TITLE})|({_UPPER}) ({_UPPER}))(?![\p{{L}}\p{{N}}@_])")
TURNED = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'@_-])(?:({_TITLE}), ({_TITLE})|({_UPPER}), ({_UPPER}))(?![\p{{L}}\p{{N}}@_])")
INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'@_-])(?<!\p{{L}}\.)(\p{{Lu}})\. ({_TITLE}|{_UPPER})(?![\p{{L}}\p{{N}}@_])")
TURNED_INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'@_-])({_TITLE}|{_UPPER}), (\p{{Lu}})\.(?![\p{{L}}\p{{N}}])")
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Mme Mlle Herr Frau".split())
_LOWER = regex.compile(r"(?<![\p{L}\p{N}.@_-])\p{Ll}{2,}(?![\p{L}\p{N}@_]|[.-]\p{L})")
_INSIDE = regex.compile(r"[\p{Ll},;:(-] ?$")
_WORD = regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
#: What the words just before a span say of it, by look: (pattern, kind).
CUES = {
    "at": [(regex.compile(r"(?i)(?:mailto:|e-?mail:?|reached at|write to|<) *$"), "email"), (regex.compile(r"(?i)\b(?:package|version|module|handle) *$"), "none")],
    "number": [
        (regex.compile(r"(?i)(?:\b(?:phone|tel|fax|mobile|téléphone|telefon|cell|dial|call|back on)\b[.:]? *|\btel:)$"), "phone"),
        (regex.compile(r"(?i)\b(?:passport|social (?:security )?number|ssn|document no\.?|\(id|identity (?:card|number)|your number|personalausweis|passeport)[.:]? *$"), "id_number"),
        (regex.compile(r"(?i)(?:\b(?:part|invoice|version|order|figure|chapter|item|build|ref(?:erence)?|coordinates|article|costs?|from|since|dated|ran|ordered|sold|bought|paid|counted|delivered|about|over)\b(?: (?:no|number|nr)\b)?[.:#]*|\b(?:part|item|order) no\.) *$"), "none"),
    ],
    "place": [(regex.compile(r"(?i)\b(?:address:?|lives at|resides at|moved from|delivered to|wohnhaft in|demeurant au?) *$"), "address"), (regex.compile(r"(?i)\b(?:chapter \d+,|near|the|at the) *$"), "none")],
    "name": [(regex.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? $|(?i:\b(?:attention|applicant:|statement of|signed by|born to|belongs to)) $"), "person"), (regex.compile(r"(?i)\b(?:in|near|at|from|into|towards) $"), "none")],
}
_ADDRESSED = regex.compile(r"(?i)^ ?(?:project|records|group)\b")


def name_evidence(texts: list[str]) -> set[tuple[str, str, str]]:
    """(word, kind, other): ``pair`` with the word that follows, ``family`` of words after initials and in turned names, ``inside``: a first word where no sentence begins, ``common``: in small letters."""
    out: set[tuple[str, str, str]] = set()
    for text in texts:
        out.update((w.title(), "common", "") for w in _LOWER.findall(text))
        for m in PAIR.finditer(text, overlapped=True):
            if m[1] and "-" not in m[1]:
                out.add((m[1], "pair", m[2]))
                if _INSIDE.search(text[max(0, m.start() - 2) : m.start()]) or (m.start() == 0 and m.end() == len(text)):
                    out.add((m[1], "inside", ""))
        for form, g in ((INITIAL, 2), (TURNED_INITIAL, 1)):
            out.update((m[g], "family", "") for m in form.finditer(text) if not m[g].isupper())
        for form, given, family in ((PAIR, (1, 3), (2, 4)), (TURNED, (2, 4), (1, 3))):
            # a text that is a pair and nothing else names something
            if (m := form.fullmatch(text)) and "-" not in (name := (m[given[0]] or m[given[1]]).title()):
                last = (m[family[0]] or m[family[1]]).title()
                out.update([(name, "pair", last), (name, "pair", ""), (name, "inside", "")])
                if form is TURNED:
                    out.add((last, "family", ""))
    return out


@dataclass(frozen=True)
class Words:
    """What words are in the whole collection: given names, family names seen as such, words that end names of firms and places, first words of sentences."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    types: frozenset[str] = DESIGNATORS
    openers: frozenset[str] = frozenset()  # words that begin sentences


def learn_words(texts: list[str], least: int = 2) -> Words:
    """Given names are capitalised words followed by ``least`` or more different words that end no firm, and more often by those than by the others."""
    kinds: dict[str, Counter[str]] = defaultdict(Counter)
    follow: dict[str, set[str]] = defaultdict(set)
    for word, kind, other in name_evidence(texts):
        kinds[word][kind] += 1
        if kind == "pair":
            follow[word].add(other)
    firsts: dict[str, list[bool]] = defaultdict(list)
    for w, after in follow.items():
        for other in after - {""}:
            firsts[other].append(len(after) == 1)
    types = DESIGNATORS | {w for w, alone in firsts.items() if len(alone) >= TYPE_FIRSTS and 2 * sum(alone) > len(alone) and not kinds[w]["family"]}
    given, openers = set(), set()
    for w, after in follow.items():
        if len(after) >= TYPE_FIRSTS and (kinds[w]["common"] or not kinds[w]["inside"]):
            openers.add(w)
        firm = len(after & types)
        if len(after) - firm >= least and len(after) - firm > firm and kinds[w]["inside"] and not kinds[w]["common"] and w not in TITLES:
            given.add(w)
    return Words(frozenset(given), frozenset(w for w, c in kinds.items() if c["family"] and w not in types), frozenset(types), frozenset(openers))


def spans(text: str, words: Words) -> list[tuple[int, int, int, int]]:
    """(start, end, look, strict kind or 0) of spans that don't overlap; forms with evidence go before mere looks, then the longer."""
    found: list[tuple[int, int, int, int, int]] = []  # rank, start, end, look, strict
    for kind, form in FORMS.items():
        found += [(0, m.start(), m.end(), LOOKS.index(_LOOK_OF[kind]), KINDS.index(kind)) for m in form.finditer(text)]
    for look, form in LOOSE.items():
        found += [(2, m.start(), m.end(), LOOKS.index(look), 0) for m in form.finditer(text)]
    name, person = LOOKS.index("name"), KINDS.index("person")
    for m in PAIR.finditer(text, overlapped=True):
        first, second = (m[1], m[2]) if m[1] else (m[3].title(), m[4].title())
        known = first in words.given and second not in words.types
        found.append((0 if known else 1 if second in words.family else 2, m.start(), m.end(), name, person if known else 0))
    for m in TURNED.finditer(text, overlapped=True):
        first, second = ((m[1], m[2]) if m[1] else (m[3].title(), m[4].title()))
        follows = regex.match(r" (\p{Lu}\p{Ll}+)", text, pos=m.end())
        known = second in words.given and first not in words.types and not (follows and follows[1] not in words.types)
        found.append((0 if known else 2, m.start(), m.end(), name, person if known else 0))
    for form, g in ((INITIAL, 2), (TURNED_INITIAL, 1)):
        found += [(0 if m[g].title() not in words.types else 2, m.start(), m.end(), name, person if m[g].title() not in words.types else 0) for m in form.finditer(text)]
    found.sort(key=lambda s: (s[0], s[1] - s[2], s[1], s[3]))
    kept: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(text) + 1, bool) if len(found) > 12 else None
    for _, s, e, look, strict in found:
        if taken is not None:
            if taken[s:e].any():
                continue
            taken[s:e] = True
        elif any(s < k[1] and e > k[0] for k in kept):
            continue
        kept.append((s, e, look, strict))
    return sorted(kept)


@dataclass
class Nodes:
    """Spans of a block of records with the edges between them."""

    own: list[list[int]] = field(default_factory=list)
    around: list[list[int]] = field(default_factory=list)
    look: list[int] = field(default_factory=list)
    strict: list[int] = field(default_factory=list)
    cue: list[int] = field(default_factory=list)  # -1: the words around say nothing
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    where: list[tuple[int, int, int]] = field(default_factory=list)  # text, start, end


def _slot(*parts: object) -> int:
    return xxhash.xxh32_intdigest("\x1f".join(map(str, parts))) % SLOTS


def _shape(w: str) -> str:
    return "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in w)


def _in_capitals(text: str, s: int, e: int) -> bool:
    """Words in capitals with more of them beside, without a break between."""
    return regex.search(r"\p{Lu}{2,},? $", text[max(0, s - 20) : s]) is not None or regex.match(r",? \p{Lu}{2,}\b", text[e : e + 20]) is not None


def _own_features(found: str, look: int, after: str, words: Words, capitals: bool = False) -> list[int]:
    """Six features of a span's own form and words."""
    name = LOOKS[look]
    if name == "number":
        groups = [len(g) for g in regex.findall(r"\d+", found)]
        marks = "".join(sorted(set(regex.sub(r"[\p{L}\d]", "", found))))
        lead = "X" if found[0].isupper() else found[0] if found[0] in "+(" else "00" if found.startswith("00") else "0" if found[0] == "0" else "9"
        ends = f"{lead}{'X' if found[-1].isupper() else ''}"
        return [_slot("n-shape", _shape(found)), _slot("n-groups", ends, groups), _slot("n-digits", sum(groups), len(groups) > 1), _slot("n-marks", ends, marks), _slot("n-lead", ends), _slot("n-bias")]
    if name == "at":
        domain = regex.split(r"@|[\[({<] ?at ?[\])}>]", found, flags=regex.I)[-1].strip()
        end = regex.split(r"\.|[\[({<] ?dot ?[\])}>]", domain, flags=regex.I)
        tld = end[-1].strip()
        return [_slot("a-tld", tld.lower() if tld.isalpha() else _shape(tld)), _slot("a-alpha", tld.isalpha(), len(end) > 1), _slot("a-form", "@" in found), _slot("a-parts", len(end)), _slot("a-digits", any(c.isdigit() for c in domain)), _slot("a-bias")]
    if name == "place":
        number = regex.search(r"^\d|\p{L} \d|[. ]\d+$", found) is not None
        road = regex.search(r"(?i)\b(box|postfach|bp|rue|avenue|boulevard|place|chemin|quai)\b|(weg|stra(?:ß|ss)e|gasse|platz|allee|ring)\b|(\w+\.?)(?= \d|,|$)", found)
        return [_slot("p-number", number), _slot("p-town", "," in found, number), _slot("p-postcode", regex.search(r"\b\d{4,5}\b", found) is not None), _slot("p-road", (road[0] if road else "").lower(), number), _slot("p-next", bool(_ADDRESSED.match(after))), _slot("p-bias")]
    turned, initial = "," in found, "." in found
    w = [x.title() for x in regex.findall(r"\p{L}[\p{L}'-]*", found)][:2]
    first, last = (w[1], w[0]) if turned and len(w) > 1 else (w[0], w[-1])
    g = "initial" if initial else "given" if first in words.given else "type" if first in words.types else "title" if first in TITLES else "opener" if first in words.openers else "other"
    f = "type" if last in words.types else "family" if last in words.family else "given" if last in words.given else "opener" if last in words.openers else "other"
    goes_on = regex.match(r" \p{Lu}\p{Ll}", after) is not None
    return [_slot("w-both", g, f), _slot("w-form", g, turned, initial), _slot("w-all", g, f, turned, initial, found.isupper()), _slot("w-on", g, turned, goes_on), _slot("w-capitals", g, capitals and found.isupper()), _slot("w-last", f)]


def _around_features(text: str, s: int, e: int, look: int) -> list[int]:
    """Four features of the words around."""
    before = [_shape(w) if w[0].isdigit() else w.lower() for w in _WORD.findall(text[max(0, s - 40) : s])][-2:]
    after = [_shape(w) if w[0].isdigit() else w.lower() for w in _WORD.findall(text[e : e + 24])][:1]
    one, two = (before[-1] if before else "<"), " ".join(before)
    nxt = after[0] if after else ">"
    return [_slot(look, "b1", one), _slot(look, "b2", two), _slot(look, "a1", nxt), _slot(look, "ba", one, nxt)]


def _cue(text: str, s: int, look: int) -> int:
    before = text[max(0, s - 40) : s]
    for form, kind in CUES[LOOKS[look]]:
        if form.search(before):
            return KINDS.index(kind)
    return -1


def add_record(nodes: Nodes, texts: list[str], first_text: int, words: Words) -> None:
    last: dict[tuple[int, str], int] = {}
    initials: dict[str, int] = {}
    for number, text in enumerate(texts):
        found = spans(text, words) if text else []
        held = -1
        for k, (s, e, look, strict) in enumerate(found):
            at = len(nodes.own)
            piece = text[s:e]
            capitals = LOOKS[look] == "name" and piece.isupper() and _in_capitals(text, s, e)
            nodes.own.append(_own_features(piece, look, text[e : e + 24], words, capitals))
            nodes.around.append(_around_features(text, s, e, look))
            nodes.look.append(look)
            nodes.strict.append(strict)
            cue = _cue(text, s, look)
            if cue < 0 and LOOKS[look] == "name" and any(w.title() in words.openers for w in _WORD.findall(piece)):
                cue = 0  # a sentence's first word is in no name
            elif cue < 0 and capitals and not strict:
                cue = 0  # part of a text in capitals
            elif cue < 0 and LOOKS[look] == "place" and not any(c.isdigit() for c in piece):
                cue = 0  # an address has a house number or box
            nodes.cue.append(cue)
            nodes.where.append((first_text + number, s, e))
            if k and "\n" not in text[held:s]:
                nodes.chain.append((at - 1, at))
            held = e
            if LOOKS[look] == "name":
                for w in regex.findall(r"\p{L}[\p{L}'-]*", piece):
                    key = (look, w.casefold())
                    if len(w) > 1:
                        if key in last and last[key] != at:
                            nodes.skip.append((last[key], at))
                        last[key] = at
                        initials.setdefault(key[1][0], at)
                    elif w.casefold() in initials and initials[w.casefold()] != at:
                        nodes.skip.append((initials[w.casefold()], at))
            else:
                key = (look, regex.sub(r"[^\p{L}\p{N}]", "", piece).casefold())
                if key in last:
                    nodes.skip.append((last[key], at))
                last[key] = at


class SkipChain:
    """Weights of span features, chain and skip potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray, words: Words, unseen: np.ndarray, edges: bool = True) -> None:
        self.weights, self.chain, self.skip, self.words, self.unseen, self.edges = weights, chain, skip, words, unseen, edges

    @property
    def given(self) -> frozenset[str]:
        return self.words.given

    @staticmethod
    def _ascend(x: np.ndarray, allowed: np.ndarray, y: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, rounds: int, rate: float, penalty: float = 2e-5) -> None:
        """Pseudo-likelihood of the labelled nodes (y >= 0), weights changed in place."""
        known = y >= 0
        if not known.any():
            return
        target = np.zeros((len(y), len(KINDS)))
        target[known, y[known]] = 1
        share = known / np.maximum(np.bincount(y[known], minlength=len(KINDS))[np.maximum(y, 0)], 1) ** 0.5  # rare kinds weigh more
        share /= share.sum()
        seen = [np.full_like(p, 1e-8) for p in (weights, *(p for _, p in edges))]
        for _ in range(rounds):
            score = np.where(allowed, weights[x].sum(axis=1), -1e9)
            for e, p in edges:
                for a, b, table in ((e[:, 0], e[:, 1], p.T), (e[:, 1], e[:, 0], p)):
                    both = known[b]
                    np.add.at(score, a[both], table[y[b[both]]])
            prob = np.exp(score - score.max(axis=1, keepdims=True))
            slope = (target - prob / prob.sum(axis=1, keepdims=True)) * (known * share)[:, None]
            flat = x.ravel()
            steps = [np.stack([np.bincount(flat, weights=np.repeat(slope[:, k], x.shape[1]), minlength=SLOTS) for k in range(len(KINDS))], axis=1)]
            for e, p in edges:
                step = np.zeros_like(p)
                both = known[e[:, 0]] & known[e[:, 1]]
                np.add.at(step.T, y[e[both, 1]], slope[e[both, 0]])
                np.add.at(step, y[e[both, 0]], slope[e[both, 1]])
                steps.append(step)
            for p, g, s in zip((weights, *(p for _, p in edges)), steps, seen, strict=True):
                g = g - penalty * p
                s += g * g
                p += rate * g / np.sqrt(s)

    @staticmethod
    def fit(records: list[list[str]], rounds: int = 60, rate: float = 0.3, words: Words | None = None) -> SkipChain:
        """``words``: counted over more than ``records``; by default over those."""
        if words is None:
            words = learn_words([t for r in records for t in r if t])
        nodes, n = Nodes(), 0
        for texts in records:
            add_record(nodes, texts, n, words)
            n += len(texts)
        kinds = len(KINDS)
        weights, chain, skip = np.zeros((SLOTS, kinds)), np.zeros((kinds, kinds)), np.zeros((kinds, kinds))
        unseen = np.ones(kinds, bool)
        if not nodes.own:
            return SkipChain(weights, chain, skip, words, unseen)
        own, around, look, cue = np.array(nodes.own), np.array(nodes.around), np.array(nodes.look), np.array(nodes.cue)
        allowed = ALLOWED[look]
        unseen = ~np.isin(np.arange(kinds), cue)
        first = np.zeros((SLOTS, kinds))
        SkipChain._ascend(own, allowed, cue, [], first, rounds, rate)
        score = np.where(allowed, first[own].sum(axis=1), -1e9)
        prob = np.exp(score - score.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        sure = np.where(prob.max(axis=1) >= SURE, prob.argmax(axis=1), -1)
        y = np.where(cue >= 0, np.where(prob[np.arange(len(cue)), np.maximum(cue, 0)] >= 1 - SURE, cue, sure), sure)
        weights[:] = first
        edges = [(np.array(e, np.int64).reshape(-1, 2), p) for e, p in ((nodes.chain, chain), (nodes.skip, skip))]
        SkipChain._ascend(np.hstack([own, around]), allowed, y, edges, weights, rounds, rate / 3)
        # distant tokens of one form carry one label: never less than neutral for equal labels
        np.fill_diagonal(skip, np.maximum(np.diag(skip), 1.0))
        return SkipChain(weights, chain, skip, words, unseen)

    def beliefs(self, nodes: Nodes) -> np.ndarray:
        """Max-marginals by loopy message passing over chain and skip edges."""
        allowed = ALLOWED[np.array(nodes.look)]
        own = self.weights[np.hstack([np.array(nodes.own), np.array(nodes.around)])].sum(axis=1)
        strict = np.array(nodes.strict)
        blind = (strict > 0) & self.unseen[strict]
        own[blind, strict[blind]] += 3.0
        own = np.where(allowed, own, -1e6)
        e = np.array(nodes.chain + nodes.skip, np.int64).reshape(-1, 2)
        if not len(e) or not self.edges:
            return own
        p = np.concatenate([np.repeat(self.chain[None], len(nodes.chain), 0), np.repeat(self.skip[None], len(nodes.skip), 0)])
        source, goal = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
        table = np.concatenate([p, p.transpose(0, 2, 1)])  # [edge, label of source, label of goal]
        back = np.r_[np.arange(len(e)) + len(e), np.arange(len(e))]
        message = np.zeros((len(source), len(KINDS)))
        order = np.argsort(goal, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(goal[order]) > 0])
        total = own.copy()
        for _ in range(SWEEPS):
            new = ((total[source] - message[back])[:, :, None] + table).max(axis=1)
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
            total = own.copy()
            total[goal[order][starts]] += np.add.reduceat(message[order], starts, axis=0)
        return total

    def entities(self, records: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(record, text of the record, start, end, kind)."""
        nodes, where = Nodes(), []
        for r, texts in enumerate(records):
            add_record(nodes, texts, len(where), self.words)
            where += [(r, k) for k in range(len(texts))]
        if not nodes.own:
            return []
        kinds = self.beliefs(nodes).argmax(axis=1)
        return [(*where[text], s, e, int(kind)) for (text, s, e), kind in zip(nodes.where, kinds, strict=True) if kind > 0]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent: set[tuple[str, str, str]] = set()  # only saves shuffling; emptied when large
    for b in batches:
        for at in range(0, len(b), 500):
            texts = {t for r in b.column(0).slice(at, 500).to_pylist() for t in r or [] if t}
            new = name_evidence(list(texts)) - sent
            if len(sent) > SENT:
                sent.clear()
            sent |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*new, strict=True)], names=["word", "kind", "other"])


def all_words(df: DataFrame, texts: Column, least: int = 2) -> Words:
    """``learn_words`` of all rows' texts, counted in the cluster; only the words that stand for something come to the driver."""
    seen = df.select(texts.alias("t")).mapInArrow(_evidence, "word string, kind string, other string").dropDuplicates()
    seen = materialize(seen, "name-evidence")  # read for both counts
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    counted = seen.where("kind <> 'pair'").groupBy("word").agg(*[n(k) for k in ("family", "inside", "common")])
    pairs = seen.where("kind = 'pair'")
    alone = pairs.groupBy("word").agg((F.count(F.lit(1)) == 1).alias("alone"))
    firsts = pairs.where("other <> ''").join(alone, "word").groupBy(F.col("other").alias("word")).agg(F.count(F.lit(1)).alias("firsts"), F.sum(F.col("alone").cast("long")).alias("singles"))
    ends = firsts.where((F.col("firsts") >= TYPE_FIRSTS) & (2 * F.col("singles") > F.col("firsts"))).join(counted.where("family > 0"), "word", "left_anti").select(F.col("word").alias("other"), F.lit(True).alias("ends"))
    firm = F.coalesce("ends", F.lit(False)) | F.col("other").isin(*sorted(DESIGNATORS))
    follow = pairs.join(ends, "other", "left").groupBy("word").agg(F.sum((~firm).cast("long")).alias("after"), F.sum(firm.cast("long")).alias("firm"))
    given = follow.where((F.col("after") >= least) & (F.col("after") > F.col("firm"))).join(counted.where("inside > 0 and common = 0"), "word").select("word", F.lit("given").alias("as"))
    opens = follow.where(F.col("after") + F.col("firm") >= TYPE_FIRSTS).join(counted, "word", "left").where("coalesce(common, 0) > 0 or coalesce(inside, 0) = 0").select("word", F.lit("opener").alias("as"))
    kept = given.unionByName(opens).unionByName(counted.where("family > 0").select("word", F.lit("family").alias("as"))).unionByName(ends.select(F.col("other").alias("word"), F.lit("type").alias("as")))
    by: dict[str, set[str]] = {"given": set(), "family": set(), "type": set(DESIGNATORS), "opener": set()}
    for r in kept.collect():  # names and designations of the collection, not documents
        by[r["as"]].add(r["word"])
    return Words(frozenset(by["given"] - TITLES), frozenset(by["family"] - by["type"]), frozenset(by["type"]), frozenset(by["opener"]))


def fit(df: DataFrame, texts: Column, records: int = FIT_RECORDS) -> SkipChain:
    """``texts``: array of strings of a record; weights from at most ``records`` rows, words counted over all."""
    n = max(df.count(), 1)
    drawn = df.select(texts.alias("t")).where(F.size("t") > 0)
    drawn = drawn if n <= records else drawn.sample(min(1.0, 1.2 * records / n), seed=3)
    rows = [[t or "" for t in r["t"]] for r in drawn.limit(records).collect()]  # at most ``records`` rows
    return SkipChain.fit(rows, words=all_words(df, texts))


def _finder(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SkipChain = model_b.value
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                ids, places, texts = (part.column(i).to_pylist() for i in range(3))
                texts = [[t or "" for t in (r or [])] for r in texts]
                rows = [(ids[r], places[r][k], k, s, e, KINDS[kind], texts[r][k][s:e]) for r, k, s, e, kind in model.entities(texts)]
                if rows:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["id", "place", "text_no", "start", "end", "kind", "found"]).astype({"text_no": "int32", "start": "int32", "end": "int32"}), preserve_index=False)

    return run


def record_texts(kg: str = "kg", content: str = "content") -> tuple[Column, Column]:
    """(places, texts) of a converted document: its content's elements, then both ends of every triple."""
    entry = lambda e: F.array_join(e["content"], " ")
    body = F.coalesce(F.col(content), F.array().cast("array<string>"))
    ends = F.coalesce(F.flatten(F.transform(kg, lambda t: F.array(entry(t["subject"]), entry(t["value"])))), F.array().cast("array<string>"))
    return F.concat(F.array_repeat(F.lit("content"), F.size(body)), F.array_repeat(F.lit("kg"), F.size(ends))), F.concat(body, ends)


def find(df: DataFrame, id_col: str, places: Column, texts: Column, model: SkipChain | None = None) -> DataFrame:
    """(id, place, text_no, start, end, kind, found), offsets in characters of the text."""
    model_b = df.sparkSession.sparkContext.broadcast(model or fit(df, texts))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), places.alias("places"), texts.alias("texts"))
    return rows.mapInArrow(_finder(model_b), "id bigint, place string, text_no int, start int, end int, kind string, found string")


def _redactor(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SkipChain = model_b.value
        for b in batches:
            ids, places, texts = (b.column(i).to_pylist() for i in range(3))
            whole = [[t or "" for t in (r or [])] for r in texts]
            out = [list(r or []) for r in texts]
            for r, k, s, e, kind in sorted(model.entities(whole), key=lambda x: -x[2]):
                out[r][k] = out[r][k][:s] + PLACEHOLDERS[KINDS[kind]] + out[r][k][e:]
            split = [[[t for t, q in zip(r, p or [], strict=True) if q == want] for r, p in zip(out, places, strict=True)] for want in ("content", "kg")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(split[0], pa.list_(pa.string())), pa.array(split[1], pa.list_(pa.string()))], names=["id", "content", "kg_content"])

    return run


def redact(df: DataFrame, id_col: str, places: Column, texts: Column, model: SkipChain | None = None) -> DataFrame:
    """(id, content, kg_content) with typed placeholders; kg_content holds subject and value of each triple in turn."""
    model_b = df.sparkSession.sparkContext.broadcast(model or fit(df, texts))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), places.alias("places"), texts.alias("texts"))
    return rows.mapInArrow(_redactor(model_b), "id bigint, content array<string>, kg_content array<string>")
