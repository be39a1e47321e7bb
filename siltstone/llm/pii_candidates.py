"""High-recall generators of personal-information spans in scanned text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

# Signs that scanners confuse, each mapped to one of its class.
LOOKALIKE = str.maketrans({"0": "o", "c": "e", "o": "o", "1": "l", "i": "l", "|": "l", "!": "l", "j": "l", "h": "b", "t": "f", "ſ": "s", "5": "s", "q": "g", "9": "g", "8": "b", "u": "n", "v": "y", "’": "'"})

# Forms of address of a person, in the languages of the corpus.
TITLES = "mr mrs miss ms dr rev capt captain sir m mm mme mlle monsieur madame mademoiselle herr herrn frau frl fräulein sr sra srta don doña señor señora prof hon col lady".split()

# Words for a street, before or after its name.
STREET_LAST = "road rd street st lane ln row walk avenue ave av terrace ter crescent cres square sq place pl hill close court ct gardens gdns way drive dr parade yard quay alley mews grove".split()
ABBREVIATED = "rd st ln ave av ter cres sq pl ct gdns dr".split()
STREET_JOINED = "straße strasse str weg platz gasse allee ufer damm markt ring steig".split()
STREET_FIRST = "rue avenue av boulevard bd place quai chemin impasse allée cours route ruelle square calle avenida avda av plaza paseo camino ronda travesía callejón carretera".split()

SHORT_FIRST = "av avda bd".split()

# Words that make the capitals before them a firm, board or ship.
FIRM = "co & sons brothers bros board company ltd limited and".split()

EXAMPLE = -2

KINDS = ("email", "phone", "id_number", "address", "name")

BREAK = re.compile(r"-[ \t\xa0]*[\r\n\v\f\x1c-\x1e\x85\u2028\u2029]\s*")
WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*|[£$€@&*“”„«»:;,.]")


def fold(word: str) -> str:
    """Lower case, without accents, with confusable signs made equal."""
    flat = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return flat.translate(LOOKALIKE)


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    #: numbers that describe the span itself
    form: tuple[float, ...]
    #: strings whose weight is learnt: shape, and words around
    hints: tuple[str, ...]
    #: 1 or 0 if form or surroundings settle it, -1 if not, EXAMPLE for a 0 that only the faint hint is learnt by
    label: int


def readings(word: str) -> list[str]:
    """A word folded, and with signs that are read for each other exchanged."""
    w = fold(word)
    return [w, *({w.replace("rn", "m"), w.replace("m", "rn")} - {w})]


class Register:
    """Likeness of a word to the given and family names of a register.

    Besides exact names and names one sign away, a word counts as like a name if
    it is made of a beginning and an ending that the register has in several
    names; this reaches the names that an incomplete register lacks.
    """

    def __init__(self, rows: Iterable[tuple[str | None, str | None]]):
        self.exact: dict[str, set[str]] = {"given": set(), "family": set()}
        for text, kind in rows:
            if text and kind in self.exact:
                self.exact[kind].update(fold(w) for w in re.split(r"[\s\-]+", text) if len(w) > 2 or w.istitle())
        self.near = {k: {d for w in v if len(w) > 4 for d in self._cut(w)} for k, v in self.exact.items()}
        self.head: dict[str, Counter] = {}
        self.tail: dict[str, Counter] = {}
        for k, names in self.exact.items():
            self.head[k] = Counter(w[:i] for w in names for i in range(2, len(w) - 1))
            self.tail[k] = Counter(w[i:] for w in names for i in range(2, len(w) - 1))
        self.words: dict = {}

    @staticmethod
    def _cut(w: str) -> set[str]:
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    def likeness(self, word: str) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
        """For given and family: exact, one sign away, composed (0 to about 7)."""
        out = [max(x) for x in zip(*map(self._reading, readings(word)))]
        return tuple(out[:3]), tuple(out[3:])

    def _reading(self, w: str) -> tuple[float, ...]:
        out = []
        for k in ("given", "family"):
            exact = float(w in self.exact[k])
            near = exact
            if not exact and len(w) > 4:
                cut = self._cut(w)
                near = float(w in self.near[k] or not cut.isdisjoint(self.exact[k]) or not cut.isdisjoint(self.near[k]))
            best = 0.0
            for i in range(2, len(w) - 1):
                h, t = self.head[k].get(w[:i], 0) - exact, self.tail[k].get(w[i:], 0) - exact  # without the name itself
                if h and t and h + t > 2:
                    best = max(best, min(h, 6) ** 0.5 * min(t, 9) ** 0.5)
                elif h + t > 2 and len(w) > 3:
                    best = max(best, 0.25 * (min(h, 6) + min(t, 9)) ** 0.5)
            out += [exact, near, best]
        return tuple(out)


DIGITS = re.compile(r"\d+")
LINE_END = re.compile(r"[\r\n\v\f\x85\u2028\u2029]")
LINE_ENDS = set("\r\n\v\f\x85\u2028\u2029")
BLANKS_AND_STARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "*"
LINE_STOP = re.compile(r"[ \t\xa0]*(?:[\r\n\v\f\x85\u2028\u2029]|$)")
LAST_DIGIT = re.compile(r"\d")
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=100_000)
def _word(text: str) -> str:
    return DIGITS.sub("9", text.lower())


def around(text: str, start: int, end: int) -> tuple[str, str, str, str, bool, bool]:
    """The two words before and after a span, and whether a line begins or ends there."""
    left, right = text[max(0, start - 48) : start], text[end : end + 32]
    before = WORD.findall(BREAK.sub("", left) if "-" in left else left)[-2:]
    after = WORD.findall(BREAK.sub("", right) if "-" in right else right)[:2]
    p2, p1 = [*["^"] * (2 - len(before)), *map(_word, before)]
    n1, n2 = [*map(_word, after), *["$"] * (2 - len(after))]
    kept = left.rstrip(BLANKS_AND_STARS)
    return p1, p2, n1, n2, not kept or not LINE_ENDS.isdisjoint(left[len(kept) :]), bool(LINE_STOP.match(right))


# --- email ---------------------------------------------------------------

SIGN = re.compile(r"[@©®¢ⓐ＠]|[(\[{](?:at|a|AT|A|@)[)\]}]")
#: The local part, in the text read backwards from the sign.
LOCAL = re.compile(r"(?:[\w+|�\xad'’!]|(?<=[\w+|�\xad])[.\-]|(?<=[\w+])\s{0,2}[\r\n]\s{0,2}[.\-_])+")
HOST = re.compile(r"\s{0,3}((?:[\w|�\xad'’!]|-(?:[ \t]*[\r\n]+\s{0,2})?(?=\w))+(?:\.(?:[ \t]*[\r\n]+[ \t]{0,2})?(?:[\w|�\xad!]|-(?:[ \t]*[\r\n]+\s{0,2})?(?=\w))+)+)")


def emails(text: str, backwards: str | None = None) -> Iterator[Candidate]:
    backwards = text[::-1] if backwards is None else backwards
    for m in SIGN.finditer(text):
        near = text[max(0, m.start() - 3) : m.start()]
        at = m.start() - (len(near) - len(near.rstrip()))
        left = LOCAL.match(backwards, len(text) - at)
        right = HOST.match(text, m.end())
        if not left or not right:
            continue
        start, end = at - len(left.group()), m.end() + len(text[m.end() : right.end(1)].rstrip("!'’|"))
        local, host = BREAK.sub("", text[start:at]), re.sub(r"\s", "", BREAK.sub("-", text[right.start(1) : end]))
        if not host:
            continue
        last = host.rsplit(".", 1)[-1]
        sign = m.group()
        wide = at < m.start() or text[m.end() : m.end() + 1].isspace()
        p1, p2, n1, n2, first, final = around(text, start, end)
        strong = len(local) > 2 and not host[0].isdigit() and last.isalpha() and len(last) > 3
        label = 0 if host[0].isdigit() or host.startswith("www") else 1 if strong else -1
        form = (len(local), len(host), host.count("."), float(last.isalpha()), float(host[0].isdigit()), float(wide), float("\n" in text[start:end]), float(any(c.isdigit() for c in host)), len(last), float(first), float(final))
        yield Candidate("email", start, end, form, (last.lower(), sign.lower(), p1, n1), label)


# --- numbers: phone and identity -----------------------------------------

DIGIT = r"[0-9]|[OolI|!SZBbGg�'](?![a-z]|[A-Z]{2})"
GROUP = re.compile(r"[0-9](?:[0-9OolI|!SZBbGg�'](?![a-z]{2}))*|[OolI|SZB](?=[0-9])[0-9OolI|!SZB]*")
SIX = re.compile(r"(?:[^0-9OolI|!SZBbGg�']*+[0-9OolI|!SZBbGg�']){6}")
NUMBERS = re.compile(
    r"(?<![\w£$€.,:/\-])(?:[A-Z]{2}(?:[-\s]{0,2}(?=\d)|(?=[OolISZB|]\d))|(?:[A-Z]{3}[-\s]?|[A-Z][- ]?)(?=\d))?[+(]?\s?"
    + rf"(?:[0-9OolI|SZB](?=[0-9 )\-./OolI|SZB!])|[0-9])(?:{DIGIT}|[ \t\xa0./)(\-–]|\s(?=[\d(]))*"
    + r"(?:[-\s]{0,3}(?<![\w])[A-Z](?![\w'’])|[A-Z](?![\w]))?"
)
PREFIX = re.compile(r"[A-Z]{1,3}(?=[-\s]*[\dOolISZB|])")
SUFFIX = re.compile(r"[-\s]?[A-Z](?!\w)")
BLANKS = re.compile(r"\s+")
TAIL = re.compile(r"[-\s]{0,3}[A-Z](?![\w'’])")
LEAD_PHONE = set("tel tél ruf ring telephone teléfono téléphone telefon phone office call appeler llamar auskunft melden".split())
LEAD_ID = set("titular cédula versicherte nummer dokument card carte passport pasaporte pass passeport member insurance ausweis mitglied assuré asegurado versicherung carné numbered".split())
LEAD_NOT = set("patent lot box ref réf numbers loterie open votes catalogue numéro brevet los patente circulation tirage auflage lote".split())

# Fixed value: a phone number has no more digits, with its country code.
MOST_DIGITS = 15
LEADS = LEAD_PHONE | LEAD_ID | LEAD_NOT | {"nr", "no"}

#: Where a number may end although digits follow: a line end, a wide gap, a sentence's end.
LOOSE = re.compile(r"[\r\n\v\f\x85\u2028\u2029\t]|\s{2}|\.\s")


def numbers(text: str) -> Iterator[Candidate]:
    """Runs of digit groups, cut where a number may end.

    A number lies on one piece of a run, on up to three neighbours, or is the
    whole run, whatever its length; so a run gives a number of candidates in
    proportion to its pieces.
    """
    for m in NUMBERS.finditer(text):
        run, base = m.group(), m.start()
        if not SIX.match(run):
            continue
        groups = [g.span() for g in GROUP.finditer(run)]
        if sum(b - a for a, b in groups) < 6:
            continue
        prefix = PREFIX.match(run)
        if prefix and prefix.group().lower() in LEADS:  # a word before the number, not a part of it
            prefix = None
        ends = [j for j, (x, y) in enumerate(zip(groups, groups[1:])) if LOOSE.search(run, x[1], y[0])] + [len(groups) - 1]
        starts = [0, *(j + 1 for j in ends[:-1])]
        for at, i in enumerate(starts):
            last = ends[at : at + 3]
            for j in last if i or last[-1] == ends[-1] else [*last, ends[-1]]:
                if sum(y - x for x, y in groups[i : j + 1]) < 6:
                    continue
                a, b = groups[i][0], groups[j][1]
                while a and run[a - 1] in "+(":
                    a -= 1
                yield from _number(text, run, base, a, b, groups[i : j + 1], "", "")
                letters = prefix.group() if prefix and i == 0 else ""
                tail = TAIL.match(text, base + b) if letters else None
                if letters:
                    yield from _number(text, run, base, 0, b, groups[i : j + 1], letters, "")
                if letters and tail:
                    yield from _number(text, run, base, 0, tail.end() - base, groups[i : j + 1], letters, tail.group()[-1])


def _number(text: str, run: str, base: int, a: int, b: int, groups: list[tuple[int, int]], letters: str, tail: str) -> Iterator[Candidate]:
    span = text[base + a : base + b]
    clean = sum(c.isdigit() for c in span)
    size = sum(y - x for x, y in groups)
    if clean < 0.6 * size:
        return
    seps = [BLANKS.sub(" ", run[x[1] : y[0]]) for x, y in zip(groups, groups[1:])]
    if any(len(s) > 3 for s in seps):
        return
    start, end = base + a, base + b
    p1, p2, n1, n2, first, final = around(text, start, end)
    shape = ("+" if "+" in span[:2] else "") + ("(" if "(" in span[:3] else "") + "A" * len(letters) + "".join(f"{y - x}{s}" for (x, y), s in zip(groups, [*seps, ""])) + ("A" if tail else "")
    # the words before the run, back to the last number
    lead = text[max(0, base - 40) : base + a if a < 3 or run[:a].strip(" -").lower() in LEADS else base].lower()
    words = LETTERS.findall(LAST_DIGIT.split(BREAK.sub("", lead) if "-" in lead else lead)[-1])[-3:]
    inner = [k + 1 for k, (x, y) in enumerate(zip(groups, groups[1:])) if LOOSE.search(run, x[1], y[0])]
    # two whole numbers side by side, unless groups of one width run on
    even = len({y - x for x, y in groups}) == 1 and size >= 3 * len(groups)
    double = not even and any(min(sum(y - x for x, y in groups[:k]), sum(y - x for x, y in groups[k:])) > 6 for k in inner)
    line_breaks = 0 if double else len(LINE_END.findall(span))
    more_left = float(not letters and any(x.isalnum() for x in LOOSE.split(run[max(0, a - 24) : a])[-1]))
    more_right = float(not tail and any(x.isalnum() for x in LOOSE.split(run[b : b + 24])[0]))
    ordinary = len(letters) not in (0, 2) and bool(re.search(rf"(?<!\w){letters.lower()}(?!\w)", text))  # the letters are a word of the text
    lead = next((k for w in reversed(words) for k, s in enumerate((LEAD_PHONE, LEAD_ID, LEAD_NOT)) if w in s), 2 if "nr" in words else -1)
    lead_phone, lead_id, lead_not = float(lead == 0), float(lead == 1), float(lead == 2)
    hint = (shape, p1, p2, n1, shape[:2] + "|" + re.sub(r"\D", "", span)[:1])
    form = (size, len(groups), groups[0][1] - groups[0][0], groups[-1][1] - groups[-1][0], float("+" in span), float("(" in span), float(len(set(seps)) > 1), float(bool(letters)), float(bool(tail)), size - clean, line_breaks, more_left, more_right, lead_phone, lead_id, lead_not, float(first), float(final), float(span[:1] == "0"), float(span[:1] == "9"), float("." in span), float("-" in span), float("/" in span), float(double), float(ordinary))
    # the whole run right after its lead word settles it
    whole = not more_left and not more_right and not line_breaks and not double
    heading = len(letters) > 2 and span[len(letters)] == " " and text[end : end + 4].strip().isupper()
    phone = 1 if whole and lead_phone and not letters else 0 if letters or lead_not or lead_id or double or size > MOST_DIGITS or (more_left and more_right) else -1
    ident = -1
    if whole and (lead_id or words[-2:] == ["member", "no"]) and (letters or size >= 8):
        ident = 1
    elif lead_phone or lead_not or double or heading or ordinary or (more_left and more_right) or (letters and not tail and SUFFIX.match(text, end)):
        ident = 0
    if not letters:
        yield Candidate("phone", start, end, form, hint, phone)
    yield Candidate("id_number", start, end, form, hint, ident)


# Month names that follow a day.
MONTHS = set("january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec januar februar märz april mai juni juli august september oktober november dezember okt dez janvier février mars avril mai juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())


# --- addresses -------------------------------------------------------------

HOUSE = r"\d[\dOolI]*(?:[a-dA-D]|\s?(?:bis|ter))?"
CAP = r"[A-ZÀ-ÖØ-Þ](?:[\w|�\xad!'’]|-(?:[ \t]*[\r\n]+\s{0,2})?(?=\w))*\.?"
GAP = r"(?:[ \t\xa0]+|[ \t\xa0]*[\r\n\v\f\x85\u2028\u2029]+[ \t\xa0]*)"

#: Where a house number may begin (a number that goes on after a point or comma is none), the number with what divides it from the street, and at the end of an address.
HOUSE_START = re.compile(r"(?<![\w.,/£$€\-])\d[\dOolI]*+(?![.,:]\d)")
HOUSE_AHEAD = re.compile(rf"{HOUSE},?{GAP}(?=[^\W\d_])")
HOUSE_END = re.compile(rf"{HOUSE}(?!\w)")
CAPITAL, NEXT = re.compile(CAP), re.compile(GAP)
#: The type before a French street name, with the small words between.
TYPE_AHEAD = re.compile(rf"([^\W\d_]{{2,}}\.?){GAP}(?:(?:de|du|des|DE|DU|DES|d['’]|l['’]|D['’])(?:{GAP})?(?:(?:la|le|les|LA|l['’]){GAP}?)?)?(?=[A-ZÀ-ÖØ-Þ])")
#: In the text read backwards: a gap, a capitalised word, any word.
GAP_BACK = re.compile(rf"{GAP},?|,{GAP}?")
CAP_BACK = re.compile(r"\.?(?:[\w|�\xad!'’]|(?<=\w)(?:\s{0,2}[\r\n]+[ \t]*)?-)*[A-ZÀ-ÖØ-Þ](?!\w)")
WORD_BACK = re.compile(r"\.?[^\W\d_]+(?!\w)")
#: Street names of up to so many words in question are tried at each, longer ones at their last too.
NEAR = 8
# Small words inside Spanish street names.
SPANISH_SMALL = set("de del la los las el".split())
FOLDED_LAST = {fold(w) for w in STREET_LAST}
FOLDED_JOINED = [fold(w) for w in STREET_JOINED]
FOLDED_FIRST = {fold(w) for w in STREET_FIRST}


@lru_cache(maxsize=100_000)
def _street_last(word: str) -> float:
    raw = BREAK.sub("", word).rstrip(".").lower()
    if len(raw) < 4:  # too short to be recognized when misread
        return float(raw in STREET_LAST)
    w = fold(raw)
    if w in FOLDED_LAST:
        return 1.0
    return 0.6 if len(w) > 3 and any(abs(len(t) - len(w)) < 2 and len(t) > 3 and one_away(w, t) for t in FOLDED_LAST) else 0.0


@lru_cache(maxsize=100_000)
def _street_joined(word: str) -> float:
    w = fold(BREAK.sub("", word).rstrip("."))
    best = max((len(t) for t in FOLDED_JOINED if w.endswith(t)), default=0)
    if best and (len(w) > best + 2 or w == "sfr"):
        return 1.0
    if best == len(w) > 3:  # a word of its own: "Am Alten Markt"
        return 0.6
    return 0.6 if len(w) > 7 and any(len(t) > 4 and one_away(w[-len(t) :], t) for t in FOLDED_JOINED) else 0.0


@lru_cache(maxsize=100_000)
def _street_first(word: str) -> float:
    w = fold(word.rstrip("."))
    if w in FOLDED_FIRST:
        return 1.0
    return 0.6 if len(w) > 3 and any(len(t) > 3 and one_away(w, t) for t in FOLDED_FIRST) else 0.0


def one_away(a: str, b: str) -> bool:
    """Whether one inserted, left out or changed sign turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def addresses(text: str, backwards: str | None = None) -> Iterator[Candidate]:
    """Streets before and after each number that can be a house number.

    From the number the capitalised words beside it are followed as far as they
    go: ahead for 'number name type' and 'number type name', back for 'type name
    number' and 'name-with-type number'. Numbers end such a walk, so all walks
    together are as long as the text.
    """
    backwards = text[::-1] if backwards is None else backwards
    for m in HOUSE_START.finditer(text):
        at = m.start()
        if ahead := HOUSE_AHEAD.match(text, at):
            yield from _number_first(text, at, ahead.end())
        if at and text[at - 1].isspace() and (end := HOUSE_END.match(text, at)):
            yield from _number_last(text, backwards, at, end.end())


def _capitals(text: str, at: int) -> list[tuple[int, int]]:
    """The capitalised words from ``at`` on that follow each other."""
    out = []
    while m := CAPITAL.match(text, at):
        out.append(m.span())
        gap = NEXT.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return out


def _ends(found: list) -> list:
    """Where a street name may end: at any of the first words in question, or at the last one of all."""
    return found if len(found) <= NEAR else [*found[:NEAR], found[-1]]


def _number_first(text: str, start: int, at: int) -> Iterator[Candidate]:
    chain = _capitals(text, at)
    caps = [c for c in chain if c[1] - c[0] > 1]
    if caps and len(chain) > 1 and text[slice(*caps[0])].lower().rstrip(".") not in MONTHS:
        best, found = 0.0, []
        for k, (a, b) in enumerate(caps[1:] if len(caps) > 1 else caps, 1):
            like = _street_last(text[a:b])
            if like and like >= best:
                best = like
                found.append((b - (text[b - 1] == "." and text[a : b - 1].lower() not in ABBREVIATED), like, k))
        for end, like, k in _ends(found):
            yield _address(text, start, end, "last", like, k)
    kind = TYPE_AHEAD.match(text, at)
    like = _street_first(kind.group(1)) if kind else 0.0
    if like:
        caps = _capitals(text, kind.end())
        caps = [c for c in caps if not re.fullmatch(r"(?:DE|DU|DES|LA|LES?|D['’].*)", text[slice(*c)])] or caps
        for k, (_, b) in _ends(list(enumerate(caps, 1))):
            yield _address(text, start, b - (text[b - 1] == "."), "first", like, k)


def _number_last(text: str, backwards: str, at: int, end: int) -> Iterator[Candidate]:
    n = len(text)
    gap = GAP_BACK.match(backwards, n - at)
    word = CAP_BACK.match(backwards, gap.end()) if gap else None
    if not word:
        return
    last = text[n - word.end() : n - word.start()]
    like = 0.0 if "," in gap.group() or len(last) < 2 else _street_joined(last)
    own = like and fold(BREAK.sub("", last).rstrip(".")) in FOLDED_JOINED
    if like and not own:
        yield _address(text, n - word.end(), end, "joined", like, 1)
    caps, small, before, joined = 1, 0, [], []
    while (gap := NEXT.match(backwards, word.end())) and (word := CAP_BACK.match(backwards, gap.end()) or WORD_BACK.match(backwards, gap.end())):
        start, w = n - word.end(), text[n - word.end() : n - word.start()]
        first = _street_first(w) if len(w) > 1 else 0.0
        if first and (w[-1] != "." or w[:-1].lower() in SHORT_FIRST):
            before.append((start, first, caps))
        if w in SPANISH_SMALL or w.lower() in SPANISH_SMALL and w.isupper():
            small += 1
            if small > 2:
                break
            own = own and w.isupper()
        elif w[0].isupper():
            caps, small = caps + 1, 0
            if own:
                joined.append((start, like, caps))
        else:
            break
    for start, first, words in _ends(before):
        yield _address(text, start, end, "spanish", first, words)
    for start, like, words in _ends(joined):
        yield _address(text, start, end, "joined", like, words)


def _address(text: str, start: int, end: int, form_of: str, like: float, words: int) -> Candidate:
    span = text[start:end]
    p1, p2, n1, n2, first, final = around(text, start, end)
    street = re.sub(r"[\d,]+\s?(?:bis|ter|[a-dA-D](?!\w))?", "", re.sub(r"\s+", " ", BREAK.sub("", span))).strip().lower()
    breaks = len(LINE_END.findall(span))
    n_digits = sum(c.isdigit() for c in span)
    upper = float(span.upper() == span)
    month = float(p1 in MONTHS or any(w in MONTHS for w in street.replace(".", "").split()[:1]))
    money = float(n1 in ("fr", "mk", "gns", "copies", "votes", "fr.", "mk.", "tagen", "días", "jours") or text[end : end + 1] in "½,.:" and text[end + 1 : end + 2].isdigit())
    goes_on = float(bool(re.match(r"[ \t\xa0][A-ZÀ-ÖØ-Þ]", text[end : end + 2])))
    hanging = float(form_of == "first" and words > 1 and bool(re.search(r"[\r\n\v\f\x85\u2028\u2029]\s*[A-ZÀ-ÖØ-Þ][^\r\n]*$", span)))
    form = (like, words, len(span), n_digits, breaks, float("-\n" in span), upper, float("," in span), float(form_of == "last"), float(form_of == "first"), float(form_of == "spanish"), float(form_of == "joined"), float(first), float(final), month, money, goes_on, hanging)
    label = 0 if money or month or form_of == "joined" and words > 2 or n_digits > 5 or form_of in ("first", "last") and p1[:1] == "9" else 1 if like == 1 and not breaks and (words <= 3 or not upper) else -1
    if form_of == "first" and (goes_on or hanging):  # the name of the street goes on, or had ended before
        label = 0
    return Candidate("address", start, end, form, (street, p1, n1, form_of + str(words)), label)


# --- names -------------------------------------------------------------------

TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ�](?:[\w|�\xad!'’]|-(?=[^\W\d_])|-[ \t\xa0]*[\r\n\v\f\x85\u2028\u2029]+[ \t\xa0]*(?=[^\W\d_]))*(?P<dot>\.?)")
PARTICLES = ("van ", "Van ", "VAN ")
TITLE_SET = set(TITLES)
#: From a title at the end of a line up to the line after the next: columns may have been read across each other.
CROSSED = re.compile(r"[ \t\xa0]*(?:\r\n|[\r\n\v\f\x85\u2028\u2029]){1,2}[^\r\n\v\f\x85\u2028\u2029]+(?:\r\n|[\r\n\v\f\x85\u2028\u2029]){1,2}[ \t\xa0]*")
INSIDE = re.compile(r"[ \t\xa0]*(?:[\r\n\v\f\x85\u2028\u2029]+[ \t\xa0]*)?")


TITLE_FOLDS = {fold(t): t for t in TITLES if len(t) > 2}


@lru_cache(maxsize=100_000)
def _title(word: str) -> tuple[float, str]:
    """How surely a word is a title (1: exactly, 0.8: of look-alike signs, 0.6: one sign away), and which."""
    raw = BREAK.sub("", word).rstrip(".'’").lower()
    if raw in TITLE_SET and len(raw) > 1:
        return 1.0, raw
    if len(raw) < 3:  # too short to be recognized when misread
        return 0.0, ""
    readings = {fold(r) for r in (raw, raw.replace("rn", "m"), raw.replace("m", "rn"), raw.replace("ri", "n"))}
    for r in readings:
        if r in TITLE_FOLDS:
            return 0.8, TITLE_FOLDS[r]
    for f, t in TITLE_FOLDS.items():
        if len(f) > 3 and any(abs(len(f) - len(r)) < 2 and len(r) > 3 and one_away(r, f) for r in readings):
            return 0.6, raw  # the word itself is learnt: it may be an ordinary one
    return 0.0, ""


class Word:
    """What a capitalised word is by itself, whatever stands around it."""

    __slots__ = ("kind", "text", "skip", "dot", "given", "family", "best_given", "best_family", "title", "beside")

    def __init__(self, register: Register, raw: str):
        self.dot = raw[-1] == "."
        w = raw[:-1] if self.dot else raw
        bare = w.rstrip("'’")
        self.skip, self.given, self.family, self.title = 0, NOTHING, NOTHING, (0.0, "")
        if w in ("VAN", "Van"):
            self.kind = None
        elif bare.lower() in TITLE_SET and len(bare) > 1 or bare in ("M", "m") and self.dot:
            self.kind = "T" if len(bare) > 1 else "TI"
        elif len(bare) == 1:
            self.kind = "I" if self.dot else ""
        else:
            self.kind = "W"
        if len(w) > 4 and "-" in w and (b := BREAK.search(w)) and w[b.end() : b.end() + 1].isupper() and not w.isupper() and max(max(x) for x in register.likeness(w[: b.start()])) < 2:
            self.skip, w = b.end(), w[b.end() :]  # half a word of another column
        self.text = w
        if self.kind == "W":
            self.given, self.family = _best_reading(register, w)
            self.title = (0.0, "") if self.given[0] else _title(w)
        elif self.kind:
            self.title = (float(self.kind != "I"), w.lower())
        self.best_given, self.best_family = max(self.given), max(self.family)
        self.beside = self.kind in ("I", "T", "TI") or self.best_given >= LIKELY_GIVEN


NOTHING = (0.0, 0.0, 0.0)


class _Asking:
    """Stands for a register and notes the words whose likeness is wanted."""

    def __init__(self):
        self.asked: set[str] = set()

    def likeness(self, word: str) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
        self.asked.add(word)
        return NOTHING, NOTHING


def asked_words(text: str) -> set[str]:
    """All words whose likeness :func:`names` may ask of a register for a text."""
    asking = _Asking()
    for raw in {m.group() for m in TOKEN.finditer(text)}:
        Word(asking, raw)
        _best_reading(asking, raw.removesuffix("."))
    return asking.asked


#: Words that a worker remembers, some 120 MB; then it begins anew, which costs time and changes nothing.
REMEMBERED = 200_000


def _word_of(register: Register, raw: str) -> Word:
    known = register.words.get(raw)
    if known is None:
        if len(register.words) > REMEMBERED:
            register.words.clear()
        known = register.words[raw] = Word(register, raw)
    return known


def _best_reading(register: Register, raw: str) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Best over the readings of a broken or double word."""
    raw = re.sub(r"^(?:van|VAN|Van)\s+", "", raw)
    joined = BREAK.sub("", raw)
    parts = [p for p in joined.split("-") if p]
    if len(parts) == 2 and min(map(len, parts)) > 2:
        a, b = register.likeness(parts[0]), register.likeness(parts[1])
        return tuple(min(x, y) for x, y in zip(a[0], b[0])), tuple(min(x, y) for x, y in zip(a[1], b[1]))
    best = register.likeness(joined.replace("-", ""))
    if joined != raw:  # the break may have swallowed a real hyphen
        again = [p for p in BREAK.sub("-", raw).split("-") if len(p) > 2]
        if len(again) == 2:
            a, b = register.likeness(again[0]), register.likeness(again[1])
            best = (tuple(max(x, min(y, z)) for x, y, z in zip(best[0], a[0], b[0])), tuple(max(x, min(y, z)) for x, y, z in zip(best[1], a[1], b[1])))
    return best


def _weakest(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
    return tuple(map(min, a, b))


def names(text: str, register: Register, examples: bool = False) -> Iterator[Candidate]:
    """Names; with ``examples`` also pairs of words that are none, by which ordinary words are learnt.

    Every word that may be a family name is tried with all given names and
    initials beside it. Beyond three words that walk ends at a word which may be
    a family name itself and so has walks of its own; all walks together are as
    long as the text.
    """
    tokens: list[tuple[int, int, int, Word]] = []  # start, end, end with the full stop
    anchors: list[int] = []
    titles: list[int] = []
    lower: set[str] = set()  # words that stand in small letters somewhere in the text
    particles = any(p in text for p in PARTICLES)
    cached = register.words.get
    for m in TOKEN.finditer(text):
        start, raw = m.start(), m.group()
        if start and text[start - 1].isalnum():
            continue
        if particles and text[start - 4 : start] in PARTICLES:
            start, raw = start - 4, text[start - 4 : start] + raw
        w = cached(raw) or _word_of(register, raw)
        if w.kind is None or w.kind != "W" and start and text[start - 1] == "-" and len(w.text) == 1:
            continue
        if w.best_family > 0.4:
            anchors.append(len(tokens))
        if w.kind == "T":
            titles.append(len(tokens))
        stop = m.end()
        tokens.append((start + w.skip, stop - w.dot, stop, w))
    n = len(tokens)

    def adjoins(i: int, j: int, comma: bool = False) -> bool:
        a, b = tokens[i], tokens[j]
        between = text[a[2] if a[3].kind != "W" or a[3].title[0] else a[1] : b[0]]
        if between == " " and not comma:
            return True
        if comma:
            if not between.startswith(","):
                return False
            between = between[1:]
        return bool(INSIDE.fullmatch(between))

    def ordinary(i: int) -> bool:
        """Whether a faint given name is a title or family name, or an ordinary word."""
        return tokens[i][3].title[0] > 0 or tokens[i][3].family[0] > 0 or small(i)

    def small(i: int) -> bool:
        """Whether a word that might be a misread title or given name stands in small letters too; asked for the labels only."""
        nonlocal lower
        if examples:
            lower = lower or set(LETTERS.findall(text)) or {""}
        return tokens[i][3].text.lower() in lower

    # a word before a given name, or before what is no name at all, is not a given name itself (once a text)
    shown: set[str] = set()
    for k in range(1, n) if examples else ():
        a, b = tokens[k - 1][3], tokens[k][3]
        if a.kind == b.kind == "W" and a.text not in shown and a.best_given < LIKELY_GIVEN and (b.given[0] or b.best_family < 0.5) and adjoins(k - 1, k):
            yield _name(text, tokens[k - 1][0], tokens[k][1], NO_TITLE, 1, 0, a.given, b.family, 0, b.text, 0.0, a.text)._replace(label=EXAMPLE)
            shown.add(a.text)

    crossed = {m.end(): tokens[k][3].text for k in titles if (m := CROSSED.match(text, tokens[k][2]))}
    for k in anchors:
        here, word = tokens[k][0], tokens[k][3]
        family, best = word.family, word.best_family
        # beside a sure family name any word may stand, beside a faint one a title, an initial or a likely given name
        likely = k and tokens[k - 1][3].beside or k + 1 < n and tokens[k + 1][3].beside or best > 2.5 and here in crossed
        if best >= 1 or likely and k and tokens[k - 1][3].kind:
            # words before: initials and given names, then perhaps a title
            i, n_given, n_initial, given = k, 0, 0, NOTHING
            spans = [(k, 0, 0, NOTHING, "")]
            first_likely = k
            while i and (k - i < 4 or tokens[i][3].best_family <= 0.4) and adjoins(i - 1, i):
                before, faint = tokens[i - 1][3], ""
                if before.kind in ("I", "TI"):
                    n_initial += 1
                elif before.kind == "W":
                    like = before.given
                    if before.best_given < LIKELY_GIVEN:
                        if best < 1 or n_given:
                            break
                        faint, common = MISREAD if before.title[0] else before.text, ordinary(i - 1)
                    sure = not n_given or like[1] > 0
                    given = _weakest(given, like) if n_given else like
                    n_given += 1
                else:
                    break
                i -= 1
                spans.append((i, n_given, n_initial, given, faint))
                if faint:  # the trees are to judge it; nothing is joined to it
                    break
                if before.kind != "W" or sure:  # a further given name that the register lacks doesn't make the shorter span wrong
                    first_likely = i
            for i, n_given, n_initial, given, faint in spans:
                before = tokens[i - 1][3] if i else None
                title = i > 0 and before.title[0] > (0 if best >= 1 else 0.99) and adjoins(i - 1, i)  # misread ones before a sure name only
                if title or n_given or n_initial:
                    more = float(i > first_likely)
                    yield _name(text, tokens[i][0], tokens[k][1], (before.text, *before.title) if title else NO_TITLE, n_given, n_initial, given, family, 0, word.text, more, faint, bool(faint) and common or bool(title) and before.title[0] < 1 and small(i - 1))
            if likely and k and here in crossed and not (tokens[k - 1][3].kind and adjoins(k - 1, k)):
                yield _name(text, here, tokens[k][1], (crossed[here], 1.0, crossed[here].lower()), 0, 0, NOTHING, family, 0, word.text)
            # words after, with or without a comma
            titled = k > 0 and tokens[k - 1][3].title[0] > (0 if best >= 1 else 0.99) and tokens[k - 1][3].kind != "TI" and adjoins(k - 1, k)
            title = (tokens[k - 1][3].text, *tokens[k - 1][3].title) if titled else NO_TITLE
            for comma in (True, False):
                j, n_given, n_initial, given, faint = k, 0, 0, NOTHING, ""
                while j + 1 < n and (j - k < 3 or tokens[j][3].best_family <= 0.4) and not faint and adjoins(j, j + 1, comma and j == k):
                    after = tokens[j + 1][3]
                    if after.kind in ("I", "TI"):
                        n_initial += 1
                        end = tokens[j + 1][2]
                    elif after.kind == "W":
                        like = after.given
                        if after.best_given < LIKELY_GIVEN:
                            if best < 1 or n_given:
                                break
                            faint, common = MISREAD if after.title[0] else after.text, ordinary(j + 1)
                        given = _weakest(given, like) if n_given else like
                        n_given += 1
                        end = tokens[j + 1][1]
                    else:
                        break
                    j += 1
                    yield _name(text, here, end, title, n_given, n_initial, given, family, 1 + comma, word.text, 0.0, faint, bool(faint) and common)


#: No title: what is written, how surely it is one, which it is. The hint of a misread one that is tried as a given name.
NO_TITLE, MISREAD = ("", 0.0, ""), "<title>"


def _name(text: str, start: int, end: int, titled: tuple[str, float, str], n_given: int, n_initial: int, given: tuple, family: tuple, order: int, word: str, more: float = 0.0, faint: str = "", ordinary: bool = False) -> Candidate:
    span = text[start:end]
    title, sure, which = titled
    p1, p2, n1, n2, first, final = around(text, start - (len(title) + 2 if title else 0), end)
    crossed = title and not text[max(0, start - 16) : start].rstrip().rstrip(".").endswith(title)
    if crossed:
        p1, p2 = "^", "^"
    breaks = len(LINE_END.findall(span))
    hyphen = len(BREAK.findall(span))
    same_line = re.match(r"[ \t\xa0]*([^\s]*)", text[end : end + 24])
    follow = same_line.group(1) if same_line else ""
    street = max((_street_last(follow), _street_joined(follow))) if follow[:1].isupper() else 0.0
    parts = [w for w in span.split() if len(w) > 2]
    mixed = float(order == 0 and len(parts) > 1 and parts[0].isupper() != parts[-1].isupper())
    firm = float(n1 in FIRM and n1 != "and" or (n1 in ("and", "&") and n2 in ("co", "sons", "co.")) or p1 in ("messrs", "ship", "messrs."))
    upper = float(word.upper() == word)
    form = (
        max(5 * given[0], 3 * given[1], given[2]), max(5 * family[0], 3 * family[1], family[2]), given[2], family[2],
        float(n_given), float(n_initial), sure, float(order == 1), float(order == 2), float(breaks - hyphen), float(hyphen),
        upper, float(span.upper() == span), street, firm, float(first), float(final), float("-" in span), float(span.startswith("van") or " van " in span),
        float(follow[:1].isupper()), len(span), float(p1[:1] == "9"), more, mixed,
    )
    if crossed:
        label = -1
    elif more or mixed or firm or street:
        label = 0
    elif ordinary or faint and order and title:  # after a title the family name ends the name
        label = 0
    elif family[0] and (given[0] or n_initial and not faint or sure > 0.6) and order != 1:
        label = 1
    elif order == 2 and family[0] and given[0]:
        label = 1
    elif max(family[:2]) == 0 and max(given[:2]) == 0 and not title and family[2] < (0.01 if n_initial else 1.5):
        label = 0
    elif order == 1 and upper == 0:
        label = 0
    else:
        label = -1
    return Candidate("name", start, end, form, (which, p1, n1, p2, faint.lower()), label)


#: The best likeness of each sort by register and composition, and where composition alone stands.
NAME_BEST = {0: 2, 1: 3}
#: Likeness below which a word beside a family name is a faint given name: the word itself is learnt as a hint.
LIKELY_GIVEN = 0.6
#: Where the likeness of the given name stands, the number of given names, and the hint of a faint one.
NAME_GIVEN, NAME_N_GIVEN, NAME_FAINT = 0, 4, 4
#: Where a title stands, and the likeness of a family name of which only the ending is known.
NAME_TITLE, FAINT = 6, 0.6


def candidates(text: str | None, register: Register, examples: bool = False) -> list[Candidate]:
    """All candidate spans of a text, overlapping ones included; none for a null or empty text.

    ``examples``: further ones to learn from, which are labelled EXAMPLE.
    """
    if not text:
        return []
    backwards = text[::-1]
    return [*emails(text, backwards), *numbers(text), *addresses(text, backwards), *names(text, register, examples)]
