"""Personal information in free text: found, and replaced by typed stand-ins.

Method: surrogate generation.  Detected entities are brought to a canonical form
(without case, accents and layout, given names first), so all spellings of one entity are
one; inside one text "A. Smith" is the one Anna Smith that the text names.  Each entity
gets a keyed, type-consistent replacement, drawn word by word or digit by digit, and
every surface is rendered from it in the format it was written in: digits stay digits,
capitals stay capitals, spelled-out forms stay spelled out, initials are those of the new
name, names come from the lexicon with the same ending class and script.  A collision
check over all entities redraws any replacement that two different entities share or
that is itself an entity found in the text, until none is left, so distinctness and
coreference survive.  The lexicon does not tell the gender of a name; the ending class
stands for it.  In the redacted text a placeholder of its kind that carries a keyed code
stands in the find's place, or, on request, the surrogate itself.

Scale: texts are scanned once, without a shuffle; only the finds (few and short) are
shuffled.  The name lexicon is a stated small table with a checked size.

Defined results for odd input: null and empty texts hold nothing; repeated rows are
each reported; overlapping finds go to the first of e-mail, identity number, phone,
address, name; null lexicon forms are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

KINDS = ("email", "id_number", "phone", "address", "name")
#: The lexicon goes to every task; a larger one is refused.
LEXICON_LIMIT = 200_000

# --- patterns ------------------------------------------------------------------------------

_LABEL = r"[a-zA-Z0-9À-ɏ](?:[\w-]*[a-zA-Z0-9À-ɏ])?"
_EMAIL = re.compile(
    rf"(?<![\w.+%@/:-])[\w][\w.+%-]*@{_LABEL}(?:\.{_LABEL})*\.[a-zA-ZÀ-ɏ]{{2,}}(?![\w@])(?!:[\w~/])"
    rf"|(?<![\w.+%@-])[\w][\w.+%-]*\s?[(\[{{]\s?(?:at|AT)\s?[)\]}}]\s?{_LABEL}(?:(?:\.|\s?[(\[{{]\s?(?:dot|DOT)\s?[)\]}}]\s?){_LABEL})*(?:\.|\s?[(\[{{]\s?(?:dot|DOT)\s?[)\]}}]\s?)[a-zA-Z]{{2,}}(?!\w)"
    r"|(?<![\w.+%@-])[\w][\w+%-]*(?:(?:\.| DOT )[\w+%-]+)* AT [\w-]+(?: DOT [\w-]+)+(?!\w)"
    r"|(?<![\w.+%@-])[\w][\w+%-]*(?: (?:dot|underscore|dash|plus) [\w+%-]+)* at [\w-]+(?: dot [\w-]+)+(?!\w)",
)
_EMAIL_HINT = re.compile(r"@|[(\[{] ?(?:at|AT) ?[)\]}]| AT [\w-]+ DOT | at [\w-]+ dot ")

_ID = re.compile(
    r"(?<![\w/.+-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{8}-?[A-Za-z]"
    r"|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]"
    r"|[A-Za-z]\d{8}[A-Za-z]\d"
    r")(?![\w/-]|\.\d)"
)
_PHONE = re.compile(
    r"(?<![\w.+/#-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}"
    r"|00[1-9]\d{1,7}(?:[ ./-]\d{2,8}){0,4}"
    r"|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}"
    r"|0[1-9]\d{1,3}[/ -]\d{3,8}(?:[ -]\d{1,6}){0,3}"
    r"|0[1-9]\d{8,9}"
    r")(?![\w@/-]|[.:]\d)(?! ?(?:ms|rows|bytes|items|files)\b)"
)
_NUMBER_HINT = re.compile(r"\d[\d ()./-]{5,}[\dA-Za-z]|[A-Za-z]{1,2} ?\d\d ?\d\d ?\d\d")
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_SPOKEN = re.compile(rf"(?<!\w){_DIGIT_WORD}(?:[ ,-]+{_DIGIT_WORD}){{6,14}}(?!\w)", re.I)
_SPOKEN_HINT = re.compile(r"(?:zero|one|two|three|four|five|six|seven|eight|nine)[ ,-]+(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)[ ,-]", re.I)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_STREET = "Street|STREET|St|Lane|LANE|Ln|Avenue|AVENUE|Ave|AVE|Road|ROAD|Rd|Drive|DRIVE|Court|Square|Terrace|Crescent|Boulevard|Blvd|Way|Close"
_HOUSE = r"\d{1,4}(?: ?[a-zA-Z](?!\w))?"
_ADDRESS = re.compile(
    rf"(?<![\w./-])(?:"
    rf"{_HOUSE},? (?:{_CAP} ){{1,3}}(?:{_STREET})(?!\w)"
    rf"|{_HOUSE}(?: (?:bis|ter))?,? (?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai)(?: (?:de|du|des|la|le|les|DE|DU|DES|LA))* (?:Saint[e-]? ?)?{_CAP}(?!\w)"
    rf"|(?:[Cc]alle|CALLE|[Aa]venida|[Pp]laza|[Pp]aseo)(?: (?:de|del|la|las|los|el|DE|DEL|LA))* {_CAP}(?: {_CAP})?,? {_HOUSE}(?!\w)"
    rf"|[A-ZÀ-ÖØ-Þ][\wß-]*(?:[Ss]tra(?:ß|ss)e|STRASSE|STRAßE|[Ss]tr\.|[Ww]eg|WEG|[Aa]llee|ALLEE|[Pp]latz|PLATZ|[Gg]asse|GASSE|[Uu]fer|[Dd]amm|[Rr]ing) {_HOUSE}(?![\w/])"
    rf")"
)
_ADDRESS_HINT = ("treet", "TREET", " St", "Lane", "LANE", " Ln", "venue", "VENUE", "Ave", "AVE", "Road", "ROAD", " Rd", "Drive", "DRIVE", "Court", "Square", "Terrace", "Crescent", "oulevard", "Blvd", "Way", "Close", "ue ", "RUE ", "lace ", "hemin ", "llée ", "uai ", "alle ", "CALLE ", "venida ", "laza ", "aseo ", "tra", "STRA", "tr. ", "weg ", "WEG ", "Weg ", "llee ", "LLEE ", "latz ", "LATZ ", "asse ", "ASSE ", "fer ", "amm ", "ing ")
_ADDRESS_TRIGGER = re.compile(r"\d[a-zA-Z]?,? [A-Za-z]|[a-zA-Zß.,] \d{1,4}(?!\d)")

#: Letters that do not fall apart into a base letter and an accent.
_LETTERS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ı": "i", "þ": "th", "Þ": "TH"}


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    plain = "".join(_LETTERS.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c)).lower()


_LETTERS_OF = r"(?:[^\W\d_][\u0300-\u036f]*)+"
_FIRST_WORD = re.compile(_LETTERS_OF)
_NAME_START = re.compile(r"(?<![\w@.'’-])[^\W\d_]")
_GAP = re.compile(r"[ \t\xa0]+")
_INITIALS = re.compile(r"(?:(?:[A-Za-z]\.-?)+[ \t\xa0]+)*", re.I)
_LEADING = re.compile(r"(?:[A-Za-z]\.-?[ \t\xa0]*)+", re.I)
_TRAILING = re.compile(r"(?:[ \t\xa0]+(?:[A-Za-z]\.-?)+(?!\w))*", re.I)
_COMMA_INITIALS = re.compile(r",[ \t\xa0]+(?:[A-Za-z]\.-?)+(?!\w)", re.I)
_GOES_ON = re.compile(r"[\w@]|-\w|\.\w")


class Names:
    """Finds a given name or initial with a family name, in either order, out of a lexicon.

    Forms are looked up by their first word, so the cost of a text does not grow with the lexicon.
    """

    def __init__(self, given: list[str], family: list[str]) -> None:
        forms = lambda words: {w for x in words for w in (x.lower(), fold(x), unicodedata.normalize("NFD", x).lower())}
        self.given, self.family = forms(given), forms(family)
        self.starts = tuple(self._by_first_word(s) for s in (self.given, self.family))
        try:
            import ahocorasick

            self.hint = ahocorasick.Automaton()
            for w in self.family:
                self.hint.add_word(w, 1)
            if self.family:
                self.hint.make_automaton()
        except ImportError:
            self.hint = None

    @staticmethod
    def _by_first_word(forms: set[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for f in sorted(forms, key=lambda w: (-len(w), w)):
            if m := _FIRST_WORD.match(f):
                out.setdefault(m.group(), []).append(f)
        return out

    def _ends(self, low: str, at: int, part: int, twice: bool = True) -> list[int]:
        """Where a form (0 given, 1 family) that begins at ``at`` may end, hyphenated pairs and longer forms first."""
        m = _FIRST_WORD.match(low, at)
        out: list[int] = []
        for f in self.starts[part].get(m.group(), ()) if m else ():
            if low.startswith(f, at):
                end = at + len(f)
                if twice and low.startswith("-", end):
                    out += self._ends(low, end + 1, part, False)
                out.append(end)
        return out

    def _match(self, text: str, low: str, at: int) -> int | None:
        """Where a name that begins at ``at`` ends."""
        for end in self._ends(low, at, 0):
            if gap := _GAP.match(text, end):
                start = _INITIALS.match(text, gap.end()).end()
                for stop in self._ends(low, start, 1):
                    if not _GOES_ON.match(text, stop):
                        return stop
        families = self._ends(low, at, 1)
        for end in families:
            if gap := _GAP.match(text, end + text.startswith(",", end)):
                for stop in self._ends(low, gap.end(), 0, False):
                    if not _GOES_ON.match(text, stop):
                        return _TRAILING.match(text, stop).end()
        for end in families:
            if m := _COMMA_INITIALS.match(text, end):
                return m.end()
        if m := _LEADING.match(text, at):
            for stop in self._ends(low, m.end(), 1):
                if not _GOES_ON.match(text, stop):
                    return stop
        return None

    def find(self, text: str) -> list[tuple[int, int]]:
        if not self.family:
            return []
        low = text.lower()
        if self.hint is not None and next(self.hint.iter(low), None) is None:
            return []
        if len(low) != len(text):  # a letter that grows in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, last = [], 0
        for m in _NAME_START.finditer(text):
            at = m.start()
            if at >= last and (end := self._match(text, low, at)) is not None:
                out.append((at, end))
                last = end
        return out

    def canonical(self, surface: str) -> str:
        """Given names, then initials, then family names, without case, accents and layout."""
        words = re.findall(r"[^\W\d_]+", fold(surface))
        if "," not in surface and not (words and words[0] in self.family and words[0] not in self.given and words[-1] not in self.family):
            return " ".join(words)  # given names stand first already
        first = [w for w in words if len(w) > 1 and w in self.given and ("," not in surface or w not in re.findall(r"[^\W\d_]+", fold(surface.split(",", 1)[0])))]
        initials = [w for w in words if len(w) == 1]
        return " ".join([*first, *initials, *(w for w in words if w not in first and len(w) > 1)])


def linked(names: list[str]) -> list[str]:
    """The canonical names of one text, short forms put to the one longer form that the text also has."""

    def parts(name: str) -> tuple[str, list[str], str]:
        words = name.split()
        head = words[0]
        initials = [w for w in words[1:] if len(w) == 1]
        return head, initials, " ".join(w for w in words[1:] if len(w) > 1)

    known = {n: parts(n) for n in set(names)}
    families: dict[str, list[str]] = {}
    for n in sorted(known):
        families.setdefault(known[n][2], []).append(n)
    out = {}
    for name, (head, initials, family) in known.items():
        longer = []
        for o in families[family]:
            h, i, _ = known[o]
            if o != name and len(h) > 1 and ((len(head) == 1 and h[0] == head and i[: len(initials)] == initials) or (h == head and not initials and i)):
                longer.append(o)
        out[name] = longer[0] if len(longer) == 1 else name
    return [out[out[n]] for n in names]


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every find, in order, without overlaps."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []

    def put(spans: list[tuple[int, int]], kind: str) -> None:
        for a, b in spans:
            if all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, kind))

    if _EMAIL_HINT.search(text):
        put([m.span() for m in _EMAIL.finditer(text)], "email")
    if _NUMBER_HINT.search(text):
        put([m.span() for m in _ID.finditer(text)], "id_number")
        put([m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15], "phone")
    if _SPOKEN_HINT.search(text):
        put([m.span() for m in _SPOKEN.finditer(text)], "phone")
    if any(h in text for h in _ADDRESS_HINT) and _ADDRESS_TRIGGER.search(text):
        put([m.span() for m in _ADDRESS.finditer(text)], "address")
    put(names.find(text), "name")
    return sorted(taken)


# --- canonical forms and replacements ------------------------------------------------------

_WORD_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}


def canonical(surface: str, kind: str) -> str:
    """One form for all spellings of an entity."""
    s = fold(surface)
    if kind == "email":
        s = re.sub(r"\s?[(\[{]\s?at\s?[)\]}]\s?| at ", "@", s)
        s = re.sub(r"\s?[(\[{]\s?dot\s?[)\]}]\s?| dot ", ".", s)
        return re.sub(r" (underscore|dash|plus) ", lambda m: {"underscore": "_", "dash": "-", "plus": "+"}[m.group(1)], s)
    if kind == "phone":
        times, out = 1, []
        for w in re.findall(r"[a-z]+|\d", s):
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
                continue
            out.append(_WORD_DIGITS.get(w, w) * times)
            times = 1
        digits = "".join(out)
        return digits[2:] if digits.startswith("00") else digits
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", s)
    if kind == "name":
        if "," in s:
            family, given = s.split(",", 1)
            s = f"{given.strip()} {family.strip()}"
        return " ".join(re.findall(r"[^\W\d_]+", s))
    return re.sub(r"[\s\xa0,]+", " ", s).strip()


def _draw(key: bytes, kind: str, entity: str, attempt: int) -> Callable[[int], int]:
    """A keyed stream of whole numbers below a bound."""
    state = {"n": 0, "pool": b""}

    def below(bound: int) -> int:
        if len(state["pool"]) < 4:
            state["pool"] += hmac.new(key, f"{kind}\0{entity}\0{attempt}\0{state['n']}".encode(), hashlib.sha256).digest()
            state["n"] += 1
        value, state["pool"] = int.from_bytes(state["pool"][:4]), state["pool"][4:]
        return value % bound

    return below


def code(key: bytes, kind: str, entity: str, length: int = 10) -> str:
    """The keyed code that a placeholder carries; the same for all spellings of an entity."""
    return hmac.new(key, f"{kind}\0{entity}".encode(), hashlib.sha256).hexdigest()[:length]


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word


_CONSONANTS, _LAST = "EFGHJKLMNPRSTWXYZ", "ABCD"


class Pools:
    """The lexicon by what a replacement has to be like: part, ending class and script."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.known: dict[str, tuple[int, str]] = {}
        self.alike: dict[tuple[int, bool, bool], list[str]] = {}
        self.parts = (given, family)
        for part, words in enumerate(self.parts):
            for w in words:
                self.known[fold(w)] = (part, w)
                self.alike.setdefault(self._class(part, w), []).append(w)

    @staticmethod
    def _class(part: int, form: str) -> tuple[int, bool, bool]:
        # the ending stands for gender where the lexicon does not tell it; accents for the script
        return part, form[-1].lower() in "ae", form.isascii()

    def word(self, entity: str, word: str, key: bytes, attempt: int) -> str:
        """What stands for one word of a name, the same in all spellings of the entity."""
        below = _draw(key, f"name\0{word}", entity, attempt)
        part, form = self.known.get(word, (1, word))
        if part and attempt >= 2:  # the lexicon has too few: a made-up family name, longer with each few attempts
            stems, ends = "bar dol fen gar hol kel lin mor nor pel ral sel tor ul var wen".split(), "berg by dal feld gren holm land lund rud stad vik wald".split()
            made = "".join(stems[below(16)] for _ in range(3 + (attempt - 2) // 3)) + ends[below(12)]
            return made.capitalize() + ("" if form.isascii() else "ø")
        pool = self.alike.get(self._class(part, form)) or self.parts[part]
        return pool[below(len(pool))]


def surrogate(surface: str, kind: str, entity: str, key: bytes, names: Pools, attempt: int = 0) -> str:
    """The entity's replacement in the format of the surface."""
    below = _draw(key, kind, entity, attempt)
    if kind in ("phone", "id_number"):
        kept = 2 if kind == "phone" else 0  # the first digits tell the kind of number
        fresh = [c if i < kept else str(below(10)) if c.isdigit() else _LAST[below(4)] if c in "abcd" else _CONSONANTS[below(17)] for i, c in enumerate(entity)]
        if kind == "phone" and not any(c.isdigit() for c in surface):
            said = " ".join(list(_WORD_DIGITS)[int(c)] for c in fresh)
            return said.upper() if surface.isupper() else said
        start = 2 if kind == "phone" and surface.startswith("00") else 0
        left = iter(fresh)
        return surface[:start] + re.sub(r"\d|[A-Za-z]", lambda m: _cased(m.group() * 2, next(left, m.group())), surface[start:])
    if kind == "email":
        syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
        return re.sub(r"(?<!\w)(?!(?:at|dot|underscore|dash|plus)(?!\w))\w+", lambda m: _cased(m.group(), "".join(syllables[below(20)] for _ in range(max(2, min(4, len(m.group()) // 2)) + attempt // 8))), surface[: _tail(surface)], flags=re.I) + surface[_tail(surface) :]
    if kind == "address":
        stems = "alder birch cedar elm fir hazel linden maple oak pine rowan willow".split()
        ends = "bank bridge cross dale ford hill mead mill side ton well wick".split()
        named = re.sub(
            r"[A-ZÀ-Þ][\w'’-]*",
            lambda m: m.group() if re.fullmatch(rf"{_STREET}|Rue|RUE|Calle|CALLE|Avenida|Plaza|Paseo|DE|DU|DES|LA", m.group()) else _cased(m.group(), ("".join(stems[below(12)] for _ in range(1 + attempt // 6)) + ends[below(12)]).capitalize()) + (re.search(r"(?i)(?:stra(?:ß|ss)e|weg|allee|platz|gasse|ufer|damm|ring)$|$", m.group()).group()),
            surface,
        )
        return re.sub(r"\d+", lambda m: str(1 + below(max(9, 10 ** len(m.group()) - 1))), named)
    words = entity.split()

    def swap(m: re.Match) -> str:
        word = m.group()
        w = fold(word)
        if len(w) == 1:
            full = next((x for x in words if x[0] == w and len(x) > 1 and x != words[-1]), None)
            return _cased(word * 2, names.word(entity, full, key, attempt)[0].upper() if full else chr(65 + _draw(key, f"initial\0{w}", entity, attempt)(26)))
        new = names.word(entity, w, key, attempt)
        if word.isascii() and not new.isascii():
            new = "".join(c for c in unicodedata.normalize("NFD", "".join(_LETTERS.get(c, c) for c in new)) if not unicodedata.combining(c))
        return _cased(word, new)

    return re.sub(_LETTERS_OF, swap, surface)


def _tail(surface: str) -> int:
    """Where the last label of an e-mail address begins; it is kept."""
    return max(m.start() for m in re.finditer(r"\w+", surface))


# --- operators -----------------------------------------------------------------------------


def _lexicon(lexicon: DataFrame) -> tuple[list[str], list[str]]:
    rows = lexicon.where("form is not null and part is not null").select("form", "part").limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError(f"the name lexicon has more than {LEXICON_LIMIT} rows")
    return sorted({r["form"] for r in rows if r["part"] == "given"}), sorted({r["form"] for r in rows if r["part"] == "family"})


_FINDS = "source_table string, row_id bigint, char_start int, char_end int, kind string, surface string, entity string"
_FIND_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())


def finds(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every find with its place and canonical form.  ``texts``: source_table, row_id, text."""
    given, family = _lexicon(lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, family)
        for batch in batches:
            out = []
            for table, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = find(text, names)
                people = iter(linked([names.canonical(text[a:b]) for a, b, kind in held if kind == "name"]))
                out += [(table, row, a, b, kind, text[a:b], next(people) if kind == "name" else canonical(text[a:b], kind)) for a, b, kind in held]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIND_TYPES, strict=True)], names=["source_table", "row_id", "char_start", "char_end", "kind", "surface", "entity"])

    return texts.select("source_table", "row_id", "text").where("text is not null").mapInArrow(scan, _FINDS)


def _codes(key: str):  # noqa: ANN202
    secret = key.encode()

    @F.pandas_udf("string")
    def coded(kind, entity):  # noqa: ANN001, ANN202
        return kind.combine(entity, lambda k, e: code(secret, k, e))

    return coded


def _draws(key: str, lexicon: tuple[list[str], list[str]]):  # noqa: ANN202
    secret, names = key.encode(), Pools(*lexicon)

    @F.pandas_udf("string")
    def draw(surface, kind, entity, attempt):  # noqa: ANN001, ANN202
        return surface.combine(kind, lambda s, k: (s, k)).combine(entity, lambda p, e: (*p, e)).combine(attempt, lambda p, n: surrogate(p[0], p[1], p[2], secret, names, int(n)))

    return draw


def surrogates(found: DataFrame, lexicon: DataFrame, key: str, attempts: int = 200) -> DataFrame:
    """(kind, entity, attempt, code, surrogate): one row per entity, surrogates distinct and none an entity of the text.

    The surrogate shown is that of the entity's least surface; ``attempt`` is the draw that all
    its surfaces are rendered from.  Collisions are redrawn until none is left; made-up
    words grow with the attempts, so that there is room for any number of entities.
    """
    draw = _draws(key, _lexicon(lexicon))

    @F.pandas_udf("string")
    def plain(text, kind):  # noqa: ANN001, ANN202
        return text.combine(kind, canonical)

    entities = materialize(found.groupBy("kind", "entity").agg(F.min("surface").alias("surface")))
    pending = entities.withColumn("attempt", F.lit(0))
    settled = None
    for n in range(attempts):
        drawn = pending.withColumn("surrogate", draw("surface", "kind", "entity", "attempt")).withColumn("as_entity", plain("surrogate", "kind"))
        first = drawn.groupBy("kind", "as_entity").agg(F.min("entity").alias("entity"))
        fresh = drawn.join(first, ["kind", "as_entity", "entity"], "left_semi")
        fresh = fresh.join(entities.select("kind", F.col("entity").alias("as_entity")), ["kind", "as_entity"], "left_anti")
        if settled is not None:
            fresh = fresh.join(settled.select("kind", "as_entity"), ["kind", "as_entity"], "left_anti")
        fresh = materialize(fresh.select("kind", "entity", "attempt", "surrogate", "as_entity"))
        settled = fresh if settled is None else settled.unionByName(fresh)
        pending = materialize(pending.join(fresh, ["kind", "entity"], "left_anti").withColumn("attempt", F.lit(n + 1)))
        if pending.isEmpty():
            return settled.select("kind", "entity", "attempt", _codes(key)("kind", "entity").alias("code"), "surrogate")
    raise RuntimeError(f"some entities found no surrogate of their own in {attempts} attempts")


def replaced(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Every find with the surrogate that replaces it: the columns of ``finds``, code and surrogate.

    The surrogate is in the format of this very surface.
    """
    found = materialize(finds(texts, lexicon))
    known = surrogates(found, lexicon, key).select("kind", "entity", "attempt", "code")
    draw = _draws(key, _lexicon(lexicon))
    return found.join(known, ["kind", "entity"]).select(*found.columns, "code", draw("surface", "kind", "entity", "attempt").alias("surrogate"))


def redact(texts: DataFrame, lexicon: DataFrame, key: str, realistic: bool = False) -> DataFrame:
    """(source_table, row_id, n_finds, redacted) of the texts that hold anything.

    A row is named by its table and id; rows repeated under one id are equal.
    Placeholders read ``<KIND:code>``, the code being the same wherever the entity stands;
    ``realistic`` puts the surrogates instead.  All other text stays as it is.
    """
    if realistic:
        each = replaced(texts, lexicon, key).withColumnRenamed("surrogate", "stand_in")
    else:
        each = finds(texts, lexicon).withColumn("stand_in", F.concat(F.lit("<"), F.upper("kind"), F.lit(":"), _codes(key)("kind", "entity"), F.lit(">")))
    each = each.groupBy("source_table", "row_id").agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end", "stand_in"))).alias("spans"))
    each = each.toDF("_table", "_row", "spans")
    joined = texts.select("source_table", "row_id", "text").join(each, F.col("source_table").eqNullSafe(F.col("_table")) & F.col("row_id").eqNullSafe(F.col("_row")))
    # the text up to each find and its stand-in, one after the other
    built = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["char_start"] - acc["at"]), s["stand_in"]).alias("text"), s["char_end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return joined.select("source_table", "row_id", F.size("spans").alias("n_finds"), built.alias("redacted"))
