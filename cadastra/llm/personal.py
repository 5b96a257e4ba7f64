"""Personal information inside free text (problem 2), by information-theoretic sanitisation.

Pass 1 reads every two-word phrase of capitalised words in the corpus, with the words before and after it. How often
a leading word stands where a protected person is named is its disclosure: words whose pointwise mutual information
with being named exceeds the threshold are given names, and frequent ending words below the floor
(annexes, schedules, places) name no person. Where persons are named is learnt as well: titles and a few usual words of
letters (``SEEDS``) begin it, the contexts beside phrases that given names mostly lead become cues, and the disclosure is
estimated again with them. The same pass counts the towns that stand before a state and a ZIP code.

Pass 2 finds the items of each text: emails, addresses, identity numbers and phones by their form and the words
around them, names by the disclosure of their terms and by the cues. Items never nest. ``redact`` replaces them with
typed placeholders (the generalisation of a disclosing term to its kind) and keeps the rest.

Only phrases and counts are shuffled, summed in each batch first. Supports are absolute, so further texts without
persons take no name away. Terms and cues are sent to the tasks, at most ``MOST_TERMS`` of each kind, the best supported
first; a name beyond them is still found by its cue and its form.

Addresses are read with the states of the USA, phones in North American and international form.

Defined results: NULL and empty texts have no items; repeated texts give their items under each id; offsets count
code points; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, flat_map

#: A leading word reveals a person from this support and disclosure on: the pointwise mutual information (in nats) between the
#: word and being named, against the prior probability that a phrase of two capitalised words is a person. The first
#: estimate, by the seeds alone, sees few of the places where persons are named, so less is asked of it.
MIN_COUNT = 3
PRIOR = 0.25
DISCLOSURE, FIRST_DISCLOSURE = 0.47, -0.51
#: An ending word seen so often, and named in less than this share, reveals none.
FLOOR = 0.02
OFTEN = 12
#: A context is a cue if so many phrases stand beside it, led by so many different given names, which lead this share of them.
CUE_COUNT, CUE_NAMES, CUE_SHARE = 8, 8, 0.6
ROUNDS = 2
MOST_TERMS, MOST_CUES = 200_000, 5_000

KINDS = ("email", "street_address", "id_number", "phone", "person_name")

TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|MR|MRS|MS|DR|mr|mrs|ms|dr)\.?"
#: Usual words before a person in letters, from which cues are learnt (fixed values).
SEEDS = ("Dear", "Attn:", "Sincerely,", "Regards,", "Signed", "Owner:", "Contact:", "contact:", "Prepared by", "prepared by", "spoke with")
_CUED = re.compile(rf"(?:\b{TITLE}|(?:{'|'.join(re.escape(c) for c in SEEDS)})(?:\s+{TITLE})?)\s+$")
_LEFT_CUE, _RIGHT_CUE = re.compile(r"(?:[^\W\d]\S* )?[^\W\d][^\W\d]*(?:/|[:,]?)"), re.compile(r"(?:[^\W\d]\S* |, )?[^\W\dA-Z][^\W\d]*:?")
_TITLE_END = re.compile(rf"(?<![A-Za-z]){TITLE}\s+$")
_PHRASE = re.compile(r"(?!(?:Dear|Mr|Mrs|Ms|Dr|Attn|Our|The|To|Present|Owner)\b)[A-Z][A-Za-z]+[ \n]+(?:[A-Z]\.?[ \n]+)?[A-Z][A-Za-z]+(?:-[A-Za-z]+)?")

# States of the USA and their postal abbreviations (fixed values).
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
#: A state as it stands in an address: by its name, or abbreviated before a ZIP code; after a town and a comma also without one.
_NAMED = "|".join(sorted((f"{n}|{n.upper()}|{n.lower()}" for n in STATES.values()), key=len, reverse=True))
_ZIPPED = "|".join(f"{a}|{a.lower()}|{a.title()}" for a in STATES)
_ANY_STATE = rf"(?:(?:{_NAMED}|TX|tx|Tx)\b|(?:{_ZIPPED})(?=\.?,?\s+\d{{5}}(?!\d)))"
_AFTER_TOWN = rf"(?:,?\s+{_ANY_STATE}|, (?:{'|'.join(a for a in STATES if a not in ("HI", "IN", "ME", "OK", "OR"))})\b)"
_STATE = re.compile(rf"([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?),? (?:{_ANY_STATE}) \d{{5}}(?!\d)")
_ZIP = re.compile(r" \d{5}(?!\d)")

SUFFIXES = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Loop|Trail|Trl|Parkway|Pkwy|Boulevard|Blvd|Way|Place|Pl|Circle|Cir|Terrace|Ter|Highway|Hwy"
_SUFFIX_WORDS = frozenset(SUFFIXES.lower().split("|"))
_ANY_SUFFIX = "|".join(f"{s}|{s.upper()}|{s.lower()}" for s in SUFFIXES.split("|"))
_UNITS = r"(?:(?:Apt|Unit|Suite|Ste|Bldg|Room|Rm|APT|UNIT|SUITE|STE|apt|unit|suite|ste)\.?\s?#?\s?[\w-]+|#\s?\w+)"
ADDRESS = re.compile(
    rf"\d{{1,5}} (?:(?:[NSEW]\.?|North|South|East|West|NORTH|SOUTH|EAST|WEST|north|south|east|west) )?(?:[A-Za-z][A-Za-z'0]+ ){{1,3}}?(?:{_ANY_SUFFIX})(?![A-Za-z])(?:\.(?=[\s,]))?"
    rf"(?:,? +{_UNITS})?"
)
_STREET = re.compile(rf".*?\b(?:{_ANY_SUFFIX})\b")
TOWN = re.compile(rf",?\s+([A-Za-z][A-Za-z]+(?: (?!{_ANY_STATE})[A-Za-z][A-Za-z]+)?)(?:({_AFTER_TOWN})\.?(?:,?\s+(\d{{5}}(?:-\d{{4}})?)(?!\d))?)?")
STATE = re.compile(rf",?\s+({_ANY_STATE})(?:\s+(\d{{5}}(?:-\d{{4}})?)(?!\d))?")

_LOCAL, _HOST = r"[A-Za-z0-9][A-Za-z0-9._+-]*", r"[A-Za-z0-9-]+"
EMAIL = re.compile(rf"{_LOCAL} ?@ ?{_HOST}(?:\.{_HOST})+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
ABROAD = re.compile(r"(?<![\w+])\+(?!1\b)[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\d-])")
OBFUSCATED = re.compile(rf"{_LOCAL}(?: ?[\(\[] ?(?:at|AT) ?[\)\]] ?| (?:at|AT) ){_HOST}(?:(?: ?[\(\[] ?(?:dot|DOT) ?[\)\]] ?| (?:dot|DOT) |\.){_HOST})+")
_LONG = re.compile(r"\d{4,}")
_BEFORE = r"(?<![\w$#/.,:-])"
_PHONE_TAIL = re.compile(_BEFORE + r"(?:(?<!\d )(?:\+?1[-. ]?)?(?:\([2-9]\d\d\)\s?|[2-9]\d\d[-./ ])\d{3}[-. ]\d{4}|(?<!\d )[2-9]\d\d[-.]\d{4})$")
_RUN_PHONE = re.compile(r"1?[2-9]\d\d[2-9]\d{6}")
_EXT = re.compile(r",?\s*(?:x|X|ext\.?|Ext\.?|EXT\.?|extension)\s*\d{1,6}(?!\d)")
_MORE = re.compile(r"[\w-]|[.,/]\d")
_SOCIAL_TAIL = re.compile(r"(?<![\w$/.,-])\d{3}([- ])\d\d\1\d{4}$")
_BARE_TAIL = re.compile(r"(?<![\w#-])(?:\d\d[A-Z]\d{6}|[A-Z]\d{4}-\d{4}-\d{4}|\d[A-Z]{2}\d{6})$")
NUMBERED = re.compile(
    r"(?:\bSSN|\bS\.S\.N\.|\b[Ss]ocial [Ss]ecurity)(?: ?(?:no\.?|number|#))?[: ]{1,2}(\d{9}|\d{3}[- .]\d\d[- .]\d{4})(?!\d)"
    r"|(?:\bDL|[Dd]river'?s? ?[Ll]icen[cs]e|[Ll]icen[cs]e)(?: ?(?:no\.?|number|#))?[:# ]{1,3}([A-Z0-9][A-Z0-9-]{5,17}(?<=\d))(?![\w])"
    r"|[Pp]assport(?: ?(?:no\.?|number|#))?[: ]{1,2}([A-Z0-9]{6,10})(?!\w)"
)
_DEVICE = re.compile(r"(?:\b[S5]\s?/?[N]|[Ss]erial|\b[Mm]odel|[Ii]nvoice|[Aa]ccount|[Aa]cct|FEIN|EIN|[Oo]rder|[Cc]ase|[Ff]orm|[Pp]ermit|[Tt]ag)\.?(?: ?(?:no\.?|number|#))?[:# ]*$")
_LISTED = re.compile(r"\d{3,4}\s*[|,\t ]")
_AMOUNT = re.compile(r"\d\.\d\d\s*$")

_NAME = r"[A-Z][A-Za-z0-9']+(?:-[A-Z]?[A-Za-z0-9']+)*"
_TAIL = r"(?:,? (?:Jr|Sr|JR|SR|II|III|IV)\b\.?)?"
_INITIALS = r"(?: [A-Z](?:\.|(?= )))?"
_FORWARD = re.compile(rf"(?P<given>[A-Z][A-Za-z0-9']+)(?:\s{{1,2}}[A-Z](?:\.|(?=\s)))?\s{{1,2}}(?P<last>{_NAME}){_TAIL}")
_BACK = re.compile(rf"(?P<last>{_NAME}),\s{{1,2}}$")
_GIVEN_TAIL = re.compile(rf"[A-Z][A-Za-z0-9']+{_INITIALS}(?: [A-Z]\.?(?![A-Za-z]))?{_TAIL}")
_SHORT = re.compile(rf"(?:[A-Z]\.? (?P<a>{_NAME})|(?P<b>{_NAME}),? [A-Z](?:\.|(?![\w'-]))(?: [A-Z]\.)?)")
_CUED_ANY = re.compile(r"(?P<a>[A-Za-z][A-Za-z0-9']+)(?:,? (?P<i>[A-Za-z]\.?))?(?P<comma>,)? (?P<b>[A-Za-z][A-Za-z0-9']+(?:-[A-Za-z0-9']+)*)(?: [A-Za-z]\.?(?![\w'-]))?(?=[\n,.;]|\s*$|\s[a-z(]|\s\+?\d)")
_LOW_TAIL = re.compile(r"(?<![\w'-])([a-z]+)(?: [a-z]\.?)? ([a-z]+(?:-[a-z]+)?)$")
_LABEL = re.compile(r"\nO[a-z0-9]{2,5} ?[a-z]{0,2}[:;.] +")
_CAPITALS = re.compile(r"\b[A-Z]{3,}[,;]? $")
_TITLED = re.compile(rf"{TITLE}\s+")
_FIRM = re.compile(r"\b(?:LLC|PLLC|Inc|INC|Corp|CORP|Ltd|LTD|LP|Company|COMPANY|Co|Services|Group|Partners|Associates|Traders|Guild|Depot|Stores|Works|Annex|Building|Hall)\b|&")
_WORD = re.compile(r"[A-Z][A-Za-z0-9']+")
_INITIAL_BEFORE = re.compile(r"(?<![A-Za-z])[A-Za-z]\.? $")
_SIX_WORDS = re.compile(r"(?:[^\S\n]*[^\s]+){0,6}[^\S\n]?")


def _words_back(text: str, end: int, words: int) -> int:
    """Where the last ``words`` words before ``end`` begin, with the blanks before ``end``."""
    at = end
    while at and text[at - 1].isspace():
        at -= 1
    for n in range(words):
        while n and at and text[at - 1] in " \t":
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def phrases(text: str) -> tuple[Counter, Counter]:
    """Counts of (leading word, ending word, contexts, named by a seed) of the phrases of one text, and of towns."""
    terms: Counter = Counter()
    for m in _PHRASE.finditer(text):
        a, b = m.span()
        first, last = text[a:b].split(None, 1)[0], text[a:b].rsplit(None, 1)[-1]
        before = text[max(0, a - 60) : a]
        named = bool(_CUED.search(before))
        titled = _TITLE_END.search(before)
        left = " ".join((before[: titled.start()] if titled else before).split()[-2:])
        glued = b < len(text) and not text[b].isspace() and text[b] != ","
        right = "" if glued else " ".join(text[b : b + 48].split()[:2]).rstrip(".,;:")
        terms[first.lower(), last.lower(), _contexts(left, right), named] += 1
    towns: Counter = Counter()
    if _ZIP.search(text):
        for m in _STATE.finditer(text):
            words = m.group(1).lower().split()
            towns[" ".join(w for w in words if w not in _SUFFIX_WORDS)] += 1
    return terms, towns


def _contexts(left: str, right: str) -> tuple[str, ...]:
    """The contexts of a phrase, ``<`` those before and ``>`` those after it: one and two words on each side, without numbers, ends of
    sentences and bare marks."""
    before, after = {left, left.rsplit(" ", 1)[-1]}, {right, right.split(" ", 1)[0]}
    out = [f"<{w}" for w in sorted(before) if len(w) > 1 and _LEFT_CUE.fullmatch(w)]
    return (*out, *[f">{w}" for w in sorted(after) if len(w) > 1 and _RIGHT_CUE.fullmatch(w)])


def disclosure(texts: DataFrame) -> Terms:
    """What the ``texts`` (one column ``text``) reveal about the terms in them."""

    def count(columns: list[list]) -> list[list]:
        terms: Counter = Counter()
        towns: Counter = Counter()
        for text in columns[0]:
            t, w = phrases(text)
            terms.update(t)
            towns.update(w)
        rows = [(*t, n) for t, n in terms.items()] + [(t, None, None, None, n) for t, n in towns.items() if t]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5

    spark = texts.sparkSession
    schema = "first STRING, last STRING, contexts ARRAY<STRING>, named BOOLEAN, n BIGINT"
    counted = flat_map(texts.where(F.length("text") > 0).select("text"), count, schema)
    counted = checkpointed(counted.groupBy("first", "last", "contexts", "named").agg(F.sum("n").alias("n")))
    seen = counted.where("last IS NOT NULL")
    towns = {r["first"] for r in _most(counted.where("last IS NULL").groupBy("first").agg(F.sum("n").alias("n")), "first")}
    around = seen.select("first", F.explode("contexts").alias("context"), "n").groupBy("first", "context").agg(F.sum("n").alias("n"))
    left: frozenset[str] = frozenset()
    right: frozenset[str] = frozenset()
    placed, given = seen, _given(seen, FIRST_DISCLOSURE)
    for _ in range(ROUNDS):
        known = spark.createDataFrame([(g,) for g in sorted(given)], "given STRING")  # at most MOST_TERMS
        led = around.join(F.broadcast(known), F.col("first") == F.col("given"), "left")
        met = led.groupBy("context").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("given").isNotNull(), F.col("n")).otherwise(0)).alias("led"), F.count_distinct("given").alias("names"))
        cues = {r["context"] for r in _most(met.where((F.col("n") >= CUE_COUNT) & (F.col("names") >= CUE_NAMES) & (F.col("led") >= F.col("n") * CUE_SHARE)), "context", most=MOST_CUES)}
        left, right = (_needed({c[1:] for c in cues if c[0] == side}, side == "<") for side in "<>")
        cued = F.arrays_overlap("contexts", F.lit([f"<{c}" for c in sorted(left)] + [f">{c}" for c in sorted(right)])) if left or right else F.lit(False)
        placed = seen.withColumn("named", F.col("named") | cued)
        given = _given(placed, DISCLOSURE)
    ends = placed.groupBy("last").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"))
    ordinary = _most(ends.where((F.col("n") >= OFTEN) & (F.col("named") < F.col("n") * FLOOR)), "last")
    return Terms(given, frozenset(r["last"] for r in ordinary), frozenset(towns), left, right)


def _needed(cues: set[str], left: bool) -> frozenset[str]:
    """The cues without those of two words of which the one beside the person is a cue by itself."""
    return frozenset(c for c in cues if " " not in c or (c.rsplit(" ", 1)[1] if left else c.split(" ", 1)[0]) not in cues)


def _most(df: DataFrame, *names: str, most: int = MOST_TERMS) -> list:
    """The rows of at least MIN_COUNT, at most ``most``, the best supported first."""
    return df.where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), *names).limit(most).collect()


def _given(seen: DataFrame, least: float) -> frozenset[str]:
    """The leading words that reveal a person; few sightings draw a word to the prior."""
    leads = seen.groupBy("first").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"))
    information = F.log((F.col("named") + PRIOR) / (F.col("n") + 1) / PRIOR)
    return frozenset(r["first"] for r in _most(leads.where(information >= least), "first"))


@dataclass(frozen=True)
class Terms:
    """Given names, words that end no name, towns, and the cues before and after persons."""

    given: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()
    towns: frozenset[str] = frozenset()
    left: frozenset[str] = frozenset()
    right: frozenset[str] = frozenset()


def _fewer(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_slip(a: str, b: str) -> bool:
    """Whether one letter misread, lost or added makes ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return b[i + 1 :] == a[i + 1 :] or b[i:] == a[i + 1 :] or b[i + 1 :] == a[i:]


class Finder:
    """Finds the personal items of one text after another."""

    def __init__(self, terms: Terms):
        import ahocorasick

        self.given, self.ordinary, self.towns = terms.given, terms.ordinary, terms.towns
        self.near: dict[str, list[str]] = {}
        for name in self.given:
            if len(name) > 3:
                for less in _fewer(name):
                    self.near.setdefault(less, []).append(name)
        self.cues = ahocorasick.Automaton()
        for cue in {*SEEDS, *terms.left}:
            for spelt in {cue, cue.replace(" ", "\n"), cue.replace(" ", "  ")}:
                for before in (" ", "\n"):
                    for after in (" ", "\n"):
                        self.cues.add_word(before + spelt + after, (len(spelt) + 2, "left"))
        for cue in terms.right:
            for spelt in {cue, cue.replace(" ", "\n"), cue.replace(" ", "  ")}:
                for before in (" ", "\n") if cue[0].isalnum() else ("",):
                    self.cues.add_word(before + spelt, (len(before) + len(spelt), "right"))
        self.cues.make_automaton()

    def items(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every item in reading order; items do not overlap."""
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        numbers = self.numbers(text)
        for kind, spans in (
            ("email", self.emails(text)),
            ("street_address", self.addresses(text)),
            ("id_number", [x[1:] for x in numbers if x[0] == "id_number"]),
            ("phone", [x[1:] for x in numbers if x[0] == "phone"]),
            ("person_name", self.names(text)),
        ):
            for a, b in spans:
                if not any(a < y and x < b for _, x, y in found):
                    found.append((kind, a, b))
        return sorted(found, key=lambda f: f[1:])

    @staticmethod
    def emails(text: str) -> list[tuple[int, int]]:
        spans = []
        at = text.find("@")
        while at >= 0:
            start = at - (at > 1 and text[at - 1] == " ")
            while start and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            m = EMAIL.match(text, start)
            if m and m.end() > at:
                spans.append(m.span())
            at = text.find("@", at + 1)
        if "(at" in text or "[at" in text or " dot " in text or "[dot" in text or "(dot" in text or "(AT" in text or "[AT" in text or " DOT " in text:
            spans += [m.span() for m in OBFUSCATED.finditer(text) if re.search(r"[(\[ ]dot|[(\[]at|DOT|[(\[]AT", m.group())]
        return spans

    def addresses(self, text: str) -> list[tuple[int, int]]:
        spans = []
        for m in ADDRESS.finditer(text):
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ",.$/-_"):
                continue
            words = re.sub(r"^\d+ ", "", m.group())
            if any(c.isupper() for c in words) and not all(w[0].isupper() for w in _STREET.match(words).group().split()):
                continue  # a number before other words
            end = m.end()
            state = STATE.match(text, end)
            if not state and words == words.lower() and not TOWN.match(text, end):
                continue
            town = TOWN.match(text, end)
            if state:
                end = state.end()
            elif town:
                words = town.group(1).split()
                if town.group(2) and " ".join(w.lower() for w in words) not in ("lives at",) and words[0][0].isupper():
                    end = town.end()
                    if not town.group(3) and text[end - 1] == ".":
                        end -= 1
                elif not town.group(2):
                    for k in (2, 1):
                        if len(words) >= k and " ".join(words[:k]).lower() in self.towns:
                            end = town.start(1) + len(" ".join(words[:k]))
                            rest = STATE.match(text, end)
                            end = rest.end() if rest else end
                            break
            if end == m.end() and text[end - 1] == "." and not m.group().lower().endswith(" dr."):  # only Dr. is written with its point
                end -= 1
            spans.append((m.start(), end))
        return spans

    @staticmethod
    def numbers(text: str) -> list[tuple[str, int, int]]:
        """Identity numbers and phones: every run of four or more digits is looked at with what stands before it."""
        spans: list[tuple[str, int, int]] = []
        if "SSN" in text or "DL" in text or "assport" in text or "icence" in text or "river" in text or "ocial" in text:
            for m in NUMBERED.finditer(text):
                k = next(i for i in (1, 2, 3) if m.group(i))
                if sum(c.isdigit() for c in m.group(k)) >= 5:
                    spans.append(("id_number", *m.span(k)))
        for m in _LONG.finditer(text):
            a, b = m.span()
            length, before = b - a, text[a - 1 : a]
            if length == 4 and before in ("-", ".", " ") and a > 1 and (text[a - 2].isdigit()):
                low = max(0, a - 24)
                tail = text[low:b]
                found = _SOCIAL_TAIL.search(tail) or _BARE_TAIL.search(tail)
                kind = "id_number"
                if not found:
                    found, kind = _PHONE_TAIL.search(tail), "phone"
            elif length in (10, 11) and _RUN_PHONE.fullmatch(text, a, b):
                low = max(0, a - 1)
                found, kind = re.search(r"(?<![\w$#/.,:-])\+?\d+$", text[low:b]), "phone"
            elif length == 6 and before.isupper():
                low = max(0, a - 4)
                found, kind = _BARE_TAIL.search(text[low:b]), "id_number"
            else:
                continue
            if not found or _MORE.match(text, b):
                continue
            start = low + found.start()
            if _DEVICE.search(text[max(0, start - 16) : start]):
                continue
            if kind == "id_number":
                line = text[text.rfind("\n", 0, start) + 1 : (text.find("\n", b) + 1 or len(text) + 1) - 1]
                if _LISTED.match(line) and _AMOUNT.search(line):
                    continue
            else:
                more = _EXT.match(text, b)
                b = more.end() if more else b
            spans.append((kind, start, b))
        if "+" in text:
            spans += [("phone", *m.span()) for m in ABROAD.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
        return spans

    def _last(self, word: str) -> bool:
        """Whether a word may be a last name."""
        low = word.lower()
        return len(word) > 2 and low not in self.ordinary and low not in self.towns and not _FIRM.fullmatch(word) and not (low in self.given and "-" not in word and len(low) < 4)

    def names(self, text: str) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        done = 0
        given = self.given
        for m in _WORD.finditer(text):
            a = m.start()
            if a < done or m.group().lower() not in given or (a and (text[a - 1].isalnum() or text[a - 1] in "-'")):
                continue
            if text[max(0, a - 4) : a].lower() == "the ":
                continue
            if m.group().isupper() and _CAPITALS.search(text[max(0, a - 24) : a]):
                continue  # a word of a text all in capitals
            f = _FORWARD.match(text, a)
            low = _words_back(text, a, 1)
            back = _BACK.search(text[low:a])
            if f and self._last(f.group("last")) and not ("\n" in f.group() and back) and not _FIRM.match(text, min(len(text), f.end() + 1)):
                end = f.end()
                spans.append((a, end))
                done = end
                continue
            if back and back.group("last").lower() not in given and self._last(back.group("last")):
                start = low + back.start()
                if start >= done and not (start and text[start - 1].isalnum()):
                    g = _GIVEN_TAIL.match(text, a)
                    spans.append((start, g.end()))
                    done = g.end()
        padded = f" {text} "  # so a place in the text is one further in this
        ends: list[int] = []
        for last, (length, side) in self.cues.iter(padded):
            if side == "left":
                self._cued(text, last - 1, spans)
            elif last > length and not padded[last + 1 : last + 2].isalnum():
                ends.append(last - length)
        at = text.find("\nO")  # an owner's label, misread
        while at >= 0:
            label = _LABEL.match(text, at)
            if label:
                self._cued(text, label.end() - 1, spans)
            at = text.find("\nO", at + 1)
        for end in dict.fromkeys(ends):
            last = _words_back(text, end, 1)
            if text[last : last + 1].islower() and text[_words_back(text, last, 1) : last].strip().lower() not in self.given and not _INITIAL_BEFORE.search(text, max(0, last - 3), last):
                continue
            start = _words_back(text, end, 4)
            tail = text[start:end]
            low = _LOW_TAIL.search(tail)
            if low and low.group(1) in self.given and self._last(low.group(2)):
                spans.append((start + low.start(), end))
                continue
            for s in _SHORT.finditer(tail):
                if s.end() == len(tail) and self._last(s.group("a") or s.group("b")):
                    spans.append((start + s.start(), end))
        return self._merged(spans)

    def _cued(self, text: str, start: int, spans: list[tuple[int, int]]) -> None:
        """Names after a cue that no given name shows: initials, misread and lower-case names."""
        while start < len(text) and text[start] in " \n":
            start += 1
        titled = _TITLED.match(text, start)
        if titled:
            start = titled.end()
        if start < len(text) and not text[start].isupper():
            two = text[start : start + 80].lower().split(None, 2)[:2]
            if not any(w.strip(",.;:") in self.given for w in two):
                return  # a name in lower case shows its given name
        if any(x <= start < y for x, y in spans):
            return
        line = _SIX_WORDS.match(text, start).group()
        s = _SHORT.match(line)
        if s and self._last(s.group("a") or s.group("b")) and not _FIRM.search(line[: s.end() + 12]):
            spans.append((start, start + s.end()))
            return
        m = _CUED_ANY.match(line)
        if m and not _FIRM.search(line[: m.end() + 4]):
            a, b = m.group("a"), m.group("b")
            known = a.lower() in self.given or b.lower() in self.given
            if (known or (a[0].isupper() and b[0].isupper() and self._near_given(a, b))) and self._last(b if b.lower() not in self.given else a):
                spans.append((start, start + m.end()))

    def _near_given(self, a: str, b: str) -> bool:
        """Whether one of two words is a given name with one letter misread, lost or added."""
        return any(one_slip(word, name) for word in (a.lower(), b.lower()) for less in _fewer(word) for name in self.near.get(less, ()))

    @staticmethod
    def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest of overlapping spans, the first of equally long ones."""
        kept: list[tuple[int, int]] = []
        for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if not any(a < y and x < b for x, y in kept):
                kept.append((a, b))
        return sorted(kept)


def find_items(df: DataFrame, source_table: str, row_id: str, field: str, terms: Broadcast) -> DataFrame:
    """(source_table, row_id, kind, start_at, end_at) of every personal item of ``field``, by the broadcast ``terms``."""
    made: list[Finder] = []  # once a task

    def run(columns: list[list]) -> list[list]:
        if not made:
            made.append(Finder(terms.value))
        out: list[list] = [[], [], [], [], []]
        for row, text in zip(*columns, strict=True):
            for item in made[0].items(text):
                for values, x in zip(out, (source_table, row, *item), strict=True):
                    values.append(x)
        return out

    chosen = df.where(F.length(field) > 0).select(F.col(row_id).cast("bigint").alias("row_id"), F.col(field).alias("text"))
    return flat_map(chosen, run, "source_table STRING, row_id BIGINT, kind STRING, start_at INT, end_at INT")


def redact(df: DataFrame, row_id: str, field: str, terms: Broadcast) -> DataFrame:
    """(row_id, redacted): the text with each item replaced by its typed placeholder, NULL where the text is."""
    made: list[Finder] = []  # once a task

    def run(columns: list[list]) -> list[list]:
        if not made:
            made.append(Finder(terms.value))
        out = []
        for text in columns[1]:
            if text:
                parts, end = [], 0
                for kind, a, b in made[0].items(text):
                    parts += [text[end:a], f"[{kind.upper()}]"]
                    end = b
                text = "".join([*parts, text[end:]])
            out.append(text)
        return [columns[0], out]

    return flat_map(df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(field).alias("text")), run, "row_id BIGINT, redacted STRING")
