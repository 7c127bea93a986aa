"""Operator 10: personal data, by base patterns and a span classifier taught by weak supervision.

Base spans (email, ip, card, phone) are found by their patterns and always stay. Candidates are found by form alone,
whether or not anything speaks for them: at signs with something on both sides, dotted quads, runs of digits (those
that base patterns run together too: two numbers side by side), plus signs with digits, dates, account-like codes,
pairs of capitalised words. Each is looked at by LABELLERS, which overlap and may say both: issuer and numbering
plans, check digits and ranges, gazetteers of names and of other capitalised words, words of context for and against,
how the span stands in its surroundings, how often it comes, how varied it is. No labeller knows what the base
patterns say. Expectation-maximisation over the votes on all candidates of all documents estimates how reliable each
labeller is, starting from the majority; the posteriors of a bounded sample of different candidates train a logistic
classifier over facts of the span and its surroundings (form, shape, first digits, check digits, neighbouring words),
and no vote is among these. What the classifier finds personal, and no base span overlaps, is added.

One pass reads the texts; what it finds is written to the shared folder, and the rest works on that.
Spans are in code points, the end excluded; added spans overlap neither base ones nor each other: of two that would,
the more probable stays, of equally probable ones the first. Null texts count as empty: no spans. Texts are read
whole, one at a time, in time linear in their length. Repeated rows are treated row by row and alike; null ids are ids
like others. Empty tables give empty results. Columns beside the text are dropped or, when `keep_columns` asks for
them, passed through.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import map_rows, unused, written
from lumenfold.llm.weak_labels import fit, posteriors

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans of equal start are listed.
KINDS = (*BASE, "number", "account", "birth_date", "name")
#: Hash buckets of the classifier; candidates it is fitted on; probability from which a candidate is added.
BUCKETS, SAMPLE, THRESHOLD = 1024, 20_000, 0.7
LABELLERS = ("plan", "check", "gazetteer", "context for", "context against", "standing", "repetition", "variety")

# Frequent given names and family names, titles, capitalised words that are no names of people, and words
# that speak for or against personal data.
GIVEN_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen"
    " christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly andrew emily paul donna joshua michelle"
    " kenneth carol kevin amanda brian dorothy george melissa timothy deborah ronald stephanie edward rebecca jason sharon jeffrey laura ryan cynthia"
    " anna peter maria hans klaus ursula jürgen sabine wolfgang monika stefan petra andreas birgit uwe renate lukas lena jonas hannah felix mia"
    " pierre marie jean michel nathalie philippe isabelle alain sylvie jacques camille luc chloé louis inès hugo manon"
    " juan carmen josé antonio manuel lucía francisco dolores javier pilar carlos ana miguel isabel pablo sofía diego elena alejandro marta".split()
)
FAMILY_NAMES = frozenset(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson martin lee"
    " perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green adams nelson"
    " müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann braun"
    " bernard dubois durand moreau laurent lefebvre michel leroy roux fournier girard bonnet dupont lambert fontaine rousseau vincent"
    " garcía gonzález rodríguez fernández lópez martínez sánchez pérez gómez jiménez ruiz hernández díaz moreno muñoz álvarez romero navarro".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
NO_NAMES = frozenset(
    "license licence version public general apache gnu mit bsd creative commons copyright rights reserved all terms conditions policy privacy software"
    " university institute company inc ltd gmbh corporation street avenue road city county state north south east west new united states kingdom"
    " january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
    " the this that these those and but for with from und der die das ein eine ist les des une est los las una que".split()
)
FOR = frozenset("ssn social passport born birth birthday dob iban account konto phone tel telephone mobile fax call contact name email mail mr mrs ms dr geboren telefon né née teléfono nacido nacida correo".split())
AGAINST = frozenset("version page pages isbn issn chapter line lines section figure table price total order usd eur copyright updated published released token key secret password hash commit license".split())
#: Top-level domains, country calling codes, and first digits of cards.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk us eu nl ch at be".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421")
CARDS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "35", "6011", "62", "64", "65")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always starts where a run of digits does, as a start within the run would match from there too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# forms of candidates, wider than what any labeller takes for personal
_MAIL = re.compile(r"[\w.%+-]+@[\w.-]+")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9]|\.[0-9])")
_RUN = re.compile(r"(?<![0-9])[0-9]{7,}(?![0-9])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NANP = re.compile(r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])")
_CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])")
_NAME = re.compile(rf"(?:\b(?:{'|'.join(TITLES)})\.? )?\b[A-ZÀ-ÖØ-Þ]\w{{2,20}} [A-ZÀ-ÖØ-Þ]\w{{2,20}}\b")
_FORMS = (("email", _MAIL), ("ip", _QUAD), ("number", _RUN), ("number", _GROUPS), ("phone", _NANP), ("phone", _PLUS), ("account", _CODE), ("birth_date", _DATE))
_WORD = re.compile(r"\w+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a domain of two labels or more, in linear time: each at sign
    with a domain after it takes the whole run of local characters before it, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, ordered."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def form_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all candidates: whatever has such a form. A run of digits as long as a card's is one."""
    found = set()
    if "@" in text or _DIGIT.search(text):
        for name, p in _FORMS:
            for m in p.finditer(text):
                kind = name
                if name == "number" and 14 <= sum(map(str.isdigit, m[0])) <= 19:
                    kind = "card"
                found.add((m.start(), KINDS.index(kind), m.end()))
    found.update((m.start(), KINDS.index("name"), m.end()) for m in _NAME.finditer(text))
    return sorted(found)


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _calendar(s: str) -> bool:
    y, m, d = map(int, s.split("-")) if "-" in s else map(int, reversed(re.split("[./]", s)))
    return 1900 <= y <= 2025 and 1 <= m <= 12 and 1 <= d <= 31


def checked(span: str, kind: int) -> bool | None:
    """Whether check digits and ranges hold; None where there are none."""
    name, digits = KINDS[kind], re.sub("[^0-9]", "", span)
    if name == "card":
        return luhn(digits)
    if name == "account":
        return _iban(span)
    if name == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if name == "phone":
        return 10 <= len(digits) <= 15
    if name == "email":
        return re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}", span.rpartition("@")[2].rstrip(".")) is not None
    if name == "birth_date":
        return _calendar(span)
    return None


def _plan(span: str, kind: int) -> bool | None:
    """Whether a number, domain or address is one that is given out; None where no plan is known."""
    name, digits = KINDS[kind], re.sub("[^0-9]", "", span)
    if name == "card":
        return digits.startswith(CARDS)
    if name == "phone":
        return digits.startswith(CALLING) and not (digits[0] == "1" and (len(digits) != 11 or digits[1] in "01"))
    if name == "ip":
        first = int(span.split(".")[0])
        return 0 < first < 224 and first not in (10, 127) or 224 <= first <= 255 and None
    if name == "email":
        return span.rpartition(".")[2].lower() in DOMAINS
    if name == "number":
        return bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}", span))
    return None


def _said(yes: bool | None) -> str:
    return "0" if yes is None else "1" if yes else "2"


def votes(text: str, s: int, kind: int, e: int, times: int) -> str:
    """What each of LABELLERS says of a candidate that comes so many times in its text: 1 personal, 2 not, 0 nothing."""
    span, name = text[s:e], KINDS[kind]
    around = {w.lower() for w in _WORD.findall(text[max(0, s - 40) : s]) + _WORD.findall(text[e : e + 20])}
    words = [w.rstrip(".").lower() for w in span.split()]
    listed = None
    if name == "name":
        other = any(w in NO_NAMES for w in words)
        listed = False if other else True if words[-2] in GIVEN_NAMES or words[-1] in FAMILY_NAMES or len(words) > 2 else None
    left, right = text[s - 1 : s], text[e : e + 1]
    standing = not (left.isalnum() or right.isalnum() or left in tuple("$€£#/_=\"'") or right in tuple("/_=@\"'"))
    if name == "name":
        varied = len(set(words)) > 1 and None
    else:
        varied = len(set(re.sub(r"\W", "", span))) >= 4
    return "".join(
        (
            _said(_plan(span, kind)),
            _said(checked(span, kind)),
            _said(listed),
            _said(True if around & FOR else None),
            _said(False if around & AGAINST else None),
            _said(standing if name != "name" or not standing else None),
            _said(False if times > 2 else None),
            _said(None if varied is None else bool(varied)),
        )
    )


def described(text: str, s: int, kind: int, e: int) -> list[int]:
    """The candidate's features: hashes of facts of the span and of its surroundings."""
    span = text[s:e]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub("[^\\W\\d_]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", span))))
    before = [w.lower() for w in _WORD.findall(text[max(0, s - 40) : s])][-3:]
    after = [w.lower() for w in _WORD.findall(text[e : e + 20])][:1]
    facts = [f"kind {kind}", f"shape {kind} {shape}", f"long {kind} {min((e - s) // 2, 16)}", *(f"before {w}" for w in before), *(f"after {w}" for w in after), f"sign {text[s - 1 : s]}", f"end {text[e : e + 1]}"]
    if kind == KINDS.index("name"):
        facts += [f"word {w.lower()}" for w in span.split()]
    else:
        facts += [f"starts {kind} {re.sub('[^0-9A-Za-z]', '', span)[:n]}" for n in (1, 2)] + [f"ends {kind} {span.rpartition('.')[2][-4:].lower()}", f"checked {kind} {checked(span, kind)}"]
    return sorted({crc32(f.encode()) % BUCKETS for f in facts})


_SPAN = [T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")]
_BASE = T.ArrayType(T.StructType(_SPAN))
_FOUND = T.ArrayType(T.StructType([*_SPAN, T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))]))


def candidates(docs: DataFrame, text: str, keep_columns: tuple[str, ...], into: tuple[str, str] = ("base", "found")) -> DataFrame:
    """Of each row, the base spans, and all candidates with their votes and features."""

    def row():
        def one(t):
            t = t or ""
            spans = form_spans(t)
            times = Counter(t[s:e] for s, _, e in spans)
            return [{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)], [{"start": s, "kind": k, "end": e, "votes": votes(t, s, k, e, times[t[s:e]]), "features": described(t, s, k, e)} for s, k, e in spans]

        return one

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField(into[0], _BASE), T.StructField(into[1], _FOUND)])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), row, [text])


def train(found: DataFrame, sample: int = SAMPLE, column: str = "found") -> dict:
    """The classifier: the votes of all candidates of each kind are counted, at most 3^8 rows each, and labellers are as
    reliable as they are for that kind; weights come from at most `sample` different candidates."""
    spans = found.select(F.explode(column).alias("x")).select("x.kind", "x.votes", "x.features")
    counted: dict[int, dict[str, int]] = {}
    for kind, pattern, n in spans.groupBy("kind", "votes").count().collect():
        counted.setdefault(kind, {})[pattern] = n
    fitted = {kind: posteriors(patterns, len(LABELLERS), start=(0.9, 0.1), most=True) for kind, patterns in sorted(counted.items())}
    # different candidates only, the first by a hash: as many rows at any size
    few = spans.distinct().orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(sample).collect()
    model = {"w": np.zeros(BUCKETS + 1, np.float32), "posteriors": {k: x[0] for k, x in fitted.items()}, "rates": {k: x[1] for k, x in fitted.items()}, "shares": {k: x[2] for k, x in fitted.items()}}
    if few:
        x = np.zeros((len(few), BUCKETS + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(few):
            x[i, r[2]] = 1
        model["w"] = fit(x, np.array([fitted[r[0]][0][r[1]] for r in few]))
    return model


def probability(w: np.ndarray, features: list[int]) -> float:
    return 1 / (1 + float(np.exp(-np.clip(w[features].sum() + w[-1], -50, 50))))


def added(base: list[dict], found: list[dict], w: np.ndarray) -> list[dict]:
    """Candidates that the classifier finds personal and that overlap neither base spans nor more probable ones."""
    sure = [(probability(w, x["features"]), x) for x in found]
    starts, ends = [x["start"] for x in sorted(base, key=lambda x: x["start"])], sorted(x["end"] for x in base)
    out: list[dict] = []
    held: list[tuple[float, dict]] = []

    def settle() -> None:
        """Of candidates that hang together by overlaps, the most probable, and those that it leaves room for."""
        taken: list[tuple[int, int]] = []
        for _, x in sorted(held, key=lambda h: (-h[0], h[1]["start"], h[1]["kind"], h[1]["end"])):
            if all(x["end"] <= s or e <= x["start"] for s, e in taken):
                taken.append((x["start"], x["end"]))
                out.append(x)

    for p, x in sorted(sure, key=lambda h: (h[1]["start"], h[1]["end"])):
        # a base span overlaps if it starts before this one's end and hasn't ended before its start
        if p < THRESHOLD or bisect_left(starts, x["end"]) > bisect_right(ends, x["start"]):
            continue
        if held and x["start"] >= max(h[1]["end"] for h in held):
            settle()
            held = []
        held.append((p, x))
    settle()
    return out


def decided(found: DataFrame, model: dict, keep_columns: tuple[str, ...], columns: tuple[str, str] = ("base", "found")) -> DataFrame:
    """Counts and a digest of base spans, and all spans that stay."""
    w = model["w"]
    names = [f"n_{k}" for k in BASE]

    def row():
        def listed(spans):
            return ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)

        def one(base, found):
            kept = sorted([*base, *added(base, found, w)], key=lambda x: (x["start"], x["kind"], x["end"]))
            return *(sum(x["kind"] == k for x in base) for k in range(len(BASE))), hashlib.sha256(listed(base).encode()).hexdigest(), listed(kept)

        return one

    schema = T.StructType([*(found.schema[c] for c in keep_columns), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return map_rows(found, schema, list(keep_columns), row, list(columns))


def scan(docs: DataFrame, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    columns = tuple(unused(docs, "base", "found"))
    found = written(candidates(docs, text, keep_columns, columns), "pii")
    return decided(found, train(found, sample, columns[1]), keep_columns, columns)
