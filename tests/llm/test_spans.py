import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import pii, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KEYS = ("assign", "access", "hex")


def secret_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32]
    return sorted(out)


def secret_texts(make_prose):
    rng = random.Random(16)
    parts = ["password: ", "PassWd=", "secret = 'abcdefgh1234'", 'api_key":"short"', "APIKEY = longenough1", "token:abc", "AKIA" + "B" * 12, "AKIA" + "B" * 11, "AKIAAKIA" + "C7" * 8, "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g", "é😀", "deadbeef" * 5, "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "tokentoken=tokentoken", "secret\n=abcdefghi"]
    return [" ".join(rng.choice([make_prose(rng, 4), *parts]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None]


@pytest.mark.parametrize("most", [0, 10**6])
def test_secrets_against_plain_regexes(spark, make_prose, monkeypatch, most):
    from lumenfold.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    texts = secret_texts(make_prose)
    got = {r["doc_id"]: r for r in secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = secret_spans(t or "")
        line = ",".join(f"{KEYS[k]}:{s}:{e}" for s, k, e in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t, r["spans"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in KEYS] == (line.split(",") if line else [""][:0])
    assert any("github" in r["spans"] for r in got.values()) and any("private_key" in r["spans"] for r in got.values())


def test_redaction_takes_out_every_span(spark, make_prose):
    texts = secret_texts(make_prose)
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secrets.RULES[:3]).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        out, at = "", 0
        for s, _, e in secret_spans(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
                at = e
            else:
                at = max(at, e)
        assert got[i] == out + t[at:]


def test_trigram_queries():
    assert secrets.required("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.required("[0-9a-f]{32,}") == [[]]
    assert secrets.required("ab(cd|ef)g") == [["abc", "bcd", "cdg"], ["abe", "bef", "efg"]]
    assert secrets.required("abcd?efgh") == [["abc", "bcd", "cde", "def", "efg", "fgh"], ["abc", "bce", "cef", "efg", "fgh"]]
    assert secrets.required("gh[pu]_") == [["ghp", "hp_"], ["ghu", "hu_"]]
    assert secrets.required("gh[^p]_x") == secrets.required("gh[a-z]_x") == [[]]
    assert secrets.required("(abc)+xyz") == [["abc", "xyz"]]
    assert secrets.required("(?:ab|[0-9])xyz") == [["xyz"]]
    assert secrets.required("(?:abc|x)") == [[]]
    assert all([] not in secrets.required(r.pattern) for r in secrets.RULES if r.kind != "hex")


def test_lookout_finds_every_wanted_trigram():
    rng = random.Random(25)
    wanted = sorted({"".join(rng.choices("ab.-\\", k=3)) for _ in range(40)})
    for _ in range(50):
        t = "".join(rng.choices("ab.-\\c", k=80))
        assert {m[1] for m in re.finditer(secrets.lookout(wanted), t)} == {t[i : i + 3] for i in range(78)} & set(wanted)


def test_intersections_of_postings(spark, make_prose):
    texts = [t or "" for t in secret_texts(make_prose)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trigrams, queries = secrets.plans(secrets.RULES)
    index = secrets.postings(docs, trigrams)
    got = {r["doc"]: set(r["rules"]) for r in secrets.candidates(index, queries).collect()}
    for i, t in enumerate(texts):
        have = {t.lower()[k : k + 3] for k in range(len(t))}
        assert got.get(i, set()) == {k for k, q in queries.items() if [] not in q and any(set(w) <= have for w in q)}
    again = secrets.scan(docs, index=index).select("doc_id", "spans").collect()
    assert sorted(again) == sorted(secrets.scan(docs).select("doc_id", "spans").collect())


def test_more_trigrams_than_a_mask_has_bits(spark):
    words = [f"{a}{b}{a}{b}x{a}" for a in "abcdefghij" for b in "klmnopqrst"]
    rules = tuple(secrets.Rule(w, w + "[0-9]+", base=True) for w in words)
    assert len(secrets.plans(rules)[0]) > 200
    docs = spark.createDataFrame([(i, f"some {w}{i} text") for i, w in enumerate(words)], "doc_id long, text string")
    rows = secrets.digests(docs, rules).select("doc_id", "spans").collect()
    assert {r["doc_id"]: r["spans"] for r in rows} == {i: f"{w}:5:{5 + len(w) + len(str(i))}" for i, w in enumerate(words)}


def test_added_kinds_against_plain_regexes(spark):
    rng = random.Random(26)
    alnum = "abcXYZ0189"
    run = lambda n: "".join(rng.choices(alnum, k=n))
    samples = {
        "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN public KEY-----"],
        "github": [f"gh{c}_" + run(n) for c in "pousrx" for n in (35, 36, 40)],
        "slack": [f"xox{c}-" + run(n) for c in "abprsz" for n in (9, 10)],
        "google": ["AIza" + run(34), "AIza" + run(35), "aiza" + run(35)],
        "jwt": [f"eyJ{run(n)}.eyJ{run(12)}.{run(11)}" for n in (9, 10, 20)] + ["eyJ" + run(20)],
        "live_key": ["sk_live_" + run(n) for n in (15, 16)],
    }
    assert set(samples) == {r.kind for r in secrets.RULES if not r.base}
    parts = [x for v in samples.values() for x in v]
    texts = [" ".join(rng.choices([*parts, "plain words", "é😀"], k=6)) for _ in range(200)]
    rows = secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    met = set()
    for r in rows:
        t = texts[r["doc_id"]]
        want = sorted((m.start(), i, m.end()) for i, rule in enumerate(secrets.RULES) if not rule.base for m in re.finditer(rule.pattern, t))
        got = [x for x in r["spans"].split(",") if x and x.split(":")[0] in samples]
        assert got == [f"{secrets.RULES[i].kind}:{s}:{e}" for s, i, e in want]
        met |= {secrets.RULES[i].kind for _, i, _ in want}
    assert met == set(samples)


def test_names_that_clash(spark):
    rows = [(1, "password: hunter2hunter2", 1, 2, 3, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, hash int, other int, rules string, spans int")
    assert secrets.redacted(docs).collect() == spark.createDataFrame([(1, "[SECRET]", 1, 2, 3, "x", 5)], docs.schema).collect()
    assert secrets.scan(docs, into="found").columns == [*docs.columns, "found"]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_every_match_satisfies_its_trigram_query(data):
    rule = data.draw(st.sampled_from(secrets.RULES))
    query = secrets.required(rule.pattern)
    m = data.draw(st.from_regex(re.compile(rule.pattern, re.A), fullmatch=True)).lower()
    assert any(all(t in m for t in way) for way in query)


# personal data

BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(t):
    out = []
    for k, p in enumerate(BASE):
        for m in p.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn(digits) or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+%0123 ()é", max_size=60))
def test_base_spans_are_the_patterns(t):
    assert pii.base_spans(t) == base_spans(t)


@pytest.mark.parametrize("t", ["a@b.c@d.e", "a@@b.c", "x@y", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "1.2.3.4@a.b", "00000000000000"])
def test_base_spans_of_hard_cases(t):
    assert pii.base_spans(t) == base_spans(t)


def test_classifier_adds_spans_and_keeps_base_ones(spark, make_prose):
    rng = random.Random(17)
    rows = []
    for i in range(400):
        t = make_prose(rng, 40)
        if i % 4 == 0:
            t += f" her ssn {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is"
        if i % 4 == 1:
            t += f" mail me@site{i}.example.com or +1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} now"
        if i % 4 == 2:
            t += f" version {rng.randint(1, 28)}.{rng.randint(1, 12)}.1820 released token={rng.randint(10**9, 10**10)}ab"
        rows.append((i, t))
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [s.split(":") for s in got[i].split(",") if s]
        want = base_spans(t)
        assert set(want) <= {(int(s), pii.KINDS.index(k), int(e)) for k, s, e in spans}
        assert any(k == "number" and t[int(s) : int(e)].count("-") == 2 for k, s, e in spans) == (i % 4 == 0)
        assert i % 4 < 2 or not spans


def test_classifier_finds_what_base_patterns_run_together(spark, make_prose):
    rng = random.Random(27)

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows, pairs = [], []
    for i in range(300):
        phone, number, other = f"+1 ({rng.randint(200, 900)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", card(), card()
        t = make_prose(rng, 20)
        if i % 10 == 0:
            t += f" {number} {other} "
            pairs.append((i, [number, other]))
        elif i % 10 == 1:
            t += f" {phone} {number} "
            pairs.append((i, [number]))
        elif i % 10 == 2:
            t += f" id {'9' + ''.join(rng.choices('0123456789', k=15))} "
        else:
            t += f" {phone} and {number}"
        rows.append((i, t + make_prose(rng, 20)))
    texts = dict(rows)
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, wanted in pairs:
        assert not [1 for _, k, _ in base_spans(texts[i]) if k == 2]
        found = {texts[i][int(s) : int(e)] for k, s, e in got[i] if k == "card"}
        assert set(wanted) <= found, (wanted, got[i])
    for i, spans in got.items():
        places = sorted((int(s), int(e)) for _, s, e in spans)
        assert all(b[0] >= a[1] for a, b in zip(places, places[1:], strict=False))


def test_added_spans_never_overlap():
    rng = random.Random(28)
    w = [rng.gauss(0, 3) for _ in range(9)]
    import numpy as np

    w = np.array(w)
    for _ in range(300):
        make = lambda n: [{"start": (s := rng.randint(0, 60)), "kind": rng.randint(0, 7), "end": s + rng.randint(1, 12), "features": [rng.randint(0, 7)]} for _ in range(n)]
        base, at = [], 0
        for x in sorted(make(4), key=lambda x: x["start"]):
            if x["start"] >= at:
                base.append(x)
                at = x["end"]
        found = make(12)
        out = pii.added(base, found, w)
        # one by one: the most probable first, as long as it overlaps none
        left, want = sorted([x for x in found if pii.probability(w, x["features"]) >= pii.THRESHOLD], key=lambda x: (-pii.probability(w, x["features"]), x["start"], x["kind"], x["end"])), []
        for x in left:
            if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in [*base, *want]):
                want.append(x)
        assert sorted(map(str, out)) == sorted(map(str, want))


def test_reliabilities_are_those_of_a_plain_estimation():
    """Expectation-maximisation a candidate at a time, without patterns, against posteriors()."""
    import math

    from lumenfold.llm.weak_labels import posteriors

    rng = random.Random(29)
    rows = []
    for _ in range(400):
        truth = rng.random() < 0.4
        rows.append("".join("0" if rng.random() < 0.3 else "1" if (rng.random() < a) == truth else "2" for a in (0.95, 0.85, 0.75, 0.6)))
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    p = [0.9 if r.count("1") > r.count("2") else 0.1 for r in rows]
    for _ in range(60):
        share = (sum(p) + 1) / (len(rows) + 10)
        rate = [[{}, {}, {}, {}], [{}, {}, {}, {}]]
        for c in (0, 1):
            q = p if c == 0 else [1 - x for x in p]
            for j in range(4):
                n = [sum(x for x, r in zip(q, rows, strict=True) if r[j] == v) + 1 for v in "012"]
                rate[c][j] = [x / sum(n) for x in n]
        for j in range(4):
            rate[1][j][1] = min(rate[1][j][1], rate[0][j][1])
            rate[0][j][2] = min(rate[0][j][2], rate[1][j][2])
        for i, r in enumerate(rows):
            a, b = (math.prod(rate[c][j][int(v)] for j, v in enumerate(r)) * s for c, s in ((0, share), (1, 1 - share)))
            p[i] = a / (a + b) if "1" in r else min(a / (a + b), 0.1)
    first, _, got = posteriors(counts, 4, steps=60, start=(0.9, 0.1), most=True)
    assert abs(got - share) < 1e-9
    assert all(abs(first[r] - x) < 1e-9 for r, x in zip(rows, p, strict=True))


def test_labellers_may_say_both():
    t = "call +1 (213) 555-0100 or card 4111111111111111, see 999.1.1.1 and token=1234567890 of John Smith, MIT License"
    said = {t[s:e]: pii.votes(t, s, k, e, 1) for s, k, e in pii.form_spans(t)}
    assert said["4111111111111111"][:2] == "11" and said["999.1.1.1"][1] == "2" and said["1234567890"][4:6] == "22"
    assert said["John Smith"][2] == "1" and said["MIT License"][2] == "2" and said["+1 (213) 555-0100"][:2] == "11"
