"""Base patterns against plain regular expressions; unseen identifiers after learned contexts; redaction."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.llm import pii
from quillet.llm.pii import KINDS, base_spans, digest, find_pii, learn_patterns

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(double) % 10 == 0


def plain(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    "", "a@b.c", "a@@b.c x@y", "a.b+c@d-e.f.gh, .@-.-", "x@y.z@w.v", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 999.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (234) 567-8901 +12345678 +123456789 +1234567890123456",
    "é@b.co ü 1.2.3.4", "1234567890123456789012345678901234567890", "+49 30 1234567.", "a@b..c", "5500 0000 0000 0004 5500 0000 0000 0004", "+1-+1 234 567 8901",
]


def test_base_patterns():
    for text in CASES:
        assert base_spans(text) == plain(text), text


@settings(max_examples=500, deadline=None)
@given(st.text("0123456789.+-() @aZ%é4111", max_size=60))
def test_base_patterns_on_any_text(text):
    assert base_spans(text) == plain(text)


def corpus():
    rng = random.Random(6)
    rows = [(i, f"{rng.random()} please write to user{i}@mail{i % 7}.org or phone me") for i in range(40)]
    rows += [(100 + i, f"filler {i} please write to name{i} (at) host{i} . net now") for i in range(3)]
    rows += [(200 + i, f"filler {i} we went to user{i} and came back to nobody") for i in range(40)]
    return rows + [(300, None), (301, ""), (302, "no data " * 20_000), (303, "write to"), (None, "please write to a@b.cd")]


def test_contexts_find_unseen_identifiers(make):
    rows = corpus()
    df = make(rows)
    got = {r.doc_id: list(r.pii) for r in find_pii(df).select("doc_id", "pii").collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[key] if s["base"]] == plain(text or "")
    added = {k: [text_of(rows, k)[s["start"] : s["end"]] for s in v if not s["base"]] for k, v in got.items()}
    assert all(added[100 + i][0].startswith(f"name{i} (at) host{i}") for i in range(3))
    assert not any(added[k] for k in added if k is None or k < 100 or k >= 200)


def text_of(rows, key):
    return next(t for k, t in rows if k == key) or ""


def test_redaction_and_digest(make):
    rows = [(1, "mail é@b.co x a@b.co, 1.2.3.4!"), (2, None), (3, "4111 1111 1111 1111 and +1 234 567 8901")]
    found = find_pii(make(rows), patterns=[], redacted="t")
    got = {r.doc_id: (r.t, r.d) for r in found.select("doc_id", "t", digest(F.col("pii")).alias("d")).collect()}
    assert got[1] == ("mail é@b.co x [EMAIL], [IP]!", "email:14:20,ip:22:29")
    assert got[2] == (None, "") and got[3][0] == "[CARD] and [PHONE]"


def test_empty_tables_and_repeated_rows(make):
    assert find_pii(make([])).count() == 0 and learn_patterns(make([])) == []
    assert find_pii(make([(1, "a@b.cd"), (1, "a@b.cd")])).count() == 2


def test_no_pattern_is_cut_and_blocks_change_nothing(make, monkeypatch):
    # contexts of common words that mostly precede no address have the most seeds; the trustworthy one has the fewest
    rows = [(i, f"go to a{i}@b{i % 9}.org now") for i in range(60)] + [(100 + i, f"go to nobody {i}") for i in range(400)]
    rows += [(600 + i, f"contact address c{i}@d.org here") for i in range(9)] + [(700, "contact address eve (at) host now"), (701, "go to eve (at) host now")]
    rows += [(800 + i, f"reach phone: +1 234 567 {8000 + i}") for i in range(12)]
    df = make(rows)
    whole = {r.doc_id: list(r.pii) for r in find_pii(df).select("doc_id", "pii").collect()}
    assert [s["base"] for s in whole[700]] == [False] and not whole[701]
    monkeypatch.setattr(pii, "BLOCK", 1)
    monkeypatch.setattr(pii, "MAX_PATTERNS", 1, raising=False)
    assert len(learn_patterns(df)) == 2
    assert {r.doc_id: list(r.pii) for r in find_pii(df).select("doc_id", "pii").collect()} == whole


def brute(rows):
    """All spans of each row, by the method in plain Python: words of the text, pairs of words, and their scores in rounds."""
    word = re.compile(r"[^\x20\x09-\x0d]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    texts = {k: t or "" for k, t in rows}

    def places(text):
        w = list(word.finditer(text))
        for x, y in zip(w, w[1:], strict=False):
            at = y.end() + len(text[y.end() :]) - len(text[y.end() :].lstrip())
            yield (lower(x[0]), lower(y[0])), at

    seeds, edges = {}, {}
    for text in texts.values():
        starts = {}
        for kind, a, b in plain(text):
            starts.setdefault(a, []).append((kind, text[a:b]))
        for pair, at in places(text):
            for kind, seed in starts.get(at, ()):
                seeds.setdefault((kind, pair), set()).add(seed)
    candidates = {k for k, v in seeds.items() if len(v) >= pii.MIN_SEEDS}
    for text in texts.values():
        ends = {(kind, a): b for kind, a, b in plain(text)}
        for pair, at in places(text):
            for kind in KINDS:
                if (kind, pair) in candidates:
                    end = ends.get((kind, at))
                    m = None if end else pii._SHAPES[kind].match(text, at)
                    e = (kind, pair, text[at:end] if end else m[0] if m else None, bool(end))
                    edges[e] = edges.get(e, 0) + 1
    mean = lambda pairs: sum(n * x for n, x in pairs) / sum(n for n, _ in pairs)

    def scored(trust):
        own = {}
        for (kind, pair, what, seed), n in edges.items():
            own.setdefault((kind, pair), []).append((n, 1.0 if seed else trust.get((kind, what), 0.0)))
        return {k: mean(v) for k, v in own.items()}

    score = scored({})
    for _ in range(pii.ROUNDS):
        by = {}
        for (kind, pair, what, seed), n in edges.items():
            if not seed and what is not None:
                by.setdefault((kind, what), []).append((n, score[kind, pair]))
        score = scored({k: mean(v) for k, v in by.items()})
    trusted = {k for k, x in score.items() if x >= pii.CONFIDENCE}
    out = {}
    for key, text in texts.items():
        found = [(*s, True) for s in plain(text)]
        added = sorted({(at, kind, m.end()) for pair, at in places(text) for kind in KINDS if (kind, pair) in trusted and (m := pii._SHAPES[kind].match(text, at))})
        for a, kind, b in added:
            if not any(x < b and a < y for _, x, y, _ in found):
                found.append((kind, a, b, False))
        out[key] = sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def learned_corpus(seed):
    rng, rows = random.Random(seed), []
    leads = ["mail me", "Write To", "call on", "server at", "paid with", "née à", "the x"]
    for i in range(260):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            lead, k = rng.choice(leads), rng.randrange(30)
            what = {"mail me": f"u{k}@h{k % 5}.org", "Write To": f"w{k}@h.net", "call on": f"+1 234 567 80{k:02d}", "server at": f"10.0.{k}.1", "paid with": "4111 1111 1111 1111", "née à": f"ü{k}@x.fr", "the x": "nothing"}[lead]
            if rng.random() < 0.08:
                what = rng.choice([f"v{k} (at) host{k % 3} . net", f"10-0-{k}-7", f"(234) 567-80{k:02d}", "no such thing"])
            parts += [rng.choice(["so", "and\n", "é"]), lead, rng.choice(["", "  \t"]) + what, rng.choice(["then", ", ok."])]
        rows.append((i, " ".join(parts)))
    return [*rows, (900, None), (901, "mail me"), (902, "mail me " * 300), (903, " ".join(f"mail me z{i}@q.org" for i in range(400)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_spans_against_the_method_in_plain_python(make, seed):
    rows = learned_corpus(seed)
    got = {r.doc_id: [tuple(s) for s in r.pii] for r in find_pii(make(rows)).select("doc_id", "pii").collect()}
    want = brute(rows)
    assert got == want and sum(not s[3] for v in want.values() for s in v) > 0


def test_many_hits_in_one_long_text(make):
    text = " ".join(f"mail me z{i} (at) q{i} . org" if i % 2 else f"mail me é{i}@q.org" for i in range(10_000))
    h = pii._pattern_hashes(["mail me"]).view("int64").tolist()[0]
    got = find_pii(make([(1, text)]), patterns=[("email", h)]).select("pii").first()[0]
    assert len(got) == 10_000 and all(text[s["start"] : s["end"]].startswith("z") for s in got if not s["base"]) and sum(not s["base"] for s in got) == 5000
