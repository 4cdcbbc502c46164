"""Base spans against Python's patterns; the method by planted spans, and its estimates against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymetric.llm.pii import ACCEPT, KINDS, LABELERS, candidates, find_personal_data, reliabilities, votes

DOCS = "doc_id long, text string, row long, kind string, start long, base boolean, v string"
# The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = lambda x: 2 * x - 9 * (x > 4)
    return sum(double(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def told(text):
    spans = [f"{k}:{a}:{b}" for a, _, k, b in base(text)]
    count = Counter(k for _, _, k, _ in base(text))
    return tuple(count[k] for k in KINDS) + (hashlib.sha256(",".join(spans).encode()).hexdigest(),)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x", 6, True, "v") for i, t in enumerate(texts)], DOCS)


def test_base_spans(spark):
    r = random.Random(1)
    parts = ["1", "23", "4567", ".", "-", " ", "+", "@", "a", "b.c", "_", "(", ")", "é", "\U0001f600", "255", "x@y.z", "+1 2", "4111 1111 1111 1111", "10.0.0.1", "=", "%", "[.]", "(at)", " dot "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 100))) for _ in range(1200)] + [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000000255.01.1.1", "256.1.1.1", "a@b-.c..d", "+1 ((2", "4" * 13 + " " + "5" * 40]
    texts += ["7" * 30000, "a@" + "b." * 10000 + "c", "+1" + "(" * 20000, "1-" * 20000, "1." * 20000, "x " * 200_000 + "me@here.org"]
    got = {x.doc_id: x for x in find_personal_data(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) == told(t), t[:200]
        assert set(f"{k}:{a}:{b}" for a, _, k, b in base(t)) <= set(g.spans.split(",")) | {""}
        places = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0])) for x in g.spans.split(",") if x]
        assert places == sorted(places)


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 3_000_000, "1" * 3_000_000, "1 2 " * 500_000, "a.b-" * 500_000]
    assert {(x.n_email, x.n_ip, x.n_card, x.n_phone, x.spans) for x in find_personal_data(frame(spark, texts)).collect()} == {(0, 0, 0, 0, "")}


def corpus(seed):
    """Texts with personal data, strict and written otherwise, and with numbers that are none; and the spans that a reader would mark."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmn") for _ in range(r.randint(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    texts, marks = [], []
    for _ in range(400):
        text, own = word(), []
        for _ in range(r.randint(0, 4)):
            kind, cue, s = r.choice([
                ("email", "mail", f"{word()}.{word()}@{word()}.com"), ("ip", "server", f"{r.randint(1, 200)}.{r.randint(0, 255)}.3.4"), ("card", "card", card()), ("phone", "call", f"+1 (212) 555-{digits(4)}"),
                ("email", "mail", f"{word()} [at] {word()} [dot] org"), ("email", "write to", f"{word()}(at){word()}.{word()}(dot)com"), ("phone", "phone", f"(212) 555-{digits(4)}"), ("phone", "call", f"212-555-{digits(4)}"),
                ("ip", "server", f"{r.randint(1, 200)}[.]20[.]3[.]4"), ("card", "visa", "-".join([x for c in [card()] for x in (c[:4], c[4:8], c[8:12], c[12:])]).replace("-", "/")),
                (None, "invoice", f"{digits(3)}-{digits(3)}-{digits(4)}x"), (None, "version", f"{r.randint(300, 999)}.{digits(3)}.1.2"), (None, "isbn", f"978-{digits(1)}-{digits(2)}-{digits(6)}-1"), (None, "order", f"20{digits(2)}-{digits(2)}-{digits(2)}"),
                (None, "page", "meet at noon dot"),
            ])
            text += f" {word()} {cue} {word() if r.random() < 0.3 else ''} "
            if kind:
                own.append(f"{kind}:{len(text)}:{len(text) + len(s)}")
            text += s + " " + word()
        texts.append(text)
        marks.append(own)
    return texts, marks


def test_planted_spans(spark):
    texts, marks = corpus(3)
    got = {x.doc_id: x.spans.split(",") if x.spans else [] for x in find_personal_data(frame(spark, texts)).collect()}
    want = {(i, m) for i, ms in enumerate(marks) for m in ms}
    found = {(i, m) for i, ms in got.items() for m in ms}
    strict = {(i, f"{k}:{a}:{b}") for i, t in enumerate(texts) for a, _, k, b in base(t)}
    assert strict <= found
    wide = want - strict
    assert len(wide) > 150 and len(found & wide) >= 0.9 * len(wide)
    assert len(found & want) >= 0.97 * len(found)


def test_reliabilities_equal_a_plain_version(spark):
    texts, _ = corpus(4)
    counted = votes(candidates(frame(spark, texts), "doc_id", "text").where("kind is not null")).groupBy("kind", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = [(x.kind, tuple(x.v), x.n) for x in counted.collect()]
    prior, odds = reliabilities(counted, rounds=5)
    sigmoid = lambda x: 1 / (1 + math.exp(-max(min(x, 30), -30)))
    chance = [sigmoid(2 * sum(v)) for _, v, _ in rows]
    for _ in range(5):
        p0, w = {}, {}
        for kind in {k for k, _, _ in rows}:
            own = [(v, n, p) for (k, v, n), p in zip(rows, chance, strict=True) if k == kind]
            yes, no = sum(n * p for _, n, p in own), sum(n * (1 - p) for _, n, p in own)
            p0[kind] = math.log((yes + 1) / (no + 1))
            for j in range(len(LABELERS)):
                for_ = {x: sum(n * p for v, n, p in own if v[j] == x) + (3 if x > 0 else 1) for x in (1, -1)}
                against = {x: sum(n * (1 - p) for v, n, p in own if v[j] == x) + (1 if x > 0 else 3) for x in (1, -1)}
                for x in (1, -1):
                    w[f"{kind}|{j}|{x}"] = math.log(for_[x] / sum(for_.values())) - math.log(against[x] / sum(against.values()))
        chance = [sigmoid(p0[k] + sum(w.get(f"{k}|{j}|{x}", 0) for j, x in enumerate(v))) for k, v, _ in rows]
    assert prior == pytest.approx(p0) and odds == pytest.approx(w)


def test_nulls_empty_tables_and_repeated_rows(spark):
    assert find_personal_data(frame(spark, [])).count() == 0
    assert [x.spans for x in find_personal_data(frame(spark, [None, "", "nothing here"])).collect()] == ["", "", ""]
    df = spark.createDataFrame([(None, "a@b.org"), (7, "a@b.org"), (7, "a@b.org"), (None, None)], "doc_id long, text string")
    assert Counter((x.doc_id, x.spans) for x in find_personal_data(df).collect()) == Counter({(None, "email:0:7"): 1, (7, "email:0:7"): 2, (None, ""): 1})
    assert ACCEPT > 0


def test_built_in_expressions_only(spark):
    plan = votes(candidates(frame(spark, ["a@b.org"]), "doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
