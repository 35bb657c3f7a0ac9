import hashlib
import random
import re

from lendmend.llm import pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[name]()
            if ok:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


HAND = [
    "mail a.b+c@x-y.example.com, or c@d.e.f@g.h and z%@q.rs_t@u.vw", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 5500005555555559 12 34-56", "call +1 (509) 555-6973 190. +49(0)30 123456- x +12",
    "😀 é +44 20 7946 0958 😀 4012888888881881 é a@b.cd", None, "", "+", "@.@", "a" * 50_000 + "@", "1 " * 60_000, "9" * 40_000,
    "x@" + "a." * 20_000 + "b", "+1" + "(" * 30_000, "1." * 30_000, "-" * 1000 + "7" + "-" * 1000,
]


def test_query_equals_brute_force(spark, saved):
    rng = random.Random(7)
    noise = ["".join(rng.choice("ab1290+@. -()é") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts = HAND + noise
    path = saved(documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    got = queries.op9_pii(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        shown = ",".join(f"{n}:{a}:{e}" for a, _, e, n in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def test_trees_add_lookalikes_of_true_spans(spark, docs):
    """True and false base matches teach the trees; a national phone number is added, noise is not."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(600):
        rows.append((i, f"call my phone +49 30 {number(7)} today" if i % 2 else f"serial {number(16)} of 999.{number(3)}.1.1"))
    rows += [(9000, "call my phone 0049 30 1234567 today"), (9001, "reach me at joe (at) example (dot) org")]
    found = {r.id: r for r in pii.find_pii(docs(rows)).collect()}
    assert all(len(found[i].base) == 1 for i in range(1, 600, 2))
    assert len(found[9000].spans) == 1 and not found[9000].base


def test_trees_and_threshold_see_every_known_match(docs, monkeypatch):
    """More matches of the base patterns than a former sample held: all are used, each once, and cuts are exact."""
    fitted, judged = [], []

    class Watched(pii.GBTClassifier):
        def fit(self, df):
            attributes = df.schema["vector"].metadata["ml_attr"]
            fitted.append((df.count(), list(attributes["attrs"]), attributes["num_attrs"]))
            model = super().fit(df)
            real = model.transform
            model.transform = lambda rows: judged.append(rows.count()) or real(rows)
            return model

    monkeypatch.setattr(pii, "GBTClassifier", Watched)
    good = " ".join(f"u{i}@h.io" for i in range(400))
    bad = " ".join(f"999.{i}.1.1" for i in range(400))
    given = docs([(i, f"{good} {bad}") for i in range(15)])
    assert {len(r.base) for r in pii.find_pii(given).collect()} == {400}
    known = pii.proposals(given).selectExpr("size(filter(found, x -> x.base is not null)) AS n").agg({"n": "sum"}).first()[0]
    assert fitted[0][0] + judged[0] == known > 25_000
    assert fitted[0][1] == ["binary"] and fitted[0][2] > len(pii.FEATURES)


def test_edge_cases(spark, docs):
    assert pii.find_pii(docs([])).count() == 0
    rows = [(None, "a@b.cd"), (4, "a@b.cd"), (4, "a@b.cd"), (5, None)]
    got = pii.find_pii(docs(rows)).collect()
    assert sorted((str(r.id), len(r.spans)) for r in got) == [("4", 1), ("4", 1), ("5", 0), ("None", 1)]
    one = docs([(1, "from a@b.cd and +1 (509) 555-6973."), (2, None)])
    clean = {r.doc_id: r.text for r in pii.redacted(one, pii.find_pii(one)).collect()}
    assert clean == {1: "from [email] and [phone].", 2: ""}


def test_long_lists_keep_their_places(docs):
    text = " ".join(f"u{i}@h.io" for i in range(700))
    got = pii.find_pii(docs([(1, text)])).first()
    assert [(x.start, x.end) for x in got.base] == [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
