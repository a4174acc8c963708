"""Personal data: the rules against plain patterns, gradients and CRF against brute force, held-out spans, edge rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from flowspark.llm import personal

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, match):
    digits = "".join(c for c in match if c in "0123456789")
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, kind in enumerate(personal.KINDS) for m in PLAIN[kind].finditer(text) if passes(kind, m.group())]


def noise(rng, n):
    parts = ["a", "Zz.", "@", "@b", ".c", "..", "+", "1", "42", "255.", "256.", "0007", "4539148803436467", " ", "-", "(", ")", "é", "x@y.z", "1.2.3.4", "+1 (916) 555-6549", "%", "_", "\n"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_rules_equal_plain_patterns():
    rng = random.Random(2)
    texts = [noise(rng, rng.randint(0, 40)) for _ in range(4000)]
    texts += ["a" * 50_000 + "@", "1" * 50_000, "1." * 20_000, "+1" * 20_000, "a@" * 20_000, "1 " * 20_000, "", "@", "a@b", "a@b.c@d.e"]
    for text in texts[:4000]:
        assert sorted(personal.base_spans(text)[0]) == sorted(brute(text)), text
    for text in texts[4000:]:
        personal.base_spans(text)
    assert personal.base_spans("a@b.c@d.e")[0] == brute("a@b.c@d.e")


def test_windows_hold_all_cues():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "7", " " * 40, "é" * 50, "@", "(at)"]) for _ in range(rng.randint(0, 60)))
        starts = personal.windows(text)
        assert starts == sorted(set(starts))
        for i, c in enumerate(text):
            if c in "7@":
                block = i // personal.STEP
                assert block * personal.STEP in starts and max(0, block - 1) * personal.STEP in starts


def small_net(seed=1):
    net = personal.Network.fresh(seed)
    rng = np.random.default_rng(seed)
    net.w = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in net.w.items()}
    return net


def test_crf_equals_all_paths():
    net, rng = small_net(), np.random.default_rng(5)
    t, k = 5, net.K
    scores = rng.normal(0, 2, (t, 2, k)).astype(np.float32)
    near, best = net.marginals(scores), net.viterbi(scores)
    for b in range(2):
        weight = {}
        for path in itertools.product(range(k), repeat=t):
            s = net.w["first"][path[0]] + net.w["last"][path[-1]] + sum(scores[i, b, y] for i, y in enumerate(path))
            weight[path] = s + sum(net.w["move"][x, y] for x, y in zip(path, path[1:]))
        assert max(weight, key=weight.get) == tuple(best[:, b])
        total = sum(np.exp(v) for v in weight.values())
        for i, y in itertools.product(range(t), range(k)):
            assert abs(sum(np.exp(v) for p, v in weight.items() if p[i] == y) / total - near[i, b, y]) < 1e-4
        _, _, _, log_sum = net._forward_backward(scores)
        assert abs(np.log(total) - log_sum[b]) < 1e-3


def test_gradients_equal_differences():
    net, rng = small_net(2), np.random.default_rng(6)
    ids, truth = rng.integers(0, 20, (3, 7)), rng.integers(0, net.K, (3, 7))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grad = net.loss(ids, truth)
    for name, w in net.w.items():
        used = [i for i in np.ndindex(*w.shape) if name != "input" or i[1] < 20]
        for at in [used[i] for i in rng.choice(len(used), 6)]:
            old, step = w[at], 1e-2
            w[at] = old + step
            up = net.loss(ids, truth)[0]
            w[at] = old - step
            down = net.loss(ids, truth)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3 + 0.03 * abs(grad[name][at]), (name, at)


def test_model_survives_bytes():
    net = small_net(3)
    again = personal.Network.from_bytes(net.to_bytes())
    assert all((net.w[k] == again.w[k]).all() for k in net.w)


def test_reconciled_takes_the_heaviest_set():
    text = "1" * 400
    rng = random.Random(8)
    for _ in range(200):
        said = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 60)
            b = a + rng.randint(6, 20)
            said.append((len(said) % 4, a, b, (b - a) * rng.uniform(0.9, 1)))
        said = [s for i, s in enumerate(said) if not any(o[0] == s[0] and o[1] < s[2] and s[1] < o[2] for o in said[:i])]
        base = [(1, 30, 34)] if rng.random() < 0.5 else []
        free = [s for s in said if not any(s[1] < b and a < s[2] for _, a, b in base)]
        best = 0.0
        for n in range(len(free) + 1):
            for some in itertools.combinations(free, n):
                if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(some, 2)):
                    best = max(best, sum(s[3] for s in some))
        found = personal.reconciled(text, said, base, [])
        assert all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(found, 2))
        assert abs(sum(s[3] for s in said if s[:3] in found) - best) < 1e-6


def test_cut_stretches_are_united_and_refused_ones_left():
    text = " " * 40 + "1" * 40 + " " * 40
    assert personal.reconciled(text, [(2, 40, 70, 29.0), (2, 60, 80, 19.5)], [], []) == [(2, 40, 80)]
    assert personal.reconciled(text, [(2, 40, 80, 39.0)], [], [(2, 41, 80)]) == []
    assert personal.reconciled(text, [(2, 40, 80, 39.0)], [], [(3, 41, 80)]) == [(2, 40, 80)]
    assert personal.reconciled(text, [(2, 40, 80, 30.0)], [], []) == []


def sentences(rng, n):
    """Texts with one match of a kind each, and texts with harmless numbers."""
    words = ["we", "met", "near", "house", "and", "then", "Call", "mail", "on", "for", "the", "report,", "über", "é."]
    made = []
    for i in range(n):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if personal.luhn(digits + c))
        other = [
            f"{rng.choice(words).strip('.,')}.{rng.randint(1, 99)}@mail{rng.randint(1, 99)}.example.{rng.choice(['com', 'org'])}",
            ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
            f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        ][i % 4]
        before, after = (" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(2))
        made.append((i % 4, before, other, after))
    return made


@pytest.fixture(scope="module")
def model(spark):
    made = sentences(random.Random(1), 900)
    docs = spark.createDataFrame([(i, f"{a} {m} {b}") for i, (_, a, m, b) in enumerate(made)], "doc_id long, text string")
    return personal.fit(docs)


def test_held_out_spans_in_unknown_forms(model):
    rng = random.Random(77)
    tagger, right, wrong = personal.Tagger(personal.Network.from_bytes(model)), {k: 0 for k in range(4)}, 0
    made = sentences(rng, 200)
    for kind, before, match, after in made:
        other = personal.rewritten(kind, match, rng)
        text = f"{before} {other} {after}"
        known = personal.base_spans(text)
        found = tagger.added([text], [known])[0]
        at = len(before) + 1
        covered = any(k == kind and a < at + len(other) and at < b for k, a, b in found + known[0])
        right[kind] += covered or any(k == kind for k, *_ in known[1])
        text = f"{before} {personal.harmless(rng)} {after}"
        wrong += bool(tagger.added([text], [personal.base_spans(text)])[0])
    assert all(n >= 40 for n in right.values()), right
    assert wrong <= 8


def test_find_on_edge_rows(spark, model):
    rows = [(1, None, "c", "c"), (2, "", "c", "c"), (3, "no data at all " * 5000, "c", "c"), (None, "x.y@z.org", "c", "c"), (3, "ip 10.0.0.1 and +44 20 7946 0958", None, None)]
    rows += [(4, "w " * 60_000 + "4539148803436467 end", "c", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, added string").repartition(3)
    found = sorted(((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in personal.find(docs, model=model).collect()), key=repr)
    told = [(i, [(personal.KINDS[k], a, b) for k, a, b in sorted(brute(t or ""))], []) for i, t, *_ in rows]
    assert found == sorted(told, key=repr)
    assert personal.find(docs.limit(0)).isEmpty()
    assert personal.find(docs.where("doc_id = 2")).first()["added"] == []


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in personal.query(spark, sf).collect():
        spans = sorted(brute(texts[r["doc_id"]]))
        line = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(",")) and len(r["spans"].split(",") if r["spans"] else []) == len(spans) + r["n_added"]


def test_masked():
    assert personal.masked("mail a@b.c or 1.2.3.4!", [(0, 5, 10), (1, 14, 21)]) == "mail [email] or [ip]!"
