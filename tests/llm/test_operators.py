"""Each text operator against brute force, a round trip or held-out labels; edge rows and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import ann, chat, components, contamination, html_text, mixing, quality, queries, simhash, similar, substrings, toxicity, url_filter
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, null and empty texts, one long word, a repeated row, a clashing column."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=45))
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 90)))
        if i % 3 == 0:
            text = f"{text} {passage}\t{text}"
        rows.append((i, text, ["b", "a", None][i % 3], "x"))
    rows += [(100, rows[3][1], "a", "x"), (101, rows[6][1] + " more", "é", "x"), (102, None, None, None), (103, "", "", "x"), (104, " \t\n", "a", "x")]
    rows += [(105, "a " * 3000, "b", "x"), (106, "z" * 5000, "b", "x"), rows[3]]
    return spark.createDataFrame(rows, DOCS)


def brute_components(prints, near):
    ids = sorted(prints)
    low = {i: i for i in ids}
    while True:
        moved = False
        for a in ids:
            for b in ids:
                if near(prints[a], prints[b]) and low[b] < low[a]:
                    low[a], moved = low[b], True
        if not moved:
            return low


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    result = queries.queries()[name](spark, SF_DIR).toArrow()
    assert result.num_rows > 0
    assert compare(result, duck(SF_DIR).sql(queries.oracle_sql()[name]).to_arrow_table()) == []


def test_mix_takes_near_targets_and_repeats(spark, docs):
    one = mixing.mix_sources(docs).collect()
    assert sorted(map(str, one)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert len(one) == docs.count()
    for source in {r["source"] for r in one}:
        rows = [r for r in one if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-6
        assert rows[0]["target"] <= 3 * rows[0]["source_size"] and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.repeated_rows(mixing.mix_sources(docs)).count() == sum(r["repeats"] for r in one)


def test_simhash_equals_all_pairs(spark, docs):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect()}
    low = brute_components(want, lambda a, b: (a ^ b).bit_count() <= 4)
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == docs.count()
    assert all((r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", low[r["doc_id"]]) for r in got)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_hot_shards_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 16)
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 1 << 12, 150)]
    rows = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in set(prints)], "fp binary")
    links = simhash.near_links(rows, 64, 4, 5, 13)
    roots = {bytes(r["node"]): bytes(r["root"]) for r in components.connected_components(links).collect()}
    low = brute_components({p: p for p in set(prints)}, lambda a, b: (a ^ b).bit_count() <= 4)
    for a in set(prints):
        for b in set(prints):
            same = roots.get(a.to_bytes(8, "big"), a) == roots.get(b.to_bytes(8, "big"), b)
            assert same == (low[a] == low[b]) or a == b


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, None)]
    roots = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[i] for i in range(1000, 1100)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots


def test_substrings_equal_brute_force(spark, docs):
    seen, want = set(), {}
    for r in sorted(docs.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"]):
        w = (r["text"] or "").encode().split()
        out = set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            out |= set(range(p, p + 20)) if key in seen else set()
            seen.add(key)
        want[r["doc_id"]] = (len(w), len(out), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in out)).hexdigest())
    got = substrings.dedup_substrings(docs).collect()
    assert len(got) == docs.count() and all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert any(w[1] for w in want.values())
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 22, 200])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, shard_bytes):
    monkeypatch.setattr(contamination, "SHARD_BYTES", shard_bytes)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, " ".join(texts[3].split()[-40:-10])), (10, "W5 w6, w7"), (2, "w9"), (3, None), (4, "..."), (5, " ".join(texts[4].split()[2:15])), (5, "w5 w6 w7")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.find_contamination(docs, table).collect()
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    for r in got:
        w, hit, of = split(r["text"]), set(), set()
        for item, text in items:
            x = split(text)
            n = min(13, len(x))
            for i in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[i : i + n]:
                        hit |= set(range(p, p + n))
                        of.add(str(item))
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == (len(w), len(hit), sorted(of))
    assert contamination.find_contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_url_aliases_and_allow_precedence(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.org/1", link.format("https://x.net/fr/a?b=1&amp;c=2")), (2, "http://b.org/2#top", '<META http-equiv=refresh content="0;URL=http://a.org/1">'),
        (3, "http://c.org/d/e", link.format("../z")), (4, "http://shop.com/en/", link.format("http://a.org/1")), (5, None, None), (6, "no scheme", ""),
        (7, "HTTP://WWW.Example.com/en/q?x", ""), (8, "http://m.example.com/en/q", None), (9, "http://o.org/x", link.format("http://x.net/es/y")),
    ]
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # Page 4 is allowed by rule and an alias of 1 and 2, so its allow beats the block they inherit.
    assert got[1][2] == got[2][2] == got[4][2] == "allow" and got[9][2] == "block"
    assert got[7] == ("www.example.com", "www.example.com/en/", "allow") and got[8][1:] == ("example.com/en/", "block")
    assert got[5] == got[6] == ("", None, "allow") and got[3][2] == "allow"


def test_chat_round_trip_over_batches(spark):
    texts = [chat.PROBE, None, "", "a\\", "\\\\### x: y </turn>\n", "é漢" * 40, "<<##\\"]
    rows = [(c, t, ["user", "assistant", None, "a: b\\"][(c + t) % 4], texts[(c * 3 + t) % 7]) for c in range(9) for t in range(7)]
    rows += [(None, None, "user", "x"), rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # conversations run over batches
    try:
        got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(turns)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] is not None, r[2] or "", r[3] or ""))
        all_text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256(all_text.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_html_template_and_boilerplate(spark):
    page = (
        '<html><head><title>t</title></head><body><nav>menu {i}</nav><div class="cookie-notice">take {i}</div><p>Same line</p>'
        "<div><h1>Head {i} &amp; more</h1><p>one <b>two<br>three {i}<p>Next   para {i}</div><form><input>f</form><section id=comments>c {i}</section></body>"
    )
    rows = [(i, "http://h.org/", page.format(i=i)) for i in range(8)] + [(50, None, None), (51, "http://h.org/x", ""), (52, "http://k.org", "<article>a<!-- x --><aside>no</aside> b</article><p>c")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 & more\n\none two three 3\n\nNext para 3"
    assert got[50] == got[51] == "" and got[52] == "a\n\nb"  # a block ends where an aside stands


def test_html_copies_count_as_one_page(spark):
    page = "<html><body><p>Same line</p><div><h1>Head {i}</h1><p>Text {i}</p></div></body></html>"
    rows = [(i, "http://h.org/", page.format(i=max(0, i - 94))) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {max(0, i - 94)}\n\nText {max(0, i - 94)}" for i in range(100)}


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (7, x[7].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(vectors, F.pmod("vec_id", F.lit(20)) == 0).collect()
    found, exact = {}, x.astype(np.float64)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 1200, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(1200), -score))[:20].tolist()
        assert len(found[q]) == 20 and q not in found[q]
        hits += len(set(want) & set(found[q]))
    assert hits / (60 * 20) >= 0.9 and found[100] == [i for i in range(101, 121)]
    few = ann.nearest_neighbours(vectors.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.nearest_neighbours(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("dims", [16, 40, 65])
def test_scan_hands_on_few_but_the_nearest(dims):
    """Vectors without structure, which no test of a block tells apart, and equal ones."""
    rng = np.random.default_rng(4)
    rows, query = rng.standard_normal((900, dims)), rng.standard_normal((50, dims))
    rows[10:16] = rows[10]
    query[0] = rows[10]
    q, x = ann.scan(query, rows, 21)
    far = ((query[:, None, :] - rows) ** 2).sum(axis=2)
    nearest = np.argsort(far, axis=1, kind="stable")[:, :21]
    assert {(i, j) for i in range(50) for j in nearest[i].tolist()} <= set(zip(q.tolist(), x.tolist(), strict=True))
    assert len(q) <= 50 * 30


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_on_held_out_labels(spark, module, label):
    sf = "/root/testdata/sf0.01"
    judged = module.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (judged["predicted"] == judged[label]).mean() >= 0.9


def test_toxic_words_of_few_documents_are_learned():
    rng = random.Random(2)
    plain = [" ".join(f"word{rng.randrange(300)}" for _ in range(40)) for _ in range(700)]
    rare = ["".join(rng.choices("abcdefghijklmnopqrstuvxyz", k=9)) for _ in range(80)]  # each in 5 toxic texts
    texts = [(1, f"{plain[k]} {rare[k % 80]}") for k in range(400)] + [(0, t) for t in plain[400:]]
    model = toxicity.train(pd.DataFrame(texts, columns=["label", "text"]).assign(share=lambda r: np.where(r["label"] == 1, 4 / 7, 3 / 7)))
    distance, line = toxicity.Distance(model["toxic"], model["ordinary"], model["common"]), np.array(model["line"])
    found = [sum(distance.features(f"{t}{w}") @ line[:-1] + line[-1] >= 0 for t, w in zip(plain, words)) for words in ([f" {w}" for w in rare], [""] * 80)]
    assert found[0] >= 72 and found[1] <= 8


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_without_labels_and_on_edge_texts(spark, docs, module):
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    scores = module.classify(docs, labels).collect()
    assert len(scores) == docs.count() and all(r["score"] == 0.5 for r in scores)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert 0 < len(out) and set(out["doc_id"]) <= set(docs.toPandas()["doc_id"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).toPandas()
    assert not kept["text"].str.lower().str.split().str.join(" ").duplicated().any()


def jaccard(a, b):
    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("stars", "sampled", "small"), [(4, 1, 32), (1, 16, 1)])
def test_near_copies_equal_all_pairs(spark, docs, monkeypatch, stars, sampled, small):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "STARS", stars)
    monkeypatch.setattr(similar, "SAMPLED", sampled)
    rng = random.Random(11)
    texts = [r["text"] for r in docs.collect()]
    for _ in range(6):  # chains of edits, with similarities on both sides of 0.8
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(12, 120))]
        for _ in range(7):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
    line = "one line that many texts repeat over and over "
    texts += [line * 60 + " ".join(f"u{k}x{i}" for i in range(30)) for k in range(4)]  # near only by the repeated line
    texts += [f"{p} " * n + tail for p, tail in [("go to the next page now", "q r s t u v w x y z")] for n in (2, 40)]
    low = brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["component"] for r in similar.similar_groups(rows).collect()}
    assert got == low
    last = len(texts) - 1
    assert len({low[k] for k in range(last - 5, last - 1)}) == 4 and low[last] == last - 1
    assert similar.similar_groups(rows.limit(0)).count() == 0


def test_near_copies_by_turns_equal_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(similar, "AT_ONCE", 0)
    test_near_copies_equal_all_pairs(spark, docs, monkeypatch, 1, 16, 1)


def test_near_copies_start_from_simhash_trees(spark, monkeypatch):
    """The trees' groups are compared first, and change no result: too wide ones are cut, missed links found."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(8):
        base = rng.choices(words, k=150)
        for edits in (0, 1, 3, 5, 60):  # the last one is no near copy
            changed = list(base)
            for at in rng.sample(range(150), edits):
                changed[at] = rng.choice(words)
            texts.append(" ".join(changed))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string")
    low = brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)
    for groups in ([(i, 0) for i in range(len(texts))], [(i, i % 7) for i in range(len(texts))]):
        found = similar.similar_groups(rows, spark.createDataFrame(groups, "row long, group long"))
        assert {r["row"]: r["component"] for r in found.collect()} == low
    met, check = [], similar._Links.check
    monkeypatch.setattr(similar._Links, "check", lambda self, pairs: (met.append(pairs.select("row", "row_a").collect()), check(self, pairs))[1])
    kept = corpus_pipeline.drop_near_copies(spark, rows.select("doc_id", "text"), SF_DIR).collect()
    assert {r["doc_id"] for r in kept} == set(low.values())
    groups = simhash.simhash_groups(rows).where("doc_id <> component_id").count()
    assert len(met[0]) == groups > 0


@pytest.mark.parametrize(("at_once", "stars", "small"), [(200_000, 4, 32), (0, 1, 1), (0, 4, 1)])
def test_near_copies_compare_all_of_a_candidate_group(spark, monkeypatch, at_once, stars, small):
    """Texts near each other, but not the first of their group, are linked by the group alone."""
    for name, value in (("AT_ONCE", at_once), ("STARS", stars), ("SMALL", small)):
        monkeypatch.setattr(similar, name, value)
    words = {p: [f"{p}{i}" for i in range(80)] for p in "abcde"}
    texts = [" ".join(words[p][: 80 - cut]) for p, cut in (("a", 0), ("b", 0), ("b", 3), ("c", 0), ("c", 2), ("b", 5), ("d", 0), ("e", 0), ("d", 1))]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    n = [len(similar.shingle_set(t, 5)) for t in texts]
    live = spark.createDataFrame([(-1 - k, k, n[k], 0) for k in range(9) if k != 7], "token long, row long, n int, at int")
    given = spark.createDataFrame([(k, 0) for k in range(1, 8)], "row long, row_a long")
    heads = similar.bitmap(docs.select(F.xxhash64("row").alias("h")), "h")
    frequent, again = similar._frequent(docs.limit(0), 5, heads), similar._repeated(docs, 5, heads)
    roots = similar._linked(live, given, docs, 5, 0.8, lambda: similar.Order(*frequent.value, again.value)).collect()
    found = collections.defaultdict(set)
    for r in roots:
        found[r["root"]].add(r["node"])
    assert sorted(map(sorted, found.values())) == [[1, 2, 5], [3, 4]]


def test_texts_of_their_own_words_bring_no_tokens(spark):
    """Shared shingles, fewer than a similar text needs, must not bring rows of all texts together as texts grow in number."""
    rng = random.Random(17)
    lines = [" ".join(rng.choices("abcdefghij", k=8)) for _ in range(12)]
    rows = [(i, " ".join([*rng.choices(lines, k=6), *(f"x{i}y{k}" for k in range(40))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "row long, text string")
    heads = similar.bitmap(docs.select(F.xxhash64("row").alias("h")), "h")
    given, again = similar._frequent(docs.limit(0), 5, heads), similar._repeated(docs, 5, heads)
    live = similar._prefix_tokens(docs, 5, 0.8, lambda: similar.Order(*given.value, again.value), heads)
    assert live.count() == 0 and similar.similar_groups(docs).where("row <> component").count() == 0


def test_repeated_tokens_are_told_without_a_table_of_counts(spark, docs, monkeypatch):
    """Nearly all tokens are of one text; counts of them by task took the heap of an executor."""
    counts = collections.Counter(t for r in docs.collect() for t in set(similar.shingle_set(r["text"], 5).tolist()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text").union(spark.createDataFrame([(-1, "a b c d e f"), (-2, "B c D e f g"), (-3, None)], "row long, text string"))
    counts.update(t for text in ("a b c d e f", "b c d e f g") for t in similar.shingle_set(text, 5).tolist())
    heads, told, bitmap = similar.bitmap(rows.select(F.xxhash64("row").alias("h")), "h"), [], similar.bitmap
    monkeypatch.setattr(similar, "bitmap", lambda df, column: (told.append(df), bitmap(df, column))[1])
    similar._repeated(rows, 5, heads)
    found = [r["token"] for r in told[0].collect()]
    assert sorted(found) == sorted(t for t, n in counts.items() if n > 1)
    assert "Aggregate" not in told[0]._jdf.queryExecution().executedPlan().toString()


def test_pairs_do_not_meet_in_every_bucket_of_their_tokens(spark, monkeypatch):
    """Texts of a common passage share many tokens, and many pairs of tokens, and are compared once or twice for all."""
    for name, value in (("AT_ONCE", 0), ("STARS", 0), ("SMALL", 1)):
        monkeypatch.setattr(similar, name, value)
    passages = {p: [f"{p}{i}" for i in range(60)] for p in ("L", "M", *(f"o{k}x" for k in range(12)))}
    texts = [" ".join(passages[line] + passages[f"o{k}x"]) for line in "LM" for k in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    met, check = [], similar._Links.check
    monkeypatch.setattr(similar._Links, "check", lambda self, pairs: (met.extend(map(tuple, pairs.select("row", "row_a").collect())), check(self, pairs))[1])
    assert similar.similar_groups(rows).where("row <> component").count() == 0
    assert len(met) <= 2 * 24 * 23 / 2


def test_merged_buckets_keep_the_first_place(spark):
    rows = [(t, r, 50, at + r, r) for t, at in ((7, 5), (3, 9), (9, 2)) for r in (1, 2, 4)]
    rows += [(5, r, 50, 1, r) for r in (1, 2)] + [(6, 4, 50, 0, 4)]  # other rows, and one alone
    left = spark.createDataFrame(rows, "token long, row long, n int, at int, root long")
    found = {(r["token"], r["row"]): r["at"] for r in similar._distinct_buckets(left).collect()}
    assert found == {(3, 1): 3, (3, 2): 4, (3, 4): 6, (5, 1): 1, (5, 2): 1}


def test_pipeline_keeps_rows_without_ids_or_labels(spark, tmp_path):
    words = [" ".join(f"{p}{i}" for i in range(40)) for p in "abcde"]
    rows = [(None, words[0]), (None, words[1]), (1, words[2]), (1, words[3]), (7, words[2] + " more"), (None, words[4]), (9, words[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()
    want = [(None, words[0]), (None, words[1]), (1, words[2]), (1, words[3]), (9, words[4])]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for i, t in want)
    for case, labels in [("none", []), ("null", [(1, None)]), ("one kind", [(1, 0), (7, 0)])]:
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/{case}/labels.parquet")
        assert corpus_pipeline.keep_quality(spark, docs, f"{tmp_path}/{case}").count() == len(rows)


def test_rows_of_one_id_lose_only_their_own_words(spark):
    """Equal ids with other texts, longer and shorter, and equal rows, whose even numbers must not hide other places."""
    rng = random.Random(21)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, u = fresh(60), fresh(60)
    rows = [(0, p), (5, f"{p} {fresh(30)}"), (5, u), (5, fresh(25)), (6, "")]
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0, p] == 0 and got[5, u] == 0 and sorted(got.values()) == [0, 0, 0, 0, 60]
    a, b, c = fresh(40), fresh(40), fresh(40)
    rows = [(1, f"{a} {b}")] * 2 + [(2, f"{a} {c}")] * 2 + [(3, f"{fresh(40)} {b}")] * 2 + [(4, f"{a} {fresh(50)}")] * 200
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got} == {(1, 80, 0), (2, 80, 40), (3, 80, 40), (4, 90, 40)}
    assert len(got) == len(rows)


def test_long_words_that_differ_by_an_exchange_of_bytes():
    word = b"a" + b"x" * 65_535 + b"bc"
    other = b"b" + b"x" * 65_535 + b"ac"
    assert substrings.word_hashes(word)[0] != substrings.word_hashes(other)[0]


def test_short_items_cut_nothing_out_of_clean_documents(spark):
    words = [f"w{i}" for i in range(600)]
    long = " ".join(words[100:120])
    docs = spark.createDataFrame([(1, " ".join(words), "x", 3), (2, "w5 " * 3 + long, "x", 3), (3, None, "x", 3), (4, "", None, None)],
                                 "doc_id long, text string, hit_spans string, n_hit int")
    items = spark.createDataFrame([(1, "w5"), (2, long)], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1]["text"].split() == words[:100] + words[120:] and (got[1]["hit_spans"], got[1]["n_hit"]) == ("x", 3)
    assert got[3]["text"] is None and got[4]["text"] == ""
    assert contamination.decontaminate(docs.limit(0), items).isEmpty()
    assert contamination.decontaminate(docs, items.limit(0)).count() == 4


CLASH = {"size": "long", "epoch": "long", "score": "double", "predicted": "int", "held_out": "boolean", "n_words": "long",
         "n_removed": "long", "kept_sha256": "string", "a name, with: signs": "int", "_row": "long", "hit_spans": "string", "taken": "long", "row": "long"}


def test_stages_keep_clashing_columns_and_empty_tables(spark, tmp_path):
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    docs = base.withColumns({c: F.lit(7).cast(t) for c, t in CLASH.items()}).withColumn("kept_sha256", F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes, name
        assert {r["kept_sha256"] for r in out.collect()} == {"mine"} and {r["size"] for r in out.collect()} == {7}, name
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
    mixed = corpus_pipeline.mix(spark, docs, SF_DIR)
    assert len(set(mixed.columns)) == len(mixed.columns) and {"doc_size", "doc_epoch", "size", "epoch"} <= set(mixed.columns)
    assert {r["doc_size"] for r in mixed.collect()} == {7}
    assert corpus_pipeline.mix(spark, docs.limit(0), SF_DIR).count() == 0
