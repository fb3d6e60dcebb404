"""Mixing, decontamination, personal data, language, URLs, quality, toxicity and licenses."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from llm_helpers import base_spans, shingles

from phonolith.llm import decontaminate, language, licenses, mixing, pii, quality, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 500)}" for _ in range(n)]


def test_targets_fill_up_to_the_caps():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    got = mixing.targets([1, 100, 100], [1, 2, 100])
    assert got[0] <= 3 and got[2] <= 300 and abs(sum(got) - 201) < 1e-9
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_mix_takes_the_target_and_interleaves(spark):
    rows = [(i, " ".join(["x"] * (5 + i % 90)), f"s{i % 4}" if i % 5 else None) for i in range(600)]
    docs, pieces = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), block=32)
    got = docs.collect()
    assert len(got) == 600 and all(r.taken <= 3 * r.size for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted(map(tuple, mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), block=32)[0].collect()), key=str) == sorted(map(tuple, got), key=str)
    p = pieces.collect()
    half = Counter()
    for r in p:
        half[r.sid, r.slot * 2 >= max(x.slot for x in p)] += r.words
    assert all(abs(half[s, False] - half[s, True]) <= 0.2 * (half[s, False] + half[s, True]) + 64 for s in {r.sid for r in p})


def test_mix_edges(spark, edge_docs, empty_docs):
    got = mixing.mix(spark, edge_docs)[0].collect()
    assert len(got) == edge_docs.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(spark, empty_docs)[0].count() == 0


def test_containment_matches_brute_force(spark):
    items = {i: " ".join(words(i, 12 + 7 * i)) for i in range(8)}
    items[8], items[9], items[10] = "only three words", "", None
    rng, docs = random.Random(1), {}
    for i in range(60):
        body = words(1000 + i, 300)
        if i % 3 == 0:
            item = items[i % 8].split()
            cut = item[: rng.randint(len(item) // 2, len(item))]
            body[100:100] = cut
        docs[i] = " ".join(body)
    docs[60], docs[61], docs[62] = "only three words", None, ""
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {}
    for d, t in docs.items():
        for k, q in items.items():
            a, b = shingles(t), shingles(q)
            if b and 100 * len(a & b) >= 75 * len(b):
                want[d, k] = len(a & b)
    assert got == want and len(want) > 5


def test_decontaminate_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "one two"), (None, None)], "item_id long, text string")
    kept = decontaminate.decontaminate(spark, edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 2
    assert decontaminate.contaminated(spark, empty_docs, items).count() == 0 and decontaminate.decontaminate(spark, edge_docs, items.limit(0)).count() == edge_docs.count()


PII = [
    "write to a.b@c.de.fr or x@y, a@b.c_d@e.f done", "ip 10.0.0.1 and 1.2.3.4.5.6.7.8 but 300.1.1.1 v1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111",
    "call +44 (0)20 7946 0958 or +1-2", "é😀 +49 30 123456 😀 a@b.co", "IBAN DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432 or DE88370400440532013000", "my ssn 123-45-6789 but 123-45-6789x",
    "", None, "1" * 5000 + " " + "a" * 5000 + "@", " ".join(f"u{i}@d.org" for i in range(700)),
]


def test_personal_data_matches_brute_force(spark):
    got = pii.digest_columns(pii.personal_data(spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string"))).collect()
    for r in got:
        want = base_spans(PII[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (PII[r.doc_id], r.spans, said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
    spans = {r.doc_id: r.spans for r in got}
    assert spans[5].count("iban:") == 2 and spans[6].startswith("ssn:7:18")
    random_texts = ["".join(random.Random(i).choice("0123456789 -+.@ab()") for _ in range(120)) for i in range(300)]
    for r in pii.digest_columns(pii.personal_data(spark.createDataFrame(list(enumerate(random_texts)), "doc_id long, text string"))).collect():
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(random_texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), random_texts[r.doc_id]


def test_redaction(spark, edge_docs):
    docs = spark.createDataFrame([(1, "mail a@b.co now", 5), (2, None, 6)], "doc_id long, text string, spans int")
    out = {r.doc_id: r.text for r in pii.redact(docs.drop("spans")).collect()}
    assert out == {1: "mail [EMAIL] now", 2: None}
    assert pii.personal_data(edge_docs).count() == edge_docs.count()


def test_personal_data_context_and_countries(spark, edge_docs, empty_docs):
    texts = ["see v1.2.3.4 here", "host 1.2.3.4 here", "pay NO9386011117947 now", "bank MT84MALT011000012345MTLCAST001S ok"]
    got = {r.doc_id: r for r in pii.digest_columns(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert float(got[0].scores) < 0.6 < float(got[1].scores) and got[2].spans.startswith("iban:4:19") and got[3].spans.startswith("iban:5:36")
    assert pii.personal_data(empty_docs).count() == 0
    clash = spark.createDataFrame([(1, "mail a@b.co now", "s", 2)], "doc_id long, text string, spans string, start int")
    assert pii.redact(clash).collect() == [(1, "mail [EMAIL] now", "s", 2)]


def test_url_edges(spark):
    """Repeated rows, hosts of thousands of labels, long urls and columns with names of ours."""
    long = "https://" + "a." * 8000 + "example.org/es/" + "x" * 50_000
    rows = [(1, long, "h", 0), (1, long, "h", 0), (None, "https://a.com/fr/", "h", 0), (2, None, "h", 0)]
    got = url_filter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, host string, n int").selectExpr("*", "cast(null as string) html")).collect()
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in got) == [("1", "example.org/es/", "block")] * 2 + [("2", "None", "allow"), ("None", "com/fr/", "allow")]


def test_every_contaminated_document_is_a_candidate(spark):
    """At exactly 75 % of an item, whichever shingles are lacking, enough of its sketch is found."""
    items = {n: words(n, n + 4) for n in (4, 8, 13, 20, 31, 40)}
    docs = {}
    for n, w in items.items():
        keep = -(-n * 3 // 4)
        for start in range(n - keep + 1):
            docs[len(docs)] = (" ".join(["pad"] * 30 + w[start : start + keep + 4] + ["end"] * 30), n)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, spark.createDataFrame([(i, t) for i, (t, _) in docs.items()], "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()}
    assert got >= {(i, n) for i, (_, n) in docs.items()}


def test_language_held_out_and_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    texts = {r.lang: r.text for r in docs.where("length(text) > 1500 and doc_id < 200").collect()}
    both = texts["en"][:1500] + " " + texts["de"][:500]
    mixed = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6 + 5, both, None)], "doc_id long, text string, lang string"))
    said = language.identify(spark, mixed).where("doc_id > 999999").first()
    assert said.lang_pred == "en" and "de:" in said.mixture and 0.6 < said.score < 0.9


def test_language_edges(spark, edge_docs, empty_docs):
    got = {r.doc_id: r for r in language.identify(spark, edge_docs).collect()}
    assert got[4].lang_pred == got[6].lang_pred == got[10].lang_pred == "und" and got[10].score == 0.0
    assert language.identify(spark, empty_docs).count() == 0


def test_url_rules_and_verdicts(spark):
    urls = [
        "http://a.Example.org/es/x?q", "http://example.org/en/12", "http://example.org/fr", "https://b.com/fr/", "https://b.com/de/1", "http://xorg/", None, "no scheme", "http://org", "ftp://example.org/es/#f", "x://net.org/p?://y",
    ]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark, pages.drop("host")).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2] == "com/fr/" and got[4][2:] == ("com/de/", "block") and got[5][2] is None and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("org", "", None, "allow") and got[9][2] == "example.org/es/" and got[10] == ("net.org", "/p", "org/", "allow")
    assert url_filter.filter_urls(spark, pages.drop("host").limit(0)).count() == 0


def test_trust_and_distrust_flow_over_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">' for h in hosts)
    rows = [
        (1, "https://good.org/", link("friend.net")), (2, "https://friend.net/", link("far.net")), (3, "https://far.net/", None), (4, "https://shop.com/de/", None), (5, "https://spam.net/", link("shop.com")), (6, "https://farm.net/", link("spam.net")),
    ]
    got = {r.page_id: r for r in url_filter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["allow", "allow", "allow", "block", "block", "block"]
    # brute force: ten steps of both flows
    edges = {("good.org", "friend.net"): 1, ("friend.net", "far.net"): 1, ("spam.net", "shop.com"): 1, ("farm.net", "spam.net"): 1}
    for flow, seed, moves in (("trust", "good.org", edges), ("distrust", "shop.com", {(b, a): n for (a, b), n in edges.items()})):
        score = {seed: 1.0}
        for _ in range(url_filter.STEPS):
            new = {seed: 0.15}
            for (a, b), _n in moves.items():
                new[b] = new.get(b, 0) + 0.85 * score.get(a, 0)
            score = new
        assert all(abs(getattr(got[i], flow) - score.get(got[i].host, 0)) < 1e-9 for i in got)


def test_distrust_goes_on_until_it_stands_still(spark):
    """A host 14 links from the only seed is reached, over links without a scheme."""
    hosts = ["shop.com", *(f"h{i}.net" for i in range(14))]
    rows = [(i, f"https://{h}/{'de/' if not i else ''}", f'<a href="//{hosts[i - 1]}/p">' if i else None) for i, h in enumerate(hosts)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and abs(got[i].distrust - 0.15 * 0.85**i) < 1e-8 for i in range(15))


@pytest.mark.parametrize("operator, label, least", [(quality.quality, "quality", 0.9)])
def test_quality_held_out(spark, operator, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = operator(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in got) / len(got) > least and all(0 <= r.score <= 1 for r in got)


def test_quality_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0, "t"), (2, 0, 1, "t"), (7, 1, 0, "t"), (8, 0, 1, "t"), (None, 1, 1, "t"), (3, None, None, "t")], "doc_id long, quality int, toxic int, text string")
    for f in (quality.quality, toxicity.toxicity):
        assert f(spark, edge_docs, labels).count() == edge_docs.count() and f(spark, empty_docs, labels).count() == 0
        assert {r.score for r in f(spark, edge_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(spark, edge_docs, labels.limit(0)).count() == edge_docs.count()
    held_out = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % quality.FOLDS == quality.HELD_OUT)
    only_held = spark.createDataFrame([(held_out, 1)], "doc_id long, quality int")  # nothing may be learned from it
    assert quality.keep_good(spark, edge_docs, only_held).count() == edge_docs.count()


def test_isotonic_never_falls():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random(500).round(2)
    y = (rng.random(500) < x).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    # least squares among non-decreasing fits: no pool can be cut so that its left part lies below its right part
    fit = np.array([values[np.argmin(np.abs(knots - k))] for k in knots])
    assert (fit == values).all() and abs((np.interp(x, knots, values) - y).mean()) < 0.05


def test_quality_is_the_kernel_ridge_it_stands_for():
    """Inner products of the features are near the Gaussian kernel, and the normal equations give ridge's weights."""
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(size=(80, quality.N_STATS))
    features = quality.fourier(z, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * quality.N_STATS))
    assert np.abs(features[:, :-1] @ features[:, :-1].T - kernel).mean() < 0.1
    y = rng.random(80)
    weights = quality._solve(features.T @ np.column_stack([features, y]))
    slope = features.T @ (features @ weights - y) + np.append(quality.RIDGE * weights[:-1], 1e-9 * weights[-1])
    assert np.abs(slope).max() < 1e-6


BIG = 2**53 + 1


@pytest.mark.parametrize("name", ["language", "quality", "toxicity", "licenses"])
def test_large_ids_beside_nulls(spark, name):
    """Ids above 2**53 come back as they are, with a null id in the same batch."""
    text = "Released under the MIT License. Some more words here."
    docs = spark.createDataFrame([(BIG, text, "en"), (None, text, "en"), (BIG + 2, text, "en")], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 1), (BIG + 2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {
        "language": lambda: language.identify(spark, docs), "quality": lambda: quality.quality(spark, docs, labels), "toxicity": lambda: toxicity.toxicity(spark, docs, labels), "licenses": lambda: licenses.license_scan(docs),
    }[name]()
    assert {r.doc_id for r in got.collect()} == {BIG, None, BIG + 2}


def test_words_in_blocks_are_the_words_of_the_whole(monkeypatch):
    from phonolith.llm import common

    text = " ".join(words(5, 3000)) + " " + "x" * 5000 + "\n" + "é!" * 50
    whole = [common.word_hashes(text, strip) for strip in (False, True)]
    monkeypatch.setattr(common, "_BLOCK", 64)
    for strip in (False, True):
        assert (common.word_hashes(text, strip) == whole[strip]).all() and len(whole[strip]) == len(text.split())
    assert len({*whole[0].tolist()}) == len({*text.split()})


def test_mixture_shares_are_the_likeliest():
    """Shares of expectation-maximisation against a grid over all mixtures of three languages."""
    import numpy as np

    rng = np.random.default_rng(6)
    likely = rng.dirichlet(np.full(40, 0.3), 3).T + 1e-4
    likely /= likely.sum(axis=0)
    cells = np.concatenate([rng.choice(40, 300, p=likely[:, 0]), rng.choice(40, 100, p=likely[:, 2])])
    got = language.languages_of(cells, likely)
    grid = [(a / 50, b / 50, 1 - (a + b) / 50) for a in range(51) for b in range(51 - a)]
    best = max(grid, key=lambda g: np.log(likely[cells] @ np.array(g)).sum())
    assert set(got) == {0, 2} and all(abs(got.get(k, 0) - best[k]) < 0.05 for k in range(3))


def test_toxicity_finds_marked_words(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(1500):
        w = words(i, rng.randint(60, 200))
        toxic = i % 6 == 0
        for _ in range(max(2, len(w) // 40) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grolk", "vexel", "snarb"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, r.doc_id % 6 == 0) for r in got if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_toxicity_against_brute_force_on_strings(spark, monkeypatch, sent):
    """Each class's probabilities sum to 1 after every context, and llr is the mean of their log ratios, with words and bigrams above and below each bound, sent or joined."""
    monkeypatch.setattr(toxicity, "OWN_DISCOUNT", 5.0)
    monkeypatch.setattr(toxicity, "FREQUENT", 0.004)
    monkeypatch.setattr(toxicity, "SENT_BIGRAMS", sent)
    rng = random.Random(3)
    texts = {i: " ".join([*words(i, 8), *(f"rare{rng.randrange(200)} w{i}x{j}" for j in range(60)), *(["vile", "deed"] * 3 if i % 3 == 0 else ["good", "deed"])]) for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    held = {r.doc_id: r.out for r in docs.selectExpr("doc_id", f"crc32(cast(cast(doc_id as string) as binary)) % {toxicity.FOLDS} = {toxicity.HELD_OUT} or pmod(xxhash64(doc_id, 9), {toxicity.CALIBRATES}) = 0 as out").collect()}
    steps = lambda i: list(zip(["<s>", *texts[i].split()], [*texts[i].split(), "</s>"], strict=True))
    pair, word, context = ([Counter(), Counter()] for _ in range(3))
    for i in texts:
        for h, w in steps(i) if not held[i] else ():
            pair[i % 3 == 0][h, w] += 1
            word[i % 3 == 0][w] += 1
            context[i % 3 == 0][h] += 1
    seen, d, k = pair[0] + pair[1], toxicity.DISCOUNT, toxicity.KAPPA
    types, totals = Counter(w for _, w in seen), [x.total() for x in word]
    least = min(totals)
    followers = {}
    for h, w in seen:
        followers.setdefault(h, []).append(w)
    vocabulary = [*types, "never seen"]
    p = {w: max(types[w] - d, 0) / len(seen) + d * len(types) / len(seen) / len(vocabulary) for w in vocabulary}
    r = [{w: (word[c][w] + k) / ((word[0][w] + word[1][w]) * totals[c] / sum(totals) + k) for w in vocabulary} for c in (0, 1)]

    def shared(h, w):
        n = context[0][h] + context[1][h]
        return max(seen[h, w] - d, 0) / n + d * len(followers[h]) / n * p[w] if n else p[w]

    def distribution(h, c):
        z = sum(shared(h, w) * r[c][w] for w in vocabulary)
        own = {w: pair[c][h, w] * least / totals[c] for w in vocabulary}
        size, a = sum(own.values()), toxicity.OWN_DISCOUNT
        rest = sum(min(x, a) for x in own.values()) / size if size else 1.0
        return {w: (max(own[w] - a, 0) / size if size else 0) + rest * shared(h, w) * r[c][w] / z for w in vocabulary}

    of = {(h, c): distribution(h, c) for h in {h for i in range(6) for h, _ in steps(i)} for c in (0, 1)}
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in of.values())
    got = {r.doc_id: r.llr for r in toxicity.toxicity(spark, docs, labels).collect()}
    for i in range(6):
        l = [math.log(of[h, 1].get(w, of[h, 1]["never seen"]) / of[h, 0].get(w, of[h, 0]["never seen"])) for h, w in steps(i)]
        assert abs(got[i] - sum(l) / len(l)) < 1e-9


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_toxicity_shuffles_share_by_share(spark, monkeypatch, sent):
    """Bigrams and answers come in shares that no other share holds, none with most of the rows, and scores are those of one share."""
    monkeypatch.setattr(toxicity, "OWN_DISCOUNT", 2.0)
    monkeypatch.setattr(toxicity, "FREQUENT", 0.01)
    monkeypatch.setattr(toxicity, "SENT_BIGRAMS", sent)
    docs = spark.createDataFrame([(i, " ".join([*words(i, 40), *(["vile", "deed"] * 3 if i % 3 == 0 else ["good", "deed"])])) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    kept, keep = {}, toxicity.Scratch.keep

    def seen(self, df, name, **options):
        out = keep(self, df, name, **options)
        if name.startswith(("pairs", "answers")):
            kept[slices, name] = out.collect()
        return out

    monkeypatch.setattr(toxicity.Scratch, "keep", seen)
    scores = {}
    for slices in (1, 5):
        monkeypatch.setattr(toxicity, "SLICES", slices)
        scores[slices] = {r.doc_id: (r.score, r.llr) for r in toxicity.toxicity(spark, docs, labels).collect()}
    pairs = [[(r.context, r.word, r.n0, r.n1) for r in kept[5, f"pairs-{k}"]] for k in range(5)]
    assert sorted(sum(pairs, [])) == sorted((r.context, r.word, r.n0, r.n1) for r in kept[1, "pairs-0"])
    assert sum(len({r[0] for r in p}) for p in pairs) == len({r[0] for p in pairs for r in p})
    assert max(map(len, pairs)) < 0.6 * sum(map(len, pairs))
    assert max(sum(r.known for r in kept[5, f"answers-{k}"]) for k in range(5)) < 0.6 * sum(r.known for r in kept[1, "answers-0"])
    assert all(abs(a - b) < 1e-9 for i in scores[1] for a, b in zip(scores[1][i], scores[5][i], strict=True))


def test_licenses_match_in_whole_and_in_part(spark, edge_docs, empty_docs):
    notice = licenses.TEMPLATES["apache-2.0-notice"].split()
    texts = {
        1: "x y\nReleased under the MIT License.", 2: "Released under the MIT license", 3: "released by no license at all here", 4: " ".join(["pad"] * 50 + notice[:10] + ["odd"] + notice[10:]), 5: " ".join(notice[:8]),
        6: "Licensed under CC BY-NC 4.0. " * 2, 7: None, 8: "",
    }
    got = licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.license) for r in got)
    assert found[1, "mit-line"] == 1 and found[2, "mit-line"] == 1 and found[6, "cc-by-nc-4.0-line"] == 2 and found[4, "apache-2.0-notice"] == 1 and not any(d in (3, 7, 8) for d, _ in found)
    assert (5, "apache-2.0-notice") not in found and (5, "apache-2.0-line") in found
    whole = spark.createDataFrame([(1, f"before {licenses.TEMPLATES['bsd-3-clause']} after"), (2, licenses.TEMPLATES["mit"].replace("Software", "Program"))], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.license_scan(whole).collect()} >= {(1, "bsd-3-clause"), (1, "bsd-2-clause"), (2, "mit")}
    one = next(r for r in got if r.doc_id == 1)
    assert texts[1][one.start : one.end] == "Released under the MIT License." and one.coverage == 1.0
    assert licenses.license_scan(edge_docs).count() == 0 and licenses.license_scan(empty_docs).count() == 0


def test_aligned_coverage_equals_longest_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        template = rng.integers(0, 30, 12).astype(np.uint64)
        text = np.concatenate([rng.integers(40, 90, 9), np.where(rng.random(12) < 0.2, 99, template), rng.integers(40, 90, 5)]).astype(np.uint64)
        table = np.zeros((13, len(text) + 1), int)
        for i in range(12):
            for j in range(len(text)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (template[i] == text[j]))
        assert licenses.align(template, text, 9, 6)[0] == table[-1, -1]
