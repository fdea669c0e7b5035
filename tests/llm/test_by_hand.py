"""Whole scores of toxicity and language, computed again one row after another in plain Python."""

import bisect
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import html_text, langid, toxicity
from sparkloom.llm.queries import remainder


def of_tree(node, x):
    """What a tree of Spark ML predicts, by its nodes."""
    while node.subtreeDepth():
        node = node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild()
    return node.prediction()


def of_curve(curve, p):
    """A step curve with straight lines between its points and flat ends."""
    at, values = list(curve.boundaries.toArray()), list(curve.predictions.toArray())
    k = bisect.bisect_left(at, p)
    if k == 0 or k == len(at):
        return values[min(k, len(at) - 1)]
    if at[k] == p:
        return values[k]
    return values[k - 1] + (values[k] - values[k - 1]) * (p - at[k - 1]) / (at[k] - at[k - 1])


def test_scores_of_toxicity(spark, monkeypatch):
    kept = {}

    def keeping(kind):
        class Kept(kind):
            def fit(self, *a, **k):
                kept[kind.__name__] = super().fit(*a, **k)
                return kept[kind.__name__]

        return Kept

    for kind in (toxicity.GBTClassifier, toxicity.IsotonicRegression):
        monkeypatch.setattr(toxicity, kind.__name__, keeping(kind))
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(["plain%d" % k for k in range(60)], k=30)
        if rng.random() < (0.9 if i % 4 == 0 else 0.1):
            words[rng.randrange(30)] = rng.choice(["Grumph!", "grumphish", "you", "m0ron", "SCUM"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "grumph " * 5_000), (903, rows[3][1]), (903, rows[3][1])]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = sorted((r["doc_id"], r["text"] or "", r["score"], r["predicted"]) for r in toxicity.score(df, known, remainder("doc_id", 3) != 1, trees=5).collect())

    texts, seen = dict(rows), {0: Counter(), 1: Counter()}
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    for i, y in learned:
        words = {"".join(c if c.isalnum() else " " for c in w).strip() for w in texts[i].lower().split()}
        seen[y].update({e for w in words for e in ("=" + w, *("^" + w[:n] for n in (4, 5) if len(w) > n))})
    n = Counter(y for _, y in learned)
    odds = {e: math.log((k + 0.5) / (n[1] + 1)) - math.log((seen[0][e] + 0.5) / (n[0] + 1)) for e, k in seen[1].items() if k >= max(3, 0.005 * n[1])}
    lexicon = {e.encode(): v for e, v in odds.items() if v >= 2.5}
    assert b"=grumph" in lexicon or b"^grum" in lexicon

    model, curve = kept["GBTClassifier"], kept["IsotonicRegression"]
    trees, weights = model._java_obj.trees(), list(model.treeWeights)
    want = []
    for i, text in rows:
        x = toxicity.features((text or "").encode(), lexicon)
        margin = sum(w * of_tree(trees[k].rootNode(), x) for k, w in enumerate(weights))
        p = 1 / (1 + math.exp(-2 * margin))
        score = 0.999 * of_curve(curve, p) + 0.001 * p
        want.append((i, text or "", score, int(score >= 0.7)))
    want.sort()
    assert [w[:2] for w in want] == [g[:2] for g in got]
    assert all(math.isclose(w[2], g[2], abs_tol=1e-9) and w[3] == g[3] for w, g in zip(want, got))
    assert len({round(w[2], 6) for w in want}) > 3


def test_fusion_of_evidence(spark):
    rng = random.Random(8)
    vocabulary = {"de": "und der nicht mit".split(), "en": "the and with this".split(), "fr": "le les des est".split()}
    docs = [(i, " ".join(rng.choices(vocabulary[y], k=12)), y) for i, y in ((i, rng.choice(list(vocabulary))) for i in range(60))]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = defaultdict(Counter)
    for _, text, y in docs:
        s = f" {text} "
        counts[y].update(bucket(s[k : k + 3]) for k in range(len(s) - 2))
    for y, of in counts.items():
        total = sum(of.values())
        assert all(math.isclose(model[y][b], math.log((of[b] + 0.1) / (total + 0.1 * langid.BUCKETS)), abs_tol=1e-9) for b in range(langid.BUCKETS))

    pages = []
    for i in range(80):
        y = rng.choice(list(vocabulary))
        body = " ".join(rng.choices(vocabulary[y], k=rng.choice([0, 1, 2, 12])))
        lang = rng.choice(["", f" lang='{y}'", " lang=en-US"])
        pages.append((i, rng.choice([f"https://h{i % 5}.site{i % 3}.{y}/p", "http://a.b.c.com:80/", "nothing", None]), f"<html{lang}><body><article><p>{body}</p></article></body></html>"))
    pages += [(None, None, None), (3, *pages[3][1:])]
    got = langid.fuse(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()

    names, facts = list(model), []
    for _, url, html in pages:
        text = html_text.extract(html or "")
        found = [bucket(s) for t in [f" {' '.join(text.lower().split())} "] for s in (t[k : k + 3] for k in range(len(t) - 2))]
        logs = [sum(model[y][b] for b in found) * (len(found) ** (langid.GROWTH - 1) if found else 1) for y in names]
        logs = [x - max(logs) for x in logs]
        p = [math.exp(x) / sum(map(math.exp, logs)) for x in logs]
        host = (url or "").partition("://")[2].partition("/")[0].partition(":")[0].lower() if "://" in (url or "") else ""
        said = (html or "").partition("lang=")[2].lstrip("'\"")[:2].lower() if "lang=" in (html or "") else ""
        facts.append({"logs": logs, "p": p, "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": said})
    want = []
    for (page_id, url, _), f in zip(pages, facts):
        others = lambda by: [max(sum(g["p"][k] for g in facts if by is None or g[by] == f[by]) - f["p"][k], 0.0) for k in range(len(names))]
        share = lambda n: [x / sum(n) for x in n]
        every = others(None)
        prior = share([x + 1 for x in every])
        for by in ("domain", "host"):
            prior = share([x + langid.STRENGTH * q for x, q in zip(others(by), prior)])
        evidence = [a + math.log(q) for a, q in zip(f["logs"], prior)]
        for by in ("suffix", *(["declared"] if f["declared"] else [])):
            evidence = [a + math.log((x + 0.5) / (e + 1)) for a, x, e in zip(evidence, others(by), every)]
        posterior = share([math.exp(a - max(evidence)) for a in evidence])
        want.append((str(page_id), url or "", f["host"], f["declared"], names[evidence.index(max(evidence))], max(posterior)))
    have = [(str(r["page_id"]), r["url"] or "", r["host"], r["declared"], r["lang"], r["confidence"]) for r in got]
    want.sort(), have.sort()
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert all(w[5] == pytest.approx(h[5], abs=1e-9) for w, h in zip(want, have))
    assert len({w[4] for w in want}) == 3 and any(w[5] < 0.9 for w in want)


def bucket(three):
    """The bucket of three characters: a multiplicative hash of their code points in 64 bits."""
    a, b, c = map(ord, three)
    h = (((a * 0x9E3779B1) + b) * 0x85EBCA77 + c) % (1 << 64)
    return ((h * 0x9E3779B97F4A7C15) % (1 << 64) >> 50) % langid.BUCKETS
