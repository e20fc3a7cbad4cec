"""Quality classifier and language identification against plain recomputations."""

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelkit.llm import classifier, langid

from .conftest import SF

ALL = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


def word_hash(word):
    return mix((sum((b + 1) * pow(ODD, i, 1 << 64) for i, b in enumerate(word)) + len(word) * 0xD6E8FEB86659FD93) & ALL)


def grams(text):
    """Buckets of byte trigrams, word bigrams and repetition distances."""
    body = (text or "").encode()
    span = classifier.BUCKETS - classifier.REACH - 1
    out = [mix((body[i] | body[i + 1] << 8 | body[i + 2] << 16) + (1 << 40)) % span + classifier.REACH + 1 for i in range(len(body) - 2)]
    words = WORD.findall(body)
    known = {w: word_hash(w) for w in set(words)}
    h = [known[w] for w in words]
    out += [mix((a * 3 + b) & ALL) % span + classifier.REACH + 1 for a, b in zip(h, h[1:])]
    out += [next((d for d in range(1, classifier.REACH + 1) if d <= i and h[i - d] == h[i]), 0) for i in range(len(h))]
    return out


def test_classifier_equals_brute_force(spark):
    """Scores, keys and the choice, recomputed from counts of every n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts, quality = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    found = {i: grams(t) for i, t in texts.items()}
    raw, target = np.zeros(classifier.BUCKETS), np.zeros(classifier.BUCKETS)
    for i, g in found.items():
        np.add.at(raw, g, 1)
        if quality.get(i) == 1:
            np.add.at(target, g, 1)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    score = {i: sum(ratio[k] for k in g) / max(len(g), 1) for i, g in found.items()}
    least = classifier.threshold([(score[i], q) for i, q in quality.items() if i in score], 0.999)
    above = np.array([score[i] - least for i, q in quality.items() if q == 1 and i in score and score[i] > least])
    scale = classifier.temperature(above, 0.999)
    stay = lambda t: np.mean(1 - np.exp(-np.exp(above / t)))
    assert stay(scale) >= 0.999 - 1e-9 > stay(scale * 1.01)
    u = {r.doc_id: (r.h % (1 << 40) + 0.5) / (1 << 40) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    key = {i: (score[i] - least) / scale - math.log(-math.log(u[i])) for i in texts}
    k = round(sum(1 - math.exp(-math.exp(min(50, (score[i] - least) / scale))) for i in texts))
    best = set(sorted(key, key=key.get, reverse=True)[:k])
    got = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert math.isclose(r.score, score[i], abs_tol=1e-9) and math.isclose(r.key, key[i], rel_tol=1e-5, abs_tol=1e-5)
    assert {i for i, r in got.items() if r.kept} == best


def test_gumbel_noise_decides_near_the_border(spark):
    """Documents between good and bad are drawn by chance, the better the likelier; without noise a threshold would decide."""
    rnd = np.random.RandomState(0)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    text = lambda share: " ".join(rnd.choice(good if rnd.rand() < share else bad) for _ in range(120))
    rows = [(i, text(1 - (i % 50) / 49)) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 50 < 5)) for i in range(400) if i % 50 < 5 or i % 50 >= 45], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = classifier.classify(docs, labels).collect()
    kept, scores = sum(r.kept for r in got), sorted((r.score for r in got), reverse=True)
    by_threshold = {r.doc_id for r in got if r.score >= scores[kept - 1]}
    assert len(by_threshold ^ {r.doc_id for r in got if r.kept}) >= 20
    share = lambda steps: np.mean([r.kept for r in got if r.doc_id % 50 in steps])
    assert share(range(5)) > 0.97 and share(range(45, 50)) < share(range(27, 36)) < share(range(18, 27))
    again = classifier.classify(docs, labels, seed=2).collect()
    assert {r.doc_id for r in again if r.kept} != {r.doc_id for r in got if r.kept}


def test_top_k_narrows_a_crowded_bin(spark):
    rows = [(i, 1.0 + (i % 7) * 1e-9, i) for i in range(300)] + [(1000, 50.0, 0), (1001, -50.0, 0)] + [(2000, 1.0, 5)] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, key double, _h bigint")
    order = sorted(rows, key=lambda r: (-r[1], r[0], r[2]))
    for k in (0, 1, 60, 200, 310, len(rows) - 1, len(rows), len(rows) + 5):
        kept = sorted((r.doc_id, r.key) for r in classifier.top_k(df, k, bins=5, few=30).where("kept").collect())
        assert kept == sorted((i, x) for i, x, _ in order[:k])
    assert classifier.top_k(df.where("doc_id < 0"), 3).count() == 0


def test_classifier_keeps_columns_of_any_name(spark):
    names = ("_h", "_rest", "_noise", "_bin", "bucket", "quality", "low")
    rows = spark.createDataFrame([(i, f"some words number {i}", *range(7)) for i in range(40)], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in names))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(20)], "doc_id bigint, quality int")
    got = classifier.classify(rows, labels)
    assert got.columns == ["doc_id", "text", *names, "score", "key", "kept"]
    assert all(tuple(r[c] for c in names) == tuple(range(7)) for r in got.collect())


def visible(html):
    bare = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", html or "")
    return re.sub(r"(?s)<[^>]*>", " ", bare)


def plain_language(pages, models, strength=4.0):
    """Posteriors of each page by the formulas alone: dictionaries instead of joins."""
    langs = list(models)
    evidence = {}
    for i, url, html in pages:
        body = bytes(b + 32 if 65 <= b <= 90 else b for b in visible(html).encode())
        buckets = [mix((body[k] | body[k + 1] << 8 | body[k + 2] << 16) + 1) % langid.BUCKETS for k in range(len(body) - 2)]
        ll = [sum(models[x][b] for b in buckets) / max(len(buckets), 1) * min(len(buckets), langid.MOST_EVIDENCE) for x in langs]
        top = max(ll)
        p = np.exp(np.array(ll) - top)
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        said = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", html or "")
        said = said[1].lower() if said else ""
        domain, suffix = re.search(r"([^.]+\.[^.]+)$", host), re.search(r"([^.]+)$", host)
        evidence[i] = (np.array(ll), p / p.sum(), said if said in langs or not said else "other", host, domain[1] if domain else "", suffix[1] if suffix else "")
    by = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(4)]
    for _, p, said, host, domain, suffix in evidence.values():
        for table, key in zip(by, (host, (domain, suffix), suffix, said)):
            table[key] += p
    total = sum(by[2].values())
    everywhere = (total + 1) / (total.sum() + len(langs))
    smooth = lambda n, parent: (n + strength * parent) / (n.sum() + strength)
    out = {}
    for i, (ll, p, said, host, domain, suffix) in evidence.items():
        parent = smooth(by[1][domain, suffix], smooth(by[2][suffix], everywhere))
        own = np.maximum(by[0][host] - p, 0)
        declared = np.log((by[3][said] + 0.5) / (sum(by[3].values()) + 0.5 * (len(langs) + 2)))
        log = ll + declared + np.log(np.maximum((own + strength * parent) / (own.sum() + strength), 1e-12))
        q = np.exp(log - log.max())
        out[i] = (langs[int(np.argmax(log))], q.max() / q.sum(), langs[int(np.argmax(ll))], host)
    return out


def test_language_equals_plain_bayes(spark):
    """Every posterior, on pages of known language of which a part declares another one, or stands at a host of another."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = langid.fit(docs)
    text = defaultdict(list)
    for r in docs.where("lang is not null and length(text) > 200").orderBy("doc_id").collect():
        text[r.lang].append(r.text[:1500])
    langs, pages, truth = sorted(text), [], {}
    for i in range(240):
        lang = langs[i % len(langs)]
        other = langs[(i + 1) % len(langs)]
        said = other if i % 10 == 3 else lang if i % 10 < 8 else "xx" if i % 10 == 8 else ""
        body = text[lang][i % len(text[lang])][: (40, 300, 1500)[i % 3]].replace("<", " ")
        host = f"www{i % 5}.site{i % 7}.{other if i % 12 == 5 else lang}"
        pages.append((i, f"https://{host}/{i}", f"<html lang='{said}'><script>var x;</script><p>{body}</p></html>"))
        truth[i] = lang
    pages += [(900, None, None), (901, "nonsense", ""), (902, "http://www0.site0.de", "<html>")]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), models).collect()}
    want = plain_language(pages, models)
    assert set(got) == set(want)
    for i, (lang, probability, by_text, host) in want.items():
        assert (got[i].lang, got[i].text_lang, got[i].host) == (lang, by_text, host) and math.isclose(got[i].probability, probability, abs_tol=1e-9)
    lies = [i for i in truth if i % 10 == 3 or i % 12 == 5]
    assert np.mean([got[i].lang == truth[i] for i in lies]) > 0.9 and np.mean([got[i].lang == truth[i] for i in truth]) > 0.97


def test_workers_hold_little_of_a_batch():
    """What numpy holds at once for many texts is bounded by a piece of them, not by the batch."""
    import tracemalloc

    import pyarrow as pa

    from panelkit.llm import neardup

    rnd = np.random.RandomState(5)
    texts = [" ".join(map(str, rnd.randint(0, 100_000, 400))) for _ in range(900)]  # 2 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "jk": list(range(900)), "text": texts})
    runs = {
        "weighed": (lambda: classifier._weighed(iter([batch]), np.zeros(classifier.BUCKETS)), 60_000_000),
        "summaries": (lambda: neardup._summaries(iter([batch]), 5), 15_000_000),
    }
    for name, (run, most) in runs.items():
        rows = sum(len(b) for b in run())  # tables of powers are kept from here on
        tracemalloc.start()
        try:
            assert sum(len(b) for b in run()) == rows == 900, name
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < most, (name, peak)
