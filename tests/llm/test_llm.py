"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, quality, sharding, simhash, suffixes, toxicity, urls, wrappers
from tidemark.llm.components import components
from tidemark.llm.common import Written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, score double, stratum string"


def make_docs(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "é"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", "   \n\t", "one", "one", "a b c", "A b C", "x" * 900, "ab" * 400]
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 120, 300])))
        if i % 3 == 0:
            w = t.split()
            w[len(w) // 2 : len(w) // 2] = passage.split()
            t = " ".join(w)
        texts.append(t)
        if i % 4 == 0:
            texts.append(t)
        if i % 5 == 0 and len(t) > 200:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, 2, 0.5, "z") for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, "lonely null id", None, None, 5, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Written(spark)).collect()}
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert found == {x: top(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = Tokenizer.from_file(path)
    special = packing.encoder(path, ranks)
    for text in ("a <|endoftext|> b", "", "naïve 日本"):
        assert list(special(text)) == exact.encode(text, add_special_tokens=False).ids
    out = packing.pack(docs, path, ranks, length=64, group=50, with_ids=True).collect()
    want = Counter((r[0], tuple([*exact.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    got, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(k[1]) * v for k, v in want.items())
    for k, n in Counter(k[0] for k in want.elements()).items():
        if n == 1:
            parts = sorted(got[k], key=lambda r: r.start)
            assert (k, tuple(i for r in parts for i in r.ids)) in want and all(r.doc_tokens == sum(len(p.ids) for p in parts) for r in parts)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 64 + 4
    assert packing.pack(empty, path, ranks).count() == 0


def test_first_fit_decreasing_is_first_fit():
    lengths = np.array([random.Random(i).randrange(1, 65) for i in range(300)])
    bins, _ = packing.first_fit_decreasing(lengths, 64)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        at = next((j for j, r in enumerate(room) if r >= lengths[i]), None)
        if at is None:
            room.append(64)
            at = len(room) - 1
        room[at] -= lengths[i]
        assert bins[i] == at


def counts_of(t):
    t = t or ""
    w, windows, seen, dup = WORD.findall(t), defaultdict(list), set(), 0
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality(spark, docs, rows, empty):
    for text in [r[1] for r in rows] + ["a b c a b c\n\nx\nx\n y\nx", "# $ |a| <b>\r\na", "é é é é é"]:
        assert quality.measure(text)[:5] == counts_of(text)
    rng = random.Random(2)
    good = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(80)), "en" if i % 2 else None) for i in range(1200)]
    bad = [(2000 + i, " ".join(f"w{rng.randrange(900)}%%%" for _ in range(80)), "en" if i % 2 else None) for i in range(200)]
    labels = [(i, 1) for i, *_ in good[:1100]] + [(i, 0) for i, *_ in bad[:150]] + [(None, 1), (5, None)]
    out = quality.quality(spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)
    none = spark.createDataFrame([], "doc_id long, quality int")
    plain = {(r.doc_id, r.n_words): r.kept for r in quality.quality(docs, none).collect()}
    assert len(plain) and all(v == (n >= 50) or not v for (_, n), v in plain.items())
    assert quality.quality(docs, none).count() == len(rows) and quality.quality(empty, none).count() == 0


def test_certified_cutoffs(spark):
    """Verdicts against the same paths and tests in plain Python, and the share of good texts that go."""
    rng = random.Random(31)

    def text(symbols, junk):
        return " ".join(f"w{rng.randrange(10**6)}" + ("%" if rng.random() < symbols else "") + ("X!" if rng.random() < junk else "") for _ in range(60))

    rows, labels = [], []
    for i in range(6000):
        lang = ("en", "de", "fr", None)[i % 4]
        good = rng.random() < 0.7
        rows.append((i, text(rng.betavariate(1, 9) if good else rng.betavariate(3, 3), rng.betavariate(1, 9) if good else rng.betavariate(2, 4)), lang))
        if lang != "fr" and (lang is not None or i < 200):
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.kept for r in quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    tuning = {r.doc_id: r.t for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)) == 0).alias("t")).collect()}
    scores = {}
    for i, t, _ in rows:
        n, chars, symbols, dup, repeat, lines, shouts = quality.measure(t)
        scores[i] = [symbols / n, dup / lines, repeat / n, shouts / chars, chars / n / 20]
    truth, depths = dict(labels), {}
    for lang in ("en", "de", "fr", None):
        own = [i for i, _, x in rows if x == lang and i in truth]
        half = [i for i in own if tuning[i]]
        counts = {"good": sum(truth[i] for i in half), "bad": sum(1 - truth[i] for i in half)}
        for k, wanted in (("g", 1), ("b", 0)):
            for at, rule in enumerate(quality.RULES):
                counts |= {f"{k}_{rule}_{c}": sum(truth[i] == wanted and scores[i][at] > cutoff for i in half) for c, cutoff in enumerate(quality.CUTOFFS)}
        path = quality.path_of(counts) if own else []
        goes = lambda i, upto: any(scores[i][at] > cutoff for at, cutoff in path[:upto])  # noqa: B023, E731
        held = {v: [i for i in own if truth[i] == v and not tuning[i]] for v in (0, 1)}
        depth, best = 0, 0
        for t in range(1, len(path) + 1):
            gone, caught = (sum(goes(i, t) for i in held[v]) for v in (1, 0))
            if not held[1] or quality.binomial_bound(gone, len(held[1]), 0.05 / 3) > 0.05:
                break
            if caught / max(1, len(held[0])) - gone / len(held[1]) > best + 1e-12:
                depth, best = t, caught / max(1, len(held[0])) - gone / len(held[1])
        depths[lang] = depth
        assert all(out[i] == (not goes(i, depth)) for i, _, x in rows if x == lang)
    assert depths["en"] and depths["de"] and not depths["fr"]
    good = [out[i] for i, v in labels if v]
    assert sum(good) >= 0.95 * len(good) and sum(out[i] for i, v in labels if not v) < 0.8 * sum(1 - v for _, v in labels)


def test_binomial_bound():
    assert quality.binomial_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.binomial_bound(5, 5, 0.05) == 1.0
    assert quality.binomial_bound(3, 50, 0.01) > quality.binomial_bound(3, 50, 0.1) > 3 / 50


def test_urls(spark):
    pages = [(1, "http://A.example.COM/en/7?x", "<a href='//bad.org/x'>"), (2, None, None), (3, "no scheme", ""), (4, "http://b.net/de/1#t", None), (5, "ftp://x.example.net/de/85", "y"), (5, "ftp://x.example.net/de/85", "y"), (6, "http://com/en/", ""), (7, "http://xcom/en/", ""), (8, "http://q.org", "z")]
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect() if r.rule)
    assert out == [(1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (4, "b.net", "/de/1", "net/de/", "block"), (5, "x.example.net", "/de/85", "example.net/de/8", "allow"), (5, "x.example.net", "/de/85", "example.net/de/8", "allow"), (6, "com", "/en/", "com/en/", "block")]
    rest = {r.page_id: (r.host, r.path, r.verdict) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect() if not r.rule}
    assert rest == {2: ("", "", "allow"), 3: ("", "", "allow"), 7: ("xcom", "/en/", "allow"), 8: ("q.org", "", "allow")}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_rules_are_the_contracts(spark):
    """Each rule's word by the contract's list: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: word for word, h, p in urls.RULES} == words
    pages = [(10 * i + j, f"http://{sub}{rule}{rest}", None) for i, rule in enumerate(words) for j, (sub, rest) in enumerate((("", ""), ("a.B.", "1/x?q#f")))]
    out = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {10 * i + j: (rule, word) for i, (rule, word) in enumerate(words.items()) for j in range(2)}


def test_urls_by_links(spark):
    """Hosts without a rule, by whom they link to and who links to them, against dense linear algebra."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [(i, f"http://shop{i % 3}.com/en/{i}", link("spam.example")) for i in range(9)]  # blocked by the rule com/en/
    pages += [(20 + i, f"http://farm{i}.example/x", link("shop0.com", "shop1.com")) for i in range(3)]  # link to the blocked
    pages += [(30 + i, "http://spam.example/y", "") for i in range(2)]  # is linked by the blocked only
    pages += [(40 + i, f"http://w{i}.example.com/en/7", link("good.example", "farm0.example")) for i in range(4)] + [(50, "http://good.example/", link("shop2.com")), (51, "http://alone.example/", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in urls.filter_urls(frame).collect()}
    hosts = sorted({u.split("/")[2] for _, u, _ in pages})
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for _, u, html in pages:
        for dst in set(re.findall("https://([^/]+)", html)):
            w[at[u.split("/")[2]], at[dst]] += 1
    for h in hosts:
        above = h.split(".", 1)[1]
        if above.count(".") >= 2 and above in at:
            w[at[h], at[above]] += 0.5
            w[at[above], at[h]] += 0.5

    def rank(w, seeds):
        share = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        s = np.array([seeds.get(h, 0) for h in hosts], float)
        x = np.linalg.solve(np.eye(len(hosts)) - 0.85 * share.T, s)
        return x / x.sum()

    trust, distrust = rank(w, {f"w{i}.example.com": 1 for i in range(4)}), rank(w.T, {f"shop{i}.com": 3 for i in range(3)})
    for i, u, _ in pages:
        h = u.split("/")[2]
        if not re.search(r"shop\d\.com|example\.com", h):
            n = sum(x.split("/")[2] == h for _, x, _ in pages) / len(pages)
            part = distrust[at[h]] / (trust[at[h]] + distrust[at[h]] + n)
            assert out[i] == ("block" if part > 0.5 else "allow"), (h, part)
    assert {out[21], out[22]} == {"block"} and out[50] == out[51] == out[30] == "allow"


def test_propagation(spark):
    edges = [("x", "a", "b", 1.0), ("x", "b", "c", 1.0), ("x", "c", "a", 1.0), ("x", "a", "c", 1.0), ("x", "d", "a", 2.0), ("x", "b", "end", 1.0), ("y", "b", "a", 1.0)]
    seeds = [("x", "a", 3.0), ("x", "b", 1.0), ("y", "q", 1.0)]
    ranks = urls.propagated(spark.createDataFrame(edges, "kind string, src string, dst string, w double"), spark.createDataFrame(seeds, "kind string, host string, mass double"), Written(spark))
    found = {(r.kind, r.host): r["rank"] for r in ranks.collect()}
    rank = {"a": 0.75, "b": 0.25}
    for _ in range(300):  # mass at the end without edges goes back to the seeds
        new = {h: s * (0.15 + 0.85 * rank.get("end", 0)) for h, s in (("a", 0.75), ("b", 0.25))}
        for s, d, share in (("a", "b", 0.5), ("b", "c", 0.5), ("b", "end", 0.5), ("c", "a", 1), ("a", "c", 0.5), ("d", "a", 1)):
            new[d] = new.get(d, 0) + 0.85 * share * rank.get(s, 0)
        rank = new
    assert found == pytest.approx({("x", h): r for h, r in rank.items()} | {("y", "q"): 1.0}, abs=1e-3)


def brute_near(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min((d for d in least[top(i)] if d is not None), default=None)) for i, r in enumerate(rows))


def test_near_duplicates(docs, rows, empty, monkeypatch):
    out = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_torn_buckets(spark):
    """Chains a - b - c where a and c are too far apart, and sets that share a bucket by a common part only."""
    rng = random.Random(8)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join([*core, *(f"u{i}x{k}" for k in range(18 if i % 2 else 90))])))
    for i in range(40, 70):
        rows.append((i, " ".join([*core[: 60 - (i - 40)], *(f"t{k}" for k in range(i - 40)), *(f"z{k}" for k in range(30))])))
    rng.shuffle(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_near(rows)


def test_mix(docs, rows, empty):
    out = mixing.mix(docs, rows_each=10).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, rows_each=10).collect()))
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted((s for s in total if s is not None)) + [None]
    weight = dict(zip(names, [3, 1, 2] * 5, strict=False))
    goal, full = 1.5 * sum(total.values()), {}
    while True:
        left = goal - sum(full.values())
        free = [n for n in names if n not in full]
        each = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if each[n] > 2 * total[n]]
        if not over:
            break
        full |= {n: 2.0 * total[n] for n in over}
    target = full | each
    for n in names:
        own = [r for r in out if r.source_size == total[n] and abs(r.target - target[n]) < 1e-6]
        assert own and sum(r.taken for r in own) == int(target[n] + 1e-9)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    again = mixing.mix(docs.repartition(7, "n_chars").sortWithinPartitions(F.desc("doc_id"), "text"), rows_each=10).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))
    assert mixing.mix(empty).count() == 0
    clashing = docs.select("doc_id", "text", "source", *(F.lit(7).alias(c) for c in ("_id", "_nth", "_taken", "_SIZE", "_turn", "taken", "size", "target")))
    assert mixing.mixed_rows(clashing).columns == clashing.columns and mixing.mixed_rows(clashing).where("_id <> 7 OR taken <> 7").count() == 0
    mixed = mixing.mixed_rows(docs).collect()
    assert sum(size(r.text) for r in mixed) == sum(int(target[n] + 1e-9) for n in names)


def brute_print(text):
    """Each bit by its own vote, without the batches and packed bits of the operator."""
    words, votes = simhash.word_hashes(simhash.as_bytes(text)), [0.0] * 128
    for n, half in ((1, 0.5), (2, 1.0)):
        for term, count in Counter(simhash.run_hashes(words, n).tolist()).items():
            w = (1 + math.log(count)) * half
            for k in range(2):
                own = int(simhash.mix(np.array([term], "uint64"), k)[0])
                for byte in range(8):
                    for bit in range(8):
                        votes[64 * k + 8 * byte + bit] += w if own >> (8 * byte + 7 - bit) & 1 else -w
    return votes


def test_votes():
    rng = random.Random(21)
    texts = ["", "one", "a b a b a", " ".join(f"w{rng.randrange(300)}" for _ in range(700)), " ".join(f"w{i}" for i in range(9000))]
    for text in texts:
        bits = np.unpackbits(np.frombuffer(simhash.fingerprint(text), "uint8"))
        assert all(b == (v > 0) for b, v in zip(bits, brute_print(text), strict=True) if abs(v) > 0.05)


def test_fingerprints(spark, docs, rows, empty):
    out = simhash.against_next(docs, bytes_each=2000).collect()
    hashes = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    assert len(out) == len(rows)
    want, prints = Counter(), {int(simhash.fingerprint(r[1]).hex(), 16) for r in rows}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = simhash.fingerprint(text)
        near = sum(0 < (int(own.hex(), 16) ^ p).bit_count() <= 3 for p in prints)
        want[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), simhash.fingerprint(edited).hex(), simhash.likeness(own, simhash.fingerprint(after)), near] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next, r.n_near) for r in out) == want
    assert simhash.against_next(empty).count() == 0
    one = simhash.against_next(docs.where("doc_id = 12"), bytes_each=10).collect()
    assert [r.near_next for r in one] == [1.0]
    ties = spark.createDataFrame([(None, f"t{i % 7} x{i % 5}") for i in range(60)], "doc_id long, text string")
    assert simhash.against_next(ties, bytes_each=50).count() == 60


def test_near_pairs(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(40):
        v = rng.getrandbits(128)
        prints.append(v)
        for flips in (1, 2, 3, 4, 5):
            w = v
            for b in rng.sample(range(128), flips):
                w ^= 1 << b
            prints.append(w)
    hexed = [f"{v:032x}" for v in prints] + [None, f"{prints[0]:032x}"]
    got = {(r.a, r.b, r.distance) for r in simhash.near_pairs(spark.createDataFrame([(h,) for h in hexed], "fingerprint string")).collect()}
    own = sorted({h for h in hexed if h})
    assert got == {(a, b, d) for i, a in enumerate(own) for b in own[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}


def brute_repeats(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_rows", [3000, 2])
def test_repeated_bytes(docs, rows, empty, block_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", block_rows)
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(docs).collect()) == want
    assert suffixes.repeated_bytes(empty).count() == 0


def test_longest_previous_factors():
    rng = random.Random(12)
    for alphabet, n in ((b"ab", 900), (b"a", 700), (b"abcdefgh", 500)):
        piece = bytes(rng.choices(alphabet, k=250))
        data = bytes(rng.choices(alphabet, k=n)) + piece + bytes(rng.choices(alphabet, k=40)) + piece + bytes(rng.choices(alphabet, k=220))
        starts = np.array(sorted(rng.sample(range(len(data) - 199), 150)))
        order, prefixes = suffixes.suffix_array(np.frombuffer(data, "uint8"), starts)
        assert [(data[starts[i] :][:200], i) for i in order] == sorted((data[s:][:200], i) for i, s in enumerate(starts))
        common = lambda a, b: next((k for k in range(200) if data[a + k] != data[b + k]), 200)
        assert prefixes.tolist() == [0] + [common(starts[a], starts[b]) for a, b in zip(order, order[1:])]
        want = [max((common(starts[i], starts[j]) for j in range(i)), default=0) for i in order]
        assert suffixes.previous_factors(order, prefixes).tolist() == want


def test_anchors_do_not_depend_on_the_seam(monkeypatch):
    rng = random.Random(14)
    data = np.frombuffer(bytes(rng.choices(b"abc ", k=9000)) + b"ab" * 900, "uint8")

    def of_windows():
        pos, n, anchor, _ = suffixes.anchored(data)
        return np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(anchor, n)

    want = of_windows()
    monkeypatch.setattr(suffixes, "POSITION_BITS", 11)
    at, anchor = of_windows()
    assert at.tolist() == want[0].tolist() == list(range(len(data) - 199)) and (anchor == want[1]).all()


def test_repeats_of_long_texts_and_repeated_rows(spark, monkeypatch):
    """Texts over the seam of pieces, a row repeated often, and a passage in many texts."""
    rng = random.Random(13)
    words = [f"{rng.randrange(10**6)}" for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    long = text(1500)
    rows = [(1, long + passage + long[3000:5000]), (2, text(50) + long[1800:2300] + text(30)), (3, "ab" * 3000)]
    rows += [(10 + i, text(20) + passage + text(20)) for i in range(40)] + [(99, text(15) + passage + "tail")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([r[1].encode() for r in rows]), strict=True))
    for block_rows in (3000, 3):
        monkeypatch.setattr(suffixes, "BLOCK_ROWS", block_rows)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(docs).collect()) == want
        kept = {r.doc_id: r.text for r in suffixes.without_repeats(docs).collect()}
        assert kept[99] == rows[-1][1].replace(passage, "") or len(kept[99]) < len(rows[-1][1])
        assert sum(passage in t for t in kept.values()) == 1 and passage in kept[1]
    again = spark.createDataFrame([r for r in rows if r[0] == 99], "doc_id long, text string")
    assert {r.text for r in suffixes.without_repeats(again).collect()} == {rows[-1][1]}


def test_parts_of_the_second_sort_are_bounded(spark, monkeypatch):
    """A passage in many texts: the second sort gets the strings around it in parts of SORT_STARTS, however many a block has."""
    rng = random.Random(15)
    text = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    passage = text(45)
    rows = [(i, text(60) + passage + text(60)) for i in range(160)] + [(500 + i, f"{i} " + "ab" * 300) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 40)
    monkeypatch.setattr(suffixes, "SORT_STARTS", 1000)
    keep = Written(spark)
    suffixes.repeat_ranges(docs, keep, False)
    found = spark.read.parquet(next(path for name, path, _ in keep.tables if name == "found")).where("key IS NOT NULL")
    sizes = [r.n for r in found.groupBy("key").agg(F.sum(F.size("members")).alias("n")).collect()]
    assert sum(sizes) > 5000 and max(sizes) <= 1500
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([r[1].encode() for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(docs).collect()) == want


def test_second_sort_holds_few_times_its_strings():
    """20,000 strings of one key, half of them twice, in packets: the sort takes a few times their bytes at its peak."""
    rng = np.random.default_rng(16)
    strings = rng.integers(97, 101, (10_000, 200), dtype="uint8")
    strings = np.concatenate([strings, strings])
    members = [[{"doc": i, "doc_id": None if i % 7 == 0 else i, "pos": 3} for i in range(at, at + 1000)] for at in range(0, 20_000, 1000)]
    packets = [strings[at : at + 1000].tobytes() for at in range(0, 20_000, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 20), pa.array(members, pa.list_(suffixes.MEMBER)), pa.array(packets)], names=["key", "members", "bytes"])
    del members, packets
    tracemalloc.start()
    out = [r for b in suffixes._sorter(("key",), False, False)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(r["doc"] for r in out) == list(range(20_000)) and all((r["low"], r["high"]) == (3, 4) for r in out)
    assert peak < 10 * strings.nbytes


@pytest.mark.parametrize("block_rows", [3000, 2])
def test_without_repeats_keeps_the_first(spark, rows, block_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", block_rows)
    own = [r for i, r in enumerate(rows) if r[0] is not None and r not in rows[:i]]
    out = suffixes.without_repeats(spark.createDataFrame(own, SCHEMA).repartition(3))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got, seen = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}, set()
    for r in sorted(own, key=lambda r: r[0]):
        t = (r[1] or "").encode()
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if t[i : i + 200] in seen:
                mark[i : i + 200] = b"\1" * 200
            seen.add(t[i : i + 200])
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m).decode("utf-8", "ignore")
        assert got[r[0]] == ((None, r[4]) if r[1] is None else (kept, len(kept)))


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    rude = ["idiotic", "moronic", "scumbag"]
    make = lambda bad: " ".join([f"{rng.choice('abcdefgh')}{rng.choice('ijklm')}{rng.randrange(50)}" for _ in range(60)] + ([rng.choice(rude) + rng.choice(["", "s", "er", "o"])] * 2 if bad else []))
    data = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    texts, labels = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(texts, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(r.predicted, data[i][2]) for i, r in out.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, none).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, none).collect())


def test_toxicity_reads_long_runs():
    run = "".join(f"{i:03d}" for i in range(90))
    for text in (run, run[:65], run[:71]):
        words = toxicity.distinct_words(text)
        assert all(any(text[i : i + n] in w for w in words) for n in (3, 4, 5) for i in range(len(text) - n + 1))
    assert toxicity.distinct_words("x" * 64) == ["x" * 64]
    rng = random.Random(9)
    rude, clean = ["idiotic", "moronic", "scumbag", "笨蛋白痴"], [f"{a}{b}{c}" for a in ("ka", "lu", "me", "to") for b in ("rin", "sol", "vat") for c in ("a", "o", "ys")] + ["春天", "学校", "河流", "音乐", "早晨"]
    texts = [" ".join(rng.choices(clean, k=60) + ([rng.choice(rude)] * 2 if i % 4 == 0 else [])) for i in range(600)]
    model = toxicity.pack_model(*toxicity.train(texts, np.array([int(i % 4 == 0) for i in range(600)])))
    for joint in ("-", "_", "/", "。", ""):
        prefix = joint.join(rng.choices(clean, k=30))
        scores = toxicity.score([prefix, *(joint.join([prefix, r, r, clean[0]]) for r in rude)], model)
        assert scores[0] < 0.3 and all(scores[1:] >= 0.3), (joint, scores)


PAGE = "<!doctype html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav><header>top</header><div class='ad banner'>buy</div><article><h1>{0} &amp; b</h1><p><b>in</b>line{1}<br>next<p>second <!-- gone --> part<aside>side</aside><form>ask</form><div class=comments>rude</div></article><footer>&copy; f</footer></body></html>"


def test_extract(spark):
    pages = [(i, f"http://H{i % 2}.org/{i}", PAGE.format(f"t{i}", i)) for i in range(7)] + [(8, None, None), (9, "http://x/", ""), (9, "http://x/", ""), (10, "http://h1.org/q", PAGE.format("cut", 1)[:300]), (11, "http://odd/", "<p>only <i>text</i></p>\n\n<div>more&nbsp;here</div>")]
    out = sorted((r.page_id, r.url, r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect() if r.url)
    want = {i: f"t{i} & b inline{i} next second part" for i in range(7)} | {9: "", 11: "only text more here"}
    for i, _, text, n in out:
        assert n == len(text) and (i not in want or text == want[i])
    assert len(out) == len(pages) - 1
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_alignment():
    a, b = wrappers.parse("<div><p>x</p><p>y</p><table></table></div>"), wrappers.parse("<div><h2>t</h2><p>x</p></div>")
    kids = wrappers.merge(a, b).kids[0].kids
    assert [(k.label, k.repeated, k.optional) for k in kids] == [("h2", False, True), ("p", True, False), ("table", False, True)]


def main_texts(pages):
    """Texts of one host's pages by their common wrapper."""
    wrapper = wrappers.named(wrappers.parse(pages[0]))
    wrapper = wrappers.merge(wrapper, wrapper)
    for page in pages[1:]:
        wrapper = wrappers.merge(wrapper, wrappers.named(wrappers.parse(page)))
    wrapper = wrappers.Node.of(wrappers.json.loads(wrappers.json.dumps(wrapper.plain())))
    return [wrappers.main_text(wrappers.parse(page), wrapper) for page in pages]


def test_the_alignment_decides_on_the_main_region():
    """Tags and names mislead on these hosts; only what varies between their pages tells the text."""
    body = lambda i: f"long own text {i} " * 20
    teaser = [f"<body><article class=teaser>the same offer</article><div class=post><h2>t{i}</h2><p>{body(i)}</p></div></body>" for i in range(4)]
    assert main_texts(teaser) == [f"t{i} {body(i)}".strip() for i in range(4)]
    search = [f"<body><nav>menu</nav><div class='search results'><p>{body(i)}</p></div><footer>f</footer></body>" for i in range(4)]
    assert main_texts(search) == [body(i).strip() for i in range(4)]
    rude = [f"<body><article><p>short {i}</p></article><div class=comments>{body(i)}</div><div class=ad>{body(i)}</div></body>" for i in range(4)]
    assert main_texts(rude) == [f"short {i}" for i in range(4)]
    one = "<body><article>short</article><div>much more beside it, but nothing to hold it against</div></body>"
    assert main_texts([one]) == ["short"]
    odd = [f"<body><main><p>{body(i)}</p></main></body>" for i in range(4)] + ["<body><div>a page without the element</div></body>"]
    assert main_texts(odd) == [body(i).strip() for i in range(4)] + ["a page without the element"]


def test_aligned():
    rng = random.Random(15)
    for cells in (40_000, 0):
        for _ in range(60):
            x, y = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
            pairs = wrappers.aligned(x, y, cells)
            assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
            if cells:
                best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
                for i, j in ((i, j) for i in reversed(range(len(x))) for j in reversed(range(len(y)))):
                    best[i][j] = max(best[i + 1][j + 1] + (x[i] == y[j]), best[i + 1][j], best[i][j + 1])
                assert len(pairs) == best[0][0]
    x = [f"p.{i}" for i in range(60_000)]
    y = [k for i, k in enumerate(x) if i % 7] + ["end"]
    assert len(wrappers.aligned(x, y)) == len(y) - 1
    assert len(wrappers.aligned(["a", "b"] * 30_000, ["b", "c", "a"] * 20_000)) >= 20_000


def test_template_slots_are_counted_by_pages():
    own = [f"<p>same on all</p><div id=post-{i}1><h2>title {i}</h2>text {i}</div>" for i in range(4)]
    assert main_texts(own) == [f"title {i} text {i}" for i in range(4)]
    lone = ["<p>x1</p>", "<p>x2</p>", "<p>x3</p><blockquote>quoted</blockquote>", "<p>x4</p><table><tr><td>cell</table>"]
    assert main_texts(lone) == ["x1", "x2", "x3 quoted", "x4 cell"]
    assert main_texts(["<p>a copy</p><div>of one page</div>"] * 5) == ["a copy of one page"] * 5
    beside = [f"<div>own {i}<hr><p>p{i}</p>the same</div>" for i in range(4)]
    assert main_texts(beside) == [f"own {i} p{i}" for i in range(4)]
    assert main_texts(beside[:2]) == [f"own {i} p{i} the same" for i in range(2)]
    assert main_texts([f"<div id=a{i}x>kept {i}</div>" for i in range(4)]) == [f"kept {i}" for i in range(4)]


def test_parse_leaves_no_text_out():
    for n in (150, 300, 20_000):
        deep = "<article>" + "<div>" * n + "<div>in</div><nav>menu</nav>" + "<blockquote>" * n + "</div>after</article><footer>end</footer>"
        assert main_texts([deep, deep]) == ["in after"] * 2
        early = "<div><article>" + "<blockquote>" * n + "<div>in</div>after"
        assert main_texts([early, early]) == ["in after"] * 2
        leak = "<article>" + "<blockquote>" * n + "in<nav>menu</nav>"
        assert main_texts([leak, leak]) == ["in"] * 2
    assert main_texts(["<html><head><title>t</title><meta charset=x><body><p>text</p></body></html>"]) == ["text"]
    assert main_texts(["<head><title>t</title><style>s</style>plain <b>text</b>"]) == ["plain text"]
    assert main_texts(["<head><script>x</script><link rel=a><title>t</title></head><p>text"]) == ["text"]
    for tag in ("svg", "iframe", "object"):
        assert main_texts([f"<p>one</p><{tag} a='b'/><p>two</p><{tag}/><p>three</p><{tag} /><p>four</p>"]) == ["one two three four"]
    assert main_texts(["<p>one</p><script src=/a/>var x;</script><svg><path d=''/>s</svg><p>two</p>"]) == ["one two"]
    assert main_texts(["<body class='no-sidebar'><p>text</p></body>"]) == ["text"]
    assert main_texts(["<body><main id=comments><article class='post comments-open'>text</article></main></body>"]) == ["text"]


def brute_capacity(sizes, shards):
    low = max([-(-sum(sizes) // shards), *sizes])
    while True:
        used, at = 1, 0
        for s in sizes:
            if at + s > low:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            return low
        low += 1


def test_smallest_capacity():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))]
        assert sharding.smallest_capacity(sizes, 8)[0] == brute_capacity(sizes, 8)


def test_shard(spark, docs, rows, empty):
    out = sharding.shard(docs, rows_each=3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in groups.values())
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    order = [r["size"] for r in keyed.orderBy("key").collect()]
    loads = Counter()
    for r in out:
        loads[r.shard] += r["size"]
    assert max(loads.values()) == brute_capacity(order, 8)
    assert sharding.shard(empty).count() == 0
