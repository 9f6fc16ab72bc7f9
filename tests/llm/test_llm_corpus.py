"""N-gram join, decontamination, context-tree weighting, toxicity and URL rules against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, ctw, decontam, ngram_join, queries, toxicity, url_rules
from tessera.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, n long, component_id string, score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (900, None, None, None, None, None), (901, "", "x", 1, "y", "z"), (0, texts[0], "x", 1, "y", "z"), (None, texts[0], "x", 1, "y", "z")], schema)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(texts, k, percent):
    """Component of each number of ``texts``, all pairs compared."""
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if common_ and 100 * common_ >= percent * (len(sets[i]) + len(sets[j]) - common_):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def near_copies(rng, n, edits=4):
    """Families of edited copies, with passages that many share."""
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(12)] for _ in range(3)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        out.append(" ".join(w).title() if rng.random() < 0.2 else "\t".join(w))
    return out


@pytest.mark.parametrize(("frequent", "block", "trials", "others", "k", "percent"), [(32, 256, 16, 4096, 4, 85), (3, 8, 1, 4096, 4, 85), (3, 8, 1, 2, 4, 85), (2, 5, 0, 0, 5, 80)])
def test_ngram_join_loses_no_link(spark, monkeypatch, frequent, block, trials, others, k, percent):
    monkeypatch.setattr(ngram_join, "OTHERS", others)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TRIALS", trials)
    texts = near_copies(random.Random(frequent), 220)
    got = {(r["doc_id"]): r for r in ngram_join.link(frame(spark, texts), k=k, percent=percent).collect()}
    for i, c in enumerate(linked(texts, k, percent)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(shingles(texts[i], k)), c)
    assert (got[900]["n_shingles"], got[900]["component_id"]) == (0, 900)
    assert got[901]["component_id"] == 901
    assert got[None]["component_id"] is None


def test_ngram_keys_meet_for_every_linked_pair():
    """Pairs at the threshold share a key, whichever shingles count as frequent."""
    rng = np.random.default_rng(7)
    threshold = ngram_join.Threshold(85)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = base[rng.random(len(base)) > rng.random() * 0.16]
        other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(base, other))
        if not len(other) or not threshold.links(len(base), len(other), shared):
            continue
        scale = rng.choice([ngram_join.ALONE + 5, 60], 1 << 10, p=(p := rng.random()) * np.array([1, -1]) + np.array([0, 1])).astype(np.uint8)
        a, b = (ngram_join.keys(x, scale, 40, threshold) for x in (base, other))
        assert len(np.intersect1d(a, b)), (len(base), len(other), shared)
        assert abs(threshold.size_bin(len(base)) - threshold.size_bin(len(other))) <= 1
        assert len(a) <= 16 * len(base) + 16


def test_ngram_shingles_of_one_document_make_no_keys():
    threshold, own = ngram_join.Threshold(85), np.arange(100, dtype=np.uint64)
    scale = np.full(128, ngram_join.ALONE + 5, np.uint8)
    assert len(ngram_join.keys(own, scale, 40, threshold)) == 16
    scale[:10] = ngram_join.ALONE
    assert len(ngram_join.keys(own, scale, 40, threshold)) == 6
    scale[:16] = ngram_join.ALONE
    assert not len(ngram_join.keys(own, scale, 40, threshold))


def test_ngram_join_in_a_family_of_thousands(spark, monkeypatch):
    """2,000 near copies of one text, some beyond the threshold: links grow with the documents, and none is lost."""
    rng = random.Random(21)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 9])):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    counted, plain = [], ngram_join.components

    def counting(edges):
        counted.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in ngram_join.link(docs).orderBy("doc_id").collect()]
    sets = [shingles(t, 4) for t in texts]
    parent = list(range(2000))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(2000):
        for j in range(i):
            a, b = root(i), root(j)
            if a != b and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(a, b)] = min(a, b)
    assert got == [root(i) for i in range(2000)]
    assert max(counted) < 20 * 2000


def test_keep_one(spark):
    texts = near_copies(random.Random(9), 60)
    kept = ngram_join.keep_one(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "id", "n", "component_id", "score"]
    component = linked(texts, 4, 85)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted([-1, 900, 901, *{c for c in component}])
    empty = frame(spark, texts).limit(0)
    assert ngram_join.link(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1001), (1001, 1001), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(17)).collect())
    assert got == {**{i: 0 for i in range(501)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_alignment(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


def test_alignment():
    rng = random.Random(2)
    for _ in range(200):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(1, 15))], np.uint64)
        passage = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))], np.uint64)
        score, begin, end = decontam.align(item, passage)
        assert score == pytest.approx(brute_alignment(item.tolist(), passage.tolist()))
        assert brute_alignment(item.tolist(), passage[begin:end].tolist()) == pytest.approx(score)


def test_leaks_of_exact_and_edited_items(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(12, 40)) for _ in range(30)]
    docs, planted = [], set()
    for d in range(80):
        w = text(rng.randint(0, 200))
        if d % 3 == 0:
            i = rng.randrange(len(items))
            copy = [x if rng.random() > 0.15 else rng.choice(vocabulary) for x in items[i]]
            at = rng.randint(0, len(w))
            w[at:at] = copy
            if brute_alignment(items[i], copy) >= 0.6:
                planted.add((d, i))
        docs.append(" ".join(w).capitalize() + ".")
    table = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (77, None), (None, "a b c d"), (78, "two words"), (0, " ".join(items[0]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(frame(spark, docs), table).collect()}
    assert planted <= set(got)
    for (d, i), score in got.items():
        if d is not None:
            assert brute_alignment(items[i], re.sub(r"[^\w ]", " ", docs[d].lower()).split()) == pytest.approx(score, abs=1e-9)
    clean = decontam.drop_leaking(frame(spark, docs), table)
    assert {r["doc_id"] for r in clean.collect()} == ({*range(80), 900, 901, None} - {d for d, _ in got if d is not None})
    assert decontam.leaks(frame(spark, docs), table.limit(0)).count() == 0
    assert decontam.leaks(frame(spark, docs).limit(0), table).count() == 0


def test_recall_of_heavily_edited_copies(spark):
    """Copies whose alignment is just above the threshold: nine of ten are found from 0.5 to 0.6, all above."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(25, 50))] for _ in range(40)]
    docs, want = [], {}
    for d in range(1500):
        i, share = rng.randrange(len(items)), rng.uniform(0.1, 0.4)
        copy = []
        for word in items[i]:
            edit = rng.random()
            if edit > share:
                copy.append(word)
            elif edit > share / 2:
                copy.append(rng.choice(vocabulary))
            if rng.random() < share / 4:
                copy.append(rng.choice(vocabulary))
        docs.append(" ".join([*rng.choices(vocabulary, k=20), *copy, *rng.choices(vocabulary, k=20)]))
        ids = {w: n for n, w in enumerate({*items[i], *docs[-1].split()})}
        want[d, i] = decontam.align(np.array([ids[w] for w in items[i]]), np.array([ids[w] for w in docs[-1].split()]))[0]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(spark, docs), table).collect()}
    low, high = {k for k, v in want.items() if 0.5 <= v < 0.6}, {k for k, v in want.items() if v >= 0.6}
    assert len(low) > 150 and len(low & got) >= 0.9 * len(low)
    assert len(high) > 500 and high <= got
    assert not {k for k, v in want.items() if v < 0.5} & got


def contexts_of(texts, depth):
    data, offsets = common.text_bytes(pa.array(texts))
    symbols, at = ctw._symbols(data, offsets, depth)
    counts = collections.Counter((tuple(int(symbols[i - d]) for d in range(1, depth + 1)), int(symbols[i])) for i in at)
    out = []
    for d in range(depth + 1):
        names = sorted({sum(b << (8 * i) for i, b in enumerate(c[:d])) for c, _ in counts})
        table = np.zeros((len(names), 256))
        for (c, y), n in counts.items():
            table[names.index(sum(b << (8 * i) for i, b in enumerate(c[:d]))), y] += n
        out.append((np.array(names, np.int64), table))
    return counts, out


def test_context_tree_weights():
    """Mixing by the definition: block probabilities of whole subtrees, decision by decision."""
    depth = 2
    counts, contexts = contexts_of(["abab", "abba", "aab"], depth)
    model = ctw.weigh(contexts)
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def split(items):
        zeros = sum(n for _, x, n in items if not x)
        return zeros, sum(n for *_, n in items) - zeros

    def whole(items, d):
        own = block(*split(items))
        if d == depth:
            return own
        below = sum(whole([i for i in items if i[0][d] == b], d + 1) for b in {i[0][d] for i in items})
        return np.logaddexp(own, below) + math.log(0.5)

    def one(context, items, d):
        zeros, ones = split(items)
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return own
        weight = math.exp(block(zeros, ones) + math.log(0.5) - whole(items, d))
        seen = any(c[: d + 1] == context[: d + 1] for c, _ in counts)
        return weight * own + (1 - weight) * (one(context, [i for i in items if i[0][d] == context[d]], d + 1) if seen else 0.5)

    for text in ["ab", "zz", "", "abbaab", "bax"]:
        symbols, total = [0] * depth + list(text.encode()) + [ctw.END], 0.0
        for i in range(depth, len(symbols)):
            context, y = tuple(symbols[i - d] for d in range(1, depth + 1)), symbols[i]
            for bit in range(8):
                items = [(c, (z >> (7 - bit)) & 1, n) for (c, z), n in counts.items() if z >> (8 - bit) == y >> (8 - bit)]
                p = one(context, items, 0)
                total += math.log10(p if (y >> (7 - bit)) & 1 else 1 - p)
        data, offsets = common.text_bytes(pa.array([text]))
        assert model.score(data, offsets)[0] == pytest.approx(total, rel=1e-5)


def test_next_byte_probabilities_add_up():
    _, contexts = contexts_of(["the cat sat", "on the mat", "the end"], 3)
    kept = [(c, t) if d < 2 else (c[t.sum(1) >= 3], t[t.sum(1) >= 3]) for d, (c, t) in enumerate(contexts)]
    assert np.allclose((10 ** ctw.weigh(kept).log10.astype(float)).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("share", [ctw.GRAM_SHARE, 0.01])
def test_every_context_is_a_node(spark, monkeypatch, share):
    """Scores by tables equal those of the whole tree in memory, also of contexts that hold one byte of many."""
    monkeypatch.setattr(ctw, "GRAM_SHARE", share, raising=False)
    monkeypatch.setattr(ctw, "CHUNK", 50, raising=False)
    texts = ["aaaaaaaaaa" * 800] * 20 + ["zebra quickly", "the cat sat on the mat", "", "é naïve", "the zebra"]
    held_out = ["zebra quickly", "zebras quit", "never seen 123", ""]
    # frame() repeats the first text once.
    model = ctw.weigh(contexts_of([*texts, texts[0]], ctw.DEPTH)[1])
    depth, counts = ctw.train(frame(spark, texts).filter("doc_id < 100").select("text"))
    for shown in (texts, held_out):
        docs = spark.createDataFrame(list(enumerate(shown)), "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in ctw.score(docs, depth, counts).collect()}
        want = model.score(*common.text_bytes(pa.array(shown)))
        assert len(got) == len(shown) and all(got[i] == pytest.approx(want[i], rel=1e-4) for i in got)


@pytest.mark.parametrize("share", [ctw.WORD_SHARE, 0.05])
def test_scores(spark, monkeypatch, share):
    monkeypatch.setattr(ctw, "WORD_SHARE", share)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "cat", "sat", "é", f"n{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    docs = frame(spark, texts)
    model, counts = ctw.train(docs.filter("doc_id < 50").select("text"))
    rows = ctw.score(docs, model, counts).collect()
    train = [w for t in [*texts[:50], texts[0]] for w in [*words(t), None]]
    c, n = collections.Counter(train), len(train)
    assert len(rows) == len(texts) + 4
    for r in rows:
        text = texts[r["doc_id"] or 0] if r["doc_id"] is None or r["doc_id"] < 900 else ""
        own = [*words(text), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in own))
        assert r["score"] < 0
    nothing, none = ctw.train(docs.limit(0).select("text"))
    assert all(r["score"] == pytest.approx(8 * math.log10(0.5) * (len((r2 or "").encode()) + 1), rel=1e-5) for r, r2 in [(r, texts[r["doc_id"]]) for r in ctw.score(docs, nothing, none).collect() if r["doc_id"] is not None and r["doc_id"] < 900])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    plain, bad = [f"p{i}" for i in range(300)], ["vilk", "grub", "snarfel", "snarfet", "snarfum", "zot"]
    texts, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(3, 6) if toxic else rng.random() < 0.02):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, texts), spark.createDataFrame([*labels, (None, 1), (3, None), (4, labels[4][1])], "doc_id long, toxic int")
    held = toxicity.fold(F.col("doc_id")) == 0
    model = toxicity.train(docs.filter(~held), known.filter(~held))
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    test = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == t for i, t in test]) > 0.93
    assert 0 <= got[900] == got[901] < 0.5
    assert set(model.score(docs).columns) == set(docs.columns)
    none = toxicity.train(docs, known.filter("toxic = 0"))
    assert all(r["score"] < 1e-6 for r in none.score(docs).collect())
    assert toxicity.train(docs.limit(0), known).score(docs).count() == docs.count()


def test_label_model_finds_chances_and_correlations():
    """Votes drawn from known chances, two voters of one mind: the fit sees no labels and finds both."""
    rng = np.random.default_rng(3)
    n, share = 60_000, 0.2
    y = rng.random(n) < share
    toxic, clean = np.array([0.5, 0.4, 0.3, 0.6, 0.05, 0.1]), np.array([0.02, 0.05, 0.01, 0.1, 0.2, 0.3])
    votes = np.where(y[:, None], rng.random((n, 6)) < toxic, rng.random((n, 6)) < clean)
    votes = np.column_stack([votes, votes[:, 0] & (rng.random(n) < 0.9)])
    sign = np.array([1, 1, 1, 1, -1, -1, 1])
    both = (votes[:, :, None] & votes[:, None, :]).sum(0).astype(float)
    clique = toxicity.cliques(both, n, share, sign)
    assert clique[0] == clique[6] and len(set(clique)) == 6
    heard = toxicity._by_clique(votes, clique)
    meant = np.array([sign[clique == c][0] for c in range(6)])
    a, c = toxicity.chances((heard[:, :, None] & heard[:, None, :]).sum(0).astype(float), n, share, meant)
    for v in range(6):
        assert a[clique[v]] == pytest.approx(toxic[v], abs=0.04) and c[clique[v]] == pytest.approx(clean[v], abs=0.02)


def test_posterior_by_the_definition():
    model = toxicity.LabelModel(np.array([0, 1, 1, -1]), 0.25, np.array([0.6, 0.3]), np.array([0.1, 0.4]), 0.07)
    for votes in itertools.product([0, 1], repeat=4):
        heard = [votes[0], max(votes[1], votes[2])]
        joint = lambda prior, chance: prior * math.prod(p for p, h in zip(chance, heard, strict=True) if h)
        a, b = joint(0.25, model.toxic), joint(0.75, model.clean)
        assert model.posterior(np.array([votes]))[0] == pytest.approx(a / (a + b) if any(heard) else 0.07)


def test_voters_and_their_votes():
    mined = toxicity._hashes(["zot", "idiot"])
    voters = toxicity.choose_voters(mined, np.array([1, -1]))
    texts = ["You are such an IDIOT!", "zot, thanks", None, "", "WHAT A LOUD LONG LINE THIS IS", "wow!! so", "you", "idiot", "grüß ! !"]
    got = [{voters.names[j] for j in np.flatnonzero(row)} for row in voters.votes(pa.array(texts))]
    name = {h: f"mined_{h:016x}" for h in mined.tolist()}
    listed = {f"insults_{lang}" for lang, words in toxicity.INSULTS.items() if "idiot" in words}
    assert got == [listed | {name[int(mined[1])], "you_insult"}, {name[int(mined[0])], "polite_en"}, set(), set(), {"shouting"}, {"exclaiming"}, set(), listed | {name[int(mined[1])]}, set()]


def test_url_parts_and_rules(spark):
    urls = {
        1: "http://Spam.Example.ORG/es/1", 2: "https://example.org/en/17?x", 3: "no scheme", 4: None, 5: "http://a.com/fr/x#y", 6: "http://b.com/de/1",
        7: "ftp://notexample.org/es/", 8: "http://example.org", 9: "http://x.net/a/b?http://c.com/de/", 10: "http://example.com?q=/de/",
    }
    pages = spark.createDataFrame([(k, u, "c") for k, u in urls.items()] + [(1, urls[1], "c"), (None, urls[6], None)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, spark.createDataFrame([], "key long, bad boolean")).collect()}
    expected = {
        1: ("spam.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/17", "example.org/en/1", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("a.com", "/fr/x", "com/fr/", "allow"), 6: ("b.com", "/de/1", "com/de/", "block"), 7: ("notexample.org", "/es/", "org/", "allow"), 8: ("example.org", "", None, "allow"),
        9: ("x.net", "/a/b", None, "allow"), 10: ("example.com", "", None, "allow"), None: ("b.com", "/de/1", "com/de/", "block"),
    }
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == expected


def test_mined_url_rules(spark):
    rng = random.Random(8)
    urls, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        host = rng.choice(["bets", "pills"]) if bad and rng.random() < 0.9 else rng.choice(["news", "blog", "shop"])
        urls.append((i, f"http://{host}.site{rng.randrange(5)}.net/{rng.choice(['a', 'b'])}/{rng.randrange(999)}"))
        labels.append((i, bad))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    known = spark.createDataFrame(labels[:300] + [(None, True), (5, None)], "key long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, known, min_support=0.02).collect()}
    assert all(got[i] == ("block" if re.search("bets|pills", u) else "allow") for i, u in urls)


def test_rules_over_common_tokens_of_long_urls(spark):
    """URLs of more than twenty tokens that don't fall together; bad exactly where two common ones meet."""
    rng = random.Random(12)
    urls = [f"http://s{i % 9}.net/" + "/".join(rng.sample(["aa", "bb"], rng.randrange(3)) + rng.sample([f"w{j}" for j in range(300)], 21)) for i in range(1200)]
    bad = {i: "/aa" in u and "/bb" in u for i, u in enumerate(urls)}
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(list(bad.items()), "key long, bad boolean"), host_rules=(), min_support=0.02, min_confidence=0.9).collect()
    held = {r["page_id"]: r for r in got if r["verdict"] == "block"}
    assert {i for i, b in bad.items() if b} == set(held) and all(r["mined_rule"] == "word:aa word:bb" for r in held.values())


def plain_tokens(url):
    host = re.match(r"(?s)^.*?://([^/?#]*)", url)[1].lower()
    rest = re.match(r"(?s)^.*?://[^/?#]*(.*)$", url.lower())[1]
    return {"scheme:" + url.lower().split("://")[0], *(f"host:{x}" for x in host.split(".")), *(f"digits:{len(w)}" if w.isdigit() else f"word:{w}" for w in re.findall("[a-z0-9_-]+", rest))}


def test_mined_rules_block_what_all_frequent_sets_block(spark):
    """Verdicts equal those of every token set of up to four tokens, with ties, shared and null ids, and a URL of 30 tokens."""
    rng = random.Random(31)
    long = "http://long.net/" + "/".join(f"t{i}" for i in range(30))
    urls = [(i, f"http://{rng.choice('abc')}.net/{rng.choice('de')}/{rng.choice('fg')}/{rng.choice('hi')}") for i in range(400)]
    bad = {i: ("/d/" in u and "/f/" in u) if rng.random() < 0.9 else rng.random() < 0.5 for i, u in urls}
    urls += [(i, long) for i in range(400, 440)]
    bad |= {i: i % 2 == 0 for i in range(400, 440)}
    urls += [(500, "http://z.net/good"), (500, urls[1][1]), (None, urls[2][1]), (None, "http://z.net/good"), (501, long)]
    labels = [*bad.items(), (None, True), (0, bad[0])]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(labels, "key long, bad boolean"), host_rules=(), min_support=0.03, min_confidence=0.55).collect()
    baskets = [(plain_tokens(u), bad[i]) for i, u in urls if i in bad]
    least = max(0.03 * len(baskets), url_rules.MIN_COUNT)
    count, hits = collections.Counter(), collections.Counter()
    for tokens, b in baskets:
        for size in range(1, 5):
            for subset in itertools.combinations(sorted(tokens) if len(tokens) < 20 else [], size):
                count[subset] += 1
                hits[subset] += b
    rules = [set(x) for x in count if hits[x] >= least and hits[x] >= 0.55 * count[x]]
    assert any(len(r) > 1 for r in rules)
    for r in got:
        if "long" not in r["url"]:
            assert (r["verdict"] == "block") == any(rule <= plain_tokens(r["url"]) for rule in rules), r
        else:
            assert r["verdict"] == "allow"
    assert len(got) == len(urls)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
