import math
import random
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from cairnmap.llm import lm, quality, tokens, toxicity


def corpus(spark, n=400):
    rng = random.Random(0)
    base = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w, bad = [rng.choice(base) for _ in range(rng.randint(5, 80))], rng.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        low = rng.random() < 0.4
        docs.append((i, " ".join(x + "%%%" for x in w) if low else " ".join(w)))
        labels.append((i, int(not low), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = corpus(spark)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[i], t) for i, _, t in rows if crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(s >= 0.5) == bool(t) for s, t in held]) >= 0.9
    assert all(0 <= s <= 1 for s in got.values())


def test_ftrl_is_sparse():
    rows = [(i % 2, np.array([i % 2, 10 + i])) for i in range(200)]
    w = toxicity.ftrl(rows)
    assert w[1] > 0 > w[0] and not w[10:210].any()


def test_ftrl_equals_the_published_update():
    """Per-coordinate FTRL-proximal, one feature at a time, by the formulas of the paper."""
    rng = random.Random(3)
    rows = [(y, np.array(sorted(rng.sample(range(10 * y, 30 + 10 * y), 6)))) for y in (rng.random() < 0.3 for _ in range(150))]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.5, 0.3
    bias = 1 << toxicity.BITS
    z, n = Counter(), Counter()

    def weight(i):
        lam = 0 if i == bias else l1
        return 0.0 if abs(z[i]) <= lam else -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    more = math.sqrt((150 - sum(y for y, _ in rows)) / sum(y for y, _ in rows))
    for _ in range(2):
        for y, f in rows:
            f = [*f.tolist(), bias]
            w = {i: weight(i) for i in f}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (more if y else 1)
            for i in f:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = toxicity.ftrl(rows, alpha, beta, l1, l2, epochs=2)
    want = np.zeros(bias + 1)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-12) and 0 < np.count_nonzero(want) < len(z)


def test_toxicity_scores_equal_a_sum_over_features(spark):
    docs, labels, _ = corpus(spark, 120)
    at, w = toxicity.fit(docs, labels)
    weights = dict(zip(at.tolist(), w.tolist()))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, (at, w)).collect()}
    for r in docs.collect():
        total = sum(weights.get(f, 0.0) for f in set(toxicity.features(pa.array([r.text]))[0].tolist())) + weights.get(1 << toxicity.BITS, 0.0)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)))


def test_feature_kinds():
    """Words, heads of longer words, pairs and pairs with a word skipped."""
    mixed = lambda value, kind: int(tokens.mix(np.array([value + kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0] >> np.uint64(64 - toxicity.BITS))
    texts = pa.array(["Alpha be gammarays be"])
    h, _, heads = tokens.word_hashes(texts, toxicity.HEAD)
    h, want = h.tolist(), Counter()
    want.update(mixed(x, 1) for x in h)
    want.update(mixed(x, 2) for x in heads.tolist() if x)
    want.update(mixed((a * 3 + b) & (1 << 64) - 1, 3) for a, b in zip(h, h[1:]))
    want.update(mixed((a * 3 + b) & (1 << 64) - 1, 4) for a, b in zip(h, h[2:]))
    assert Counter(toxicity.features(texts)[0].tolist()) == want and sum(x != 0 for x in heads.tolist()) == 1


def test_repeated_rows_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = toxicity.sample_of(docs, labels, "toxic", 5, 0, 12_000).collect()
    assert len(got) == len({r.key for r in got}) == sum(crc32(str(i).encode()) % 5 != 0 for i in range(20))


def test_quality_scores_equal_a_walk_through_the_network(spark):
    docs, labels, _ = corpus(spark, 80)
    vectors, net = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, (vectors, net)).collect()}
    for r in docs.collect():
        rows, shapes, _ = quality.word_rows(pa.array([r.text]))
        x = np.concatenate([vectors[rows].astype(float).mean(0), vectors[shapes].astype(float).mean(0)]).astype(np.float32)
        h = np.maximum((x - net["mean"]) / net["dev"] @ net["w1"] + net["b1"], 0)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(h @ net["w2"] + net["b2"]) / net["t"])), rel=1e-6)


def test_features_do_not_cross_texts():
    a, _ = toxicity.features(pa.array(["one two three"]))
    both, owner = toxicity.features(pa.array(["one two three", "four"]))
    assert sorted(both[owner == 0]) == sorted(a) and (owner == 1).sum() == 1


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = corpus(spark)
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    held = [(got[i], q) for i, q, _ in rows if crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([(s >= 0.7) == bool(q) for s, q in held]) >= 0.95


def test_vectors_cover_all_documents(spark):
    docs, labels, _ = corpus(spark, 60)
    more = docs.unionByName(spark.createDataFrame([(1000, "seen unlabelled nowhere else unlabelled"), (1001, None), (1002, "unlabelled")], docs.schema)).repartition(3)
    vectors, _ = quality.fit(more, labels)
    # The definition, word by word: neighbours up to two words away, of all documents.
    index, want = quality.index_vectors().astype(float), np.zeros((quality.ROWS, quality.DIM))
    for r in more.collect():
        rows, shapes, _ = quality.word_rows(pa.array([r.text]))
        for i in range(len(rows)):
            for j in {i - 2, i - 1, i + 1, i + 2} & set(range(len(rows))):
                want[rows[i]] += index[rows[j]] + index[shapes[j]]
                want[shapes[i]] += index[rows[j]] + index[shapes[j]]
    assert np.allclose(vectors, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-6)
    assert vectors[quality.word_rows(pa.array(["nowhere"]))[0]].any()
    again, _ = quality.fit(more.repartition(7), labels)
    assert np.array_equal(again, vectors)


def test_network_learns_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(int)
    net = quality.train(x, y)
    p = 1 / (1 + np.exp(-quality.hidden(x, net) / net["t"]))
    assert ((p > 0.5) == y).mean() > 0.7 and abs(p.mean() - y.mean()) < 0.05


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_rows(spark, odd, module):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (6, 0, 0), (7, 1, 1), (None, 1, 1), (8, None, None), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = module.scored(odd, module.fit(odd, known)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.scored(odd.limit(0), module.fit(odd.limit(0), labels)).count() == 0


def test_platt_scaling_minimises_its_loss():
    """No a and b near those found have less of Platt's loss, by the formulas of the paper over a grid."""
    rng = random.Random(6)
    rows = [(int(y), np.array([i])) for i in range(300) for y in [rng.random() < 1 / (1 + math.exp(-(3 * math.sin(i) - 1)))]]
    w = np.zeros((1 << toxicity.BITS) + 1)
    w[:300] = 6 * np.sin(np.arange(300))
    w[-1] = 0.5
    found = toxicity.calibrated(w, rows)
    z, y = w[:300] + w[-1], np.array([r[0] for r in rows])
    ones, zeros = int(y.sum()), int(300 - y.sum())
    weight = {1: ones**-0.5 / (ones**0.5 + zeros**0.5), 0: zeros**-0.5 / (ones**0.5 + zeros**0.5)}

    def loss(a, b):
        total = 0.5e-3 * (a - 1) ** 2
        for zi, yi in zip(z, y):
            t, p = ((ones + 1) / (ones + 2) if yi else 1 / (zeros + 2)), 1 / (1 + math.exp(-(a * zi + b)))
            total -= weight[int(yi)] * (t * math.log(p) + (1 - t) * math.log(1 - p))
        return total

    a = found[1] / w[1]
    b = found[-1] - a * w[-1]
    best = loss(a, b)
    assert all(best <= loss(a + da, b + db) + 1e-12 for da in (-0.05, -0.005, 0, 0.005, 0.05) for db in (-0.2, -0.02, 0, 0.02, 0.2))
    assert np.array_equal(toxicity.calibrated(w, rows[:0]), w)


def test_network_equals_adam_by_the_paper():
    """Weights after some epochs, one number at a time."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(37, 3)), rng.integers(0, 2, 37)
    got = quality.train(x, y, units=2, epochs=3)
    rng = np.random.default_rng(11)
    mean, dev = x.mean(0), x.std(0) + 1e-6
    net = {("w1", i, j): v for (i, j), v in np.ndenumerate(rng.normal(0, (2 / 3) ** 0.5, (3, 2)))} | {("w2", j): v for (j,), v in np.ndenumerate(rng.normal(0, 1.0, 2))} | {("b1", 0): 0.0, ("b1", 1): 0.0, ("b2",): 0.0}
    rows = [i for i in range(37) if i % 5 != 4]
    m, v, step = Counter(), Counter(), 0

    def forward(r):
        u = [(x[r][i] - mean[i]) / dev[i] for i in range(3)]
        h = [max(0.0, sum(u[i] * net["w1", i, j] for i in range(3)) + net["b1", j]) for j in range(2)]
        return u, h, sum(h[j] * net["w2", j] for j in range(2)) + net["b2",]

    for _ in range(3):
        order = rng.permutation(len(rows))
        g = Counter({k: 1e-4 * net[k] for k in net if k[0] in ("w1", "w2")})
        for r in (rows[i] for i in order):
            u, h, z = forward(r)
            e = (1 / (1 + math.exp(-z)) - y[r]) / len(rows)
            g["b2",] += e
            for j in range(2):
                g["w2", j] += e * h[j]
                if h[j] > 0:
                    g["b1", j] += e * net["w2", j]
                    for i in range(3):
                        g["w1", i, j] += e * net["w2", j] * u[i]
        step += 1
        for k in net:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            net[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    for k, want in net.items():
        assert float(got[k[0]][k[1:]] if k[1:] else got[k[0]]) == pytest.approx(want, rel=1e-9, abs=1e-12)
    aside = [i for i in range(37) if i % 5 == 4]
    cost = lambda t: sum(math.log1p(math.exp((-1 if y[r] else 1) * forward(r)[2] / t)) for r in aside)
    assert all(cost(got["t"]) <= cost(t) + 1e-12 for t in np.geomspace(0.25, 8, 61))


def test_word_sums_of_many_tasks(spark):
    """The tree gives the sums of one task, whatever the number of partitions."""
    from cairnmap.llm.lm import unpack

    rng = random.Random(1)
    docs = spark.createDataFrame([(" ".join(rng.choice(["alpha", "beta", "Gamma", "x1"]) for _ in range(30)),) for _ in range(200)], "text string")
    sums = lambda df: {r.c: unpack(bytes(r.v), np.int64).tolist() for r in quality.word_sums(df).collect()}
    want = sums(docs.coalesce(1))
    assert want and sums(docs.repartition(5)) == want and sums(docs.repartition(70)) == want
    assert sums(docs.limit(0)) == {}


def brute_lm(docs, order, mu):
    seqs = [(i, (t or "").encode().lower().split() + ["</s>"]) for i, t in docs]
    train = [s for i, s in seqs if crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter()
    for s in train:
        padded = ["<s>"] * (order - 1) + s
        for j in range(order - 1, len(padded)):
            for m in range(order):
                c[tuple(padded[j - m : j + 1])] += 1
    n, v = sum(len(s) for s in train), len({w for s in train for w in s})
    states = Counter()
    for s in train:
        padded = ["<s>"] * (order - 1) + s
        for j in range(order - 1, len(padded)):
            for m in range(1, order):
                states[tuple(padded[j - m : j])] += 1

    def p(w, h):
        if not h:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (c[(*h, w)] + mu * p(w, h[1:])) / (states[h] + mu)

    out = []
    for i, s in seqs:
        padded = ["<s>"] * (order - 1) + s
        base = sum(math.log10(p(w, ())) for w in s)
        score = sum(math.log10(p(padded[j], tuple(padded[j - order + 1 : j]))) for j in range(order - 1, len(padded)))
        out.append((i, len(s), sum(c[(w,)] > 0 for w in s), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_equals_brute_force(spark, work, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "e"]) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(3, "a b"), (None, "b c"), (90, None), (91, "zzz unseen")]
    got = lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), work(), order=order, mu=5.0, block_bytes=100, part_bytes=200).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 7)) for x in r)
    want = sorted(brute_lm(docs, order, 5.0), key=key)
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert [h[4:] for h in have] == [pytest.approx(w[4:], rel=1e-9) for w in want]


@pytest.mark.parametrize("fan", [2, 5])
def test_lm_levels(spark, work, fan):
    """Teams of blocks, over several levels, answer what one level answers, and leave no tables of theirs."""
    rng = random.Random(fan)
    docs = [(i, " ".join(rng.choice(["the", "a", "b", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(500, None), (None, "the a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    used = work()
    got = lm.lm_scores(df, used, order=3, mu=5.0, block_bytes=150, part_bytes=300, fan=fan).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 7)) for x in r)
    want = sorted(brute_lm(docs, 3, 5.0), key=key)
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert [h[4:] for h in have] == [pytest.approx(w[4:], rel=1e-9) for w in want]
    assert {p.name for p in Path(used.path).iterdir()} == {"blocks", "answers"}
    blocks = spark.read.parquet(f"{used.path}/blocks").count()
    assert blocks > 16 and lm._levels(17, 2) == [17, 9, 5, 3, 2, 1] and lm._levels(1, 2) == [1]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton(order):
    rng = random.Random(order)
    texts = pa.array([" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(40)])
    keys, offs = lm.ngrams(texts, order)
    distinct, first, numbers = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    numbers = numbers.reshape(order, -1)
    learn = np.repeat(np.arange(40) < 25, np.diff(offs))
    counts = np.bincount(numbers[:, learn].ravel(), minlength=len(distinct)).astype(float)
    single = numbers[0][learn]
    machine = lm.Automaton(numbers, first, offs, counts, 25.0, len(single), len(set(single.tolist())), 7.0)
    # Of each seen state: the weights of all words by arc or failure path, and of what no text has, sum to one.
    for s in [machine.lowest, *machine.to[counts > 0].tolist()]:
        total = 0.0
        for w in {*numbers[0].tolist()}:
            at, weight = s, 0.0
            while not len(hit := np.flatnonzero(machine.keys == at * len(counts) + w)):
                at, weight = machine.up[at], weight + machine.fail[at]
            total += 10 ** (weight + machine.weight[machine.arcs[hit[0]]])
        unseen, at = 0.0, s
        while at != machine.lowest:
            at, unseen = machine.up[at], unseen + machine.fail[at]
        v = len(set(single.tolist()))
        assert total + 10**unseen * 0.1 / (len(single) + 0.1 * (v + 1)) == pytest.approx(1)
    # Lanes do not show.
    whole = machine.traverse(numbers[0], offs, 1000)
    assert machine.traverse(numbers[0], offs, 7) == pytest.approx(whole) and np.array_equal(machine.traverse(numbers[0], offs), whole)


def test_lm_odd_rows(spark, work, odd):
    assert lm.lm_scores(odd, work()).count() == odd.count()
    assert lm.lm_scores(odd.limit(0), work()).count() == 0


def test_packing():
    for dtype in (np.uint32, np.uint64):
        x = np.sort(np.random.default_rng(0).integers(0, 1 << 31, 1000).astype(dtype))
        assert np.array_equal(lm.unpack(lm.pack(x), dtype), x) and np.array_equal(lm.unpack(lm.pack(x, True), dtype, True), x)
