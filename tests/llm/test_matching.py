import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from cairnmap.llm import decontaminate, licenses, tokens


def brute(item, text):
    """Least edit distance between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert decontaminate.edit_distance(np.array(a, int), np.array(b, int))[0] == brute(a, b)


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            i, item = rng.choice(items)
            item = item.split()
            for _ in range(rng.randint(0, len(item) // 12)):
                at = rng.randrange(len(item))
                how = rng.randrange(3)
                item[at : at + 1] = [rng.choice(words)] if how == 0 else [] if how == 1 else [item[at], rng.choice(words)]
            at = rng.randint(0, len(text))
            text[at:at] = item
            planted.add((d, i))
        docs.append((d, " ".join(text).title()))
    want = {(d, i): n for d, t in docs for i, s in items if (n := brute(s.split(), t.lower().split())) <= decontaminate.allowed(len(s.split()))}
    assert planted <= set(want)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert set(found) <= set(want) and len(set(want) - set(found)) <= 0.01 * len(want)
    assert all(want[k] <= n for k, n in found.items())
    for r in got:
        if r.distance == 0:
            assert " ".join(dict(docs)[r.doc_id].lower().split()[r.first_word : r.end_word]) == dict(items)[r.item_id]
    blocks = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), item_bytes=2000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("where", ["front", "back", "anywhere", "moved"])
@pytest.mark.parametrize("n", [15, 36, 60, 61, 120, 240, 500])
def test_items_with_all_allowed_edits_are_found(n, where):
    rng = random.Random(n)
    new = lambda k: [rng.getrandbits(63) for _ in range(k)]
    items, texts = [], []
    for i in range(200 if n < 200 else 100):
        item = new(n)
        items.append((i, np.array(item, np.uint64)))
        spots = {"front": range(n // 2), "back": range(n - n // 2, n)}.get(where, range(n))
        for at in sorted(rng.sample(spots, decontaminate.allowed(n)), reverse=True):
            item[at : at + 1] = new(1) if where != "moved" else rng.choice([[], [item[at], *new(1)]])
        texts.append(new(70) + item + new(70))
    found = decontaminate.Matcher(items).find(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))
    assert sum(doc == key for doc, key, *_ in found) >= 0.99 * len(items)


def test_a_long_text_full_of_an_item():
    rng = random.Random(4)
    item = [rng.getrandbits(63) for _ in range(150)]
    text = item * 200 + [rng.getrandbits(63) for _ in range(1000)]
    found = decontaminate.Matcher([(7, np.array(item, np.uint64))]).find(np.array(text, np.uint64), np.array([0, len(text)]))
    assert found == [(0, 7, 0, 0, 150)]


def test_what_is_found_in_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(9)
    items = [(i, np.array([rng.getrandbits(63) for _ in range(rng.randint(8, 30))], np.uint64)) for i in range(30)]
    pick = lambda: rng.choice(items)[1].tolist()
    # Items cut short at the start or the end of a text, next to texts that go on with them.
    texts = [rng.choice([pick()[: rng.randint(5, 30)], pick()[rng.randint(0, 6) :], [1, 2, 3] + pick()[:-2], pick() + pick()]) for _ in range(300)]
    matcher = decontaminate.Matcher(items)
    together = matcher.find(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))
    alone = [(i, *f[1:]) for i, t in enumerate(texts) for f in matcher.find(np.array(t, np.uint64), np.array([0, len(t)]))]
    assert together == alone and len(alone) > 20


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "three four five"), (2, None), (3, ""), (None, "no id here but some"), (4, "one"), (1, "three four five")], "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.item_id or -1) for r in decontaminate.contaminated(odd, items).collect()))
    assert got == [(-1, -1), (1, 1), (1, 1), (1, 4), (2, 1), (2, 1), (2, 1), (2, 1), (2, 4), (2, 4)]
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def bare(text):
    """Lower-case words from their first letter or digit on; words without one are none."""
    return [w for w in (re.sub(r"^[^a-z0-9\x80-\U0010ffff]+", "", w) for w in (text or "").lower().split()) if w]


def brute_licenses(text, templates, percent=80):
    """Templates of which some L shingles in a row hold enough; the fullest containment."""
    w = bare(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in templates.items():
        v = bare(t)
        s = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
        length = 1 << max(0, (len(s) - 1).bit_length())
        most = max((len(s & set(runs[a : a + length])) for a in range(len(runs))), default=0)
        if most and 100 * most >= percent * len(s):
            out[name] = most / len(s)
    return out


def test_licenses_equal_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for d in range(200):
        text = [f"x{rng.randrange(500)}" for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(list(licenses.TEMPLATES.values())).split()
            if rng.random() < 0.4 and len(t) > 30:
                t[rng.randrange(len(t))] = "changed"
            elif rng.random() < 0.3:
                t = t[: len(t) // 2]
            at = rng.randint(0, len(text))
            text[at:at] = t
        docs.append((d, " ".join(text)))
        if d % 7 == 0:  # many copies of a text whose template is broken up: one answer for all, wherever they lie
            t = licenses.TEMPLATES["GPL-3.0-header"].split()
            docs[-1] = (d, " ".join([*t[:20], *(f"y{i}" for i in range(50)), *t[20:]]))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 3, 40):
        got = {}
        for r in licenses.license_scan(table.repartition(parts)).collect():
            got.setdefault(r.doc_id, {})[r.license] = r.containment
            held = dict(docs)[r.doc_id].lower().split()[r.first_word : r.end_word]
            assert brute_licenses(" ".join(held), {r.license: licenses.TEMPLATES[r.license]})[r.license] == pytest.approx(r.containment)
        assert sum(map(len, got.values())) > 50
        for d, t in docs:
            assert got.get(d, {}) == pytest.approx(brute_licenses(t, licenses.TEMPLATES))


def test_license_wordings_apart():
    """Versions of a header that differ in several words are told apart; whoever differs in one word has less containment."""
    names, found = sorted(licenses.TEMPLATES), {}
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in names:
        hits = scanner.find(*tokens.bare_hashes(pa.array([f"before it {licenses.TEMPLATES[name]} and after"]))[:2])
        found[name] = {names[h[1]]: h[4] for h in hits}
        assert found[name][name] >= 0.8
        assert found[name][name] == max(found[name].values())
    assert "GPL-3.0-header" not in found["GPL-2.0-header"] and "GPL-2.0-header" not in found["GPL-3.0-header"]
    assert "CC-BY-4.0" not in found["CC-BY-SA-4.0"] and "LGPL-2.1-header" not in found["GPL-2.0-header"]
    assert found["AGPL-3.0-header"]["GPL-3.0-header"] < found["AGPL-3.0-header"]["AGPL-3.0-header"] == 1.0


@pytest.mark.parametrize("before,first,last", [("# ", "", ""), ("// ", "", ""), (" * ", "/*", " */"), ("-- ", "", ""), ("#", "", ""), ("//", "", ""), ("REM ", "", ""), (";;; ", "", ""), ("> ", "", "")])
def test_licenses_behind_comment_markers(spark, before, first, last):
    """All templates, wrapped as code carries them; a marker of letters is a word like any other and may break short ones."""
    rows = []
    for name in sorted(licenses.TEMPLATES):
        lines = textwrap.wrap(licenses.TEMPLATES[name], 70)
        rows.append((name, "\n".join(["import os", first, *(before + x for x in lines), last, "x = 1"])))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(rows[r.doc_id][0], r.license): r for r in licenses.license_scan(docs).collect()}
    for i, (name, text) in enumerate(rows):
        if before != "REM " or len(licenses.TEMPLATES[name]) < 70:
            assert got[name, name].containment == 1.0, name
            words = text.split()[got[name, name].first_word : got[name, name].end_word]
            assert bare(" ".join(words))[:3] == bare(licenses.TEMPLATES[name])[:3]


def test_license_odd_rows(spark, odd):
    assert licenses.license_scan(odd).count() == 0
    assert licenses.license_scan(odd, {"t": "four five six seven eight nine"}).count() == 3
    assert licenses.license_scan(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(odd, {"t": "too few"})


def test_bands_reach_the_target():
    assert licenses.bands_for(5, 16, 80) >= 40
    h, w, _ = tokens.bare_hashes(pa.array([" ".join(f"n{i}" for i in range(60))] * 3))
    scanner = licenses.Scanner({"t": " ".join(f"n{i}" for i in range(20, 30))})
    assert [f[:2] for f in scanner.find(h, w)] == [(0, 0), (1, 0), (2, 0)]
