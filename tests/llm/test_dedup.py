import random

import pytest
import xxhash

from cairnmap.llm import line_dedup, near_dup


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, work, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            docs.append((len(docs), " ".join(copy)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), work(), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_chain_of_copies_is_one_group(spark, work):
    words = [f"a{i}" for i in range(60)]
    docs = [(i, " ".join(words[:40] if not i else words[i : i + 40])) for i in range(20)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), work(), k=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 2)


def test_near_duplicates_odd_rows(spark, work, odd):
    got = near_dup.near_duplicates(odd, work(), k=2).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[2] == [(9, 1, False)] * 2 and by[1] == [(9, 1, True)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert all(c is None and kept for _, c, kept in by[None])
    assert near_dup.near_duplicates(odd.limit(0), work(), k=2).count() == 0


CUT = line_dedup.CUT


def lines_of(text):
    import regex

    at = [m.end() for m in regex.finditer(r"\n|[.!?] ", text) if m.group() == "\n" or regex.search(r"[^.!?\n]{20}[.!?] $", text[: m.end()])]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)]) if a < b or (a == 0 == len(text))] or [""]


def brute_lines(docs, min_words, window):
    """The same rule in Python: fingerprints, first positions, runs on their shifts."""
    h = lambda s: xxhash.xxh64_intdigest(s.rstrip(" \t\r\n").encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(s.rstrip(" \t\r\n").encode(), seed=42) >> 63)
    parts = {i: lines_of(t) for i, t in docs}
    hs = {i: [h(x) for x in p] for i, p in parts.items()}
    ws = {i: [len(x) - len(x.replace(" ", "")) + 1 for x in p] for i, p in parts.items()}
    first, marks = {}, {}
    for i in sorted(hs):
        n = len(hs[i])
        picked = {min(range(s, min(n, s + window)), key=lambda j: (hs[i][j], j)) for s in range(max(1, n - window + 1))}
        picked |= {j for j in range(n) if ws[i][j] >= min_words}
        marks[i] = [j for j in sorted(picked) if j == 0 or hs[i][j] != hs[i][j - 1]]
        for j in marks[i]:
            first.setdefault(hs[i][j], (i, j))
    out = {}
    for i in hs:
        shifts = {(first[hs[i][j]][0], first[hs[i][j]][1] - j) for j in marks[i] if first[hs[i][j]] != (i, j)}
        if any(a == b for a, b in zip(hs[i], hs[i][1:])):
            shifts.add((i, -1))
        gone = set()
        for o, g in shifts:
            run = []
            for j in range(max(0, -g), min(len(hs[i]), len(hs[o]) - g) + 1):
                if j < min(len(hs[i]), len(hs[o]) - g) and hs[i][j] == hs[o][j + g]:
                    run.append(j)
                else:
                    if sum(ws[i][r] for r in run) >= min_words:
                        gone |= set(run)
                    run = []
        out[i] = "".join(x for j, x in enumerate(parts[i]) if j not in gone)
    return out


def test_line_dedup_equals_brute_force(spark, work):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(1, 14))) + rng.choice([". ", "!\n", ".\n", "\n"])
    common = [["".join(sentence() for _ in range(rng.randint(1, 8)))][0] for _ in range(6)]
    docs = [(i, "".join(rng.choice(common) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(1, 15)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeats(spark.createDataFrame(docs, "doc_id long, text string"), work(), min_words=10).collect()}
    assert got == brute_lines(docs, 10, line_dedup.WINDOW)
    assert any(got[i] != t for i, t in docs) and any(got[i] == t for i, t in docs)


def any_earlier(docs, min_words):
    """Runs of lines of min_words words or more that occur at any earlier place, by a set of all of them."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        parts = lines_of(text + "x")  # what follows the last line end is a line too, if an empty one
        parts[-1] = parts[-1][:-1]
        bare, gone = [x.rstrip(" \t\r\n") for x in parts], set()
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if sum(len(x) - len(x.replace(" ", "")) + 1 for x in parts[a:b]) >= min_words:
                    gone |= set(range(a, b)) if tuple(bare[a:b]) in seen else set()
                    seen.add(tuple(bare[a:b]))
        out[i] = "".join(x for j, x in enumerate(parts) if j not in gone)
    return out


def test_runs_go_whatever_stands_around_the_first_place_of_their_lines(spark, work):
    rng = random.Random(4)
    lines = [f"Line {c} has {'some ' * (i % 7)}words.\n" for i, c in enumerate("abcdefghijkl")] + ["\n", "\n", "A line that holds ten words or more all by itself here.\n"]
    docs = [(i, "".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    # Each line stands alone first; blank lines part the paragraphs; the passage comes whole in 101 and again in 102.
    passage = "\n\n".join(f"Paragraph {c} of five words" for c in "pqrstuvw")
    docs += [(70 + i, f"Other {i} start.\nParagraph {c} of five words\n\nOther end {i}.") for i, c in enumerate("pqrstuvw")]
    docs += [(i, f"Own {i}.\n{passage}\nEnd {i}.") for i in (101, 102)]
    want = any_earlier(docs, 10)
    assert want != brute_lines(docs, 10, line_dedup.WINDOW) and want[102] == "Own 102.\nEnd 102."
    got = {r.doc_id: r.text for r in line_dedup.delete_repeats(spark.createDataFrame(docs, "doc_id long, text string"), work(), min_words=10).collect()}
    assert got == want


def test_planted_passage_goes_once_seen(spark, work):
    passage = "".join(f"Sentence {c} of the shared passage has these {c} words in it. " for c in "abcdefgh")
    docs = [(i, f"Own start of document {i} here with some words of its own {i}.\n{passage}\nOwn end number {i}, nobody else has it.") for i in range(5)] + [(9, "A clean document. It has nothing in common.")]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeats(spark.createDataFrame(docs, "doc_id long, text string"), work()).collect()}
    assert got[0] == docs[0][1] and got[9] == docs[5][1]
    assert all("shared passage" not in got[i] and f"document {i} here" in got[i] and f"end number {i}," in got[i] for i in range(1, 5))


def test_line_dedup_odd_rows(spark, work, odd):
    got = line_dedup.delete_repeats(odd, work(), min_words=5).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] != [""] and texts[2] == ["", ""] and texts[3] == [None] and texts[4] == [""] and texts[6] == ["short"]
    assert line_dedup.delete_repeats(odd.limit(0), work()).count() == 0


def test_line_dedup_names_and_rows_without_id(spark, work):
    line = "A line of exactly eight words stands here. "
    docs = [(None, f"Own {i}.\n{line * 2}\nEnd {i}.") for i in range(50)] + [(3, f"First.\n{line * 2}\nLast.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    names = ["_d", "_t", "_parts", "_cut", "_rl_d", "h", "p", "a.b", "n_lines"]
    got = line_dedup.delete_repeats(df.select("*", *(F.lit(7).alias(c) for c in names)), work(), min_words=10)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "lines_deleted"]
    rows = got.collect()
    assert all(r[c] == 7 for r in rows for c in names[:-1]) and len(rows) == 51
    # The row with an id comes first in the order; of those without, every one is a document of its own.
    assert [r.text for r in rows if r.doc_id == 3] == [docs[-1][1]]
    assert sorted(r.text for r in rows if r.doc_id is None) == sorted(f"Own {i}.\nEnd {i}." for i in range(50))


def test_a_text_of_two_lines_in_turn_takes_time_by_its_length(spark, work):
    import time

    text = "This is one of the two lines in turn\nAnd this one is the other of them\n" * 50_000
    began = time.time()
    rows = line_dedup.delete_repeats(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string"), work()).collect()
    assert time.time() - began < 60
    assert {r.doc_id: r.n_lines - r.lines_deleted for r in rows} == {1: 3, 2: 1}
