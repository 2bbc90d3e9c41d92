import random

import pytest

from sessionlake.llm import licenses

DOCS = "doc_id bigint, text string"


def brute(text, templates, threshold=0.8):
    """Names of templates that some window, at each start, holds enough of."""
    plain = lambda t: [w for w in map(licenses.normal, (t or "").encode().split()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    own, out = grams(plain(text)), set()
    for name, t in templates.items():
        want = set(grams(plain(t)))
        window = licenses.window_of(len(grams(plain(t))))[0]
        if any(len(want & set(own[i : i + window])) / len(want) >= threshold for i in range(len(own))):
            out.add(name)
    return sorted(out)


def corpus(seed=1, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + "the software is provided under a license".split()
    names, rows = sorted(licenses.TEMPLATES), []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            notice = licenses.TEMPLATES[rng.choice(names)].split()
            kind = rng.randrange(4)
            if kind == 1:
                notice = [w.upper() + "," for w in notice]
            elif kind == 2 and len(notice) > 20:
                notice[rng.randrange(len(notice))] = "changed"
            elif kind == 3:
                notice = notice[: len(notice) // 2]
            at = rng.randint(0, len(text))
            text[at:at] = notice
        rows.append((i, " ".join(text)))
    return rows


def test_against_every_window(spark):
    rows = corpus()
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    want = {i: brute(t, licenses.TEMPLATES) for i, t in rows}
    assert all(set(got[i]) <= set(want[i]) for i in want) and sum(map(len, want.values())) > 120
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_whole_notices_at_any_place():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for lead in range(0, 60, 7):
            found = scanner.scan(" ".join([f"x{i}" for i in range(lead)] + [text] + ["y"] * 40))
            assert (name, lead, len(text.split()), 1.0) in [(a, b, n, s) for a, b, n, s in found]


def test_each_place_is_a_match():
    text = licenses.TEMPLATES["mit"]
    found = licenses.Scanner(licenses.TEMPLATES).scan(f"a b c {text} d {text} e f g h i j {text}")
    assert [m[:2] for m in found] == [("mit", 3), ("mit", 9), ("mit", 20)]


def test_collisions_are_as_likely_as_promised():
    for size in (1, 3, 20, 90):
        window, stride = licenses.window_of(size)
        assert licenses.blocks_of(size) * stride >= window >= size + stride - 1
        held = -(-size * 8 // 10)
        j = held / (licenses.blocks_of(size) * stride + size - held)
        assert 1 - (1 - j**licenses.ROWS) ** licenses.bands_for(size) >= licenses.TARGET or j == 1


def test_edge_cases(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, None, 1, 2), (2, "", 1, 2), (3, " ,, .. ", 1, 2), (4, "RELEASED under\nthe -- MIT\t(License)!", 1, 2), (4, mit, 1, 2), (None, mit, 1, 2), (5, "w " * 200_000 + mit, 1, 2), (6, "Released under the MIT", 1, 2)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS + ", licenses int, TEXT int")).collect()
    assert sorted((str(r.doc_id), r.licenses) for r in got) == [("1", []), ("2", []), ("3", []), ("4", ["mit"]), ("4", ["mit"]), ("5", ["mit"]), ("6", []), ("None", ["mit"])]
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner({"short": "too few words"})


def test_templates_from_a_table(spark):
    rows = [("a", "one two three four five six"), ("a", "a shorter text of six words"), ("b", None), (None, "x"), ("c", " ".join(f"c{i}" for i in range(900)))]
    table = spark.createDataFrame(rows, "license string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, " ".join(["lead"] * 77 + [f"c{i}" for i in range(900)])), (3, None)], DOCS)
    got = {r.doc_id: (r.licenses, [tuple(m) for m in r.matches]) for r in licenses.scan(docs, table).collect()}
    assert got == {1: (["a"], [("a", 1, 6, 1.0)]), 2: (["c"], [("c", 77, 900, 1.0)]), 3: ([], [])}
    limit = licenses.MAX_TEMPLATE_BYTES
    licenses.MAX_TEMPLATE_BYTES = 100
    try:
        with pytest.raises(ValueError):
            licenses.scan(docs, table)
    finally:
        licenses.MAX_TEMPLATE_BYTES = limit


def test_slices_change_nothing(spark, monkeypatch):
    rows = corpus(seed=3, n=60)
    want = sorted(map(str, licenses.scan(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()))
    one = [licenses.Scanner(licenses.TEMPLATES).scan(t) for _, t in rows]
    assert one == licenses.Scanner(licenses.TEMPLATES).scan_all([t for _, t in rows])
    monkeypatch.setattr(licenses, "SLICE_WORDS", 90)
    assert sorted(map(str, licenses.scan(spark.createDataFrame(rows, DOCS).coalesce(1)).collect())) == want
