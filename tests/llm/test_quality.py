import re

from sessionlake.llm import quality

SCHEMA = "doc_id bigint, text string, source string"


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", " lead and trail \n", "x\ny\nx\n \n\nx", "é漢 ## | <b>\x0b&\x0c$", "a b c d e f " * 40,
    "w " * 4, "p q r s t u v p q r s t z", "\xa0 \u2003 x y z", " ".join(f"w{i}" for i in range(30)) + " w3 w4 w5 w6 w7 w8",
]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in quality.measure(df).collect():
        assert tuple(r)[2:] == measured(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 30_011}" for i in range(120_000))
    r = quality.measure(spark.createDataFrame([(1, text, "s")], SCHEMA)).first()
    assert r.n_words == 120_000 == r.n_repeat_words


def good(i):
    return " ".join(f"w{i}x{k}" for k in range(20))


def test_host_verdicts(spark):
    bad = "### " * 9 + "a b"
    rows = [(i, good(i), "fine") for i in range(60)] + [(100 + i, bad if i % 8 else good(i), "poor") for i in range(80)] + [(200, good(200), None), (201, "short", None), (202, good(202), "poor")]
    rows += [(300 + i, good(i) if i % 9 else bad, f"h{i % 7}") for i in range(70)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].kept and got[100].host_rejected and not got[100].base_failed and not got[100].kept and got[104].base_failed and not got[202].kept
    assert got[200].kept and not got[201].kept and got[301].kept


def test_small_hosts_are_shrunk(spark):
    rows = [(i, good(i), f"h{i % 20}") for i in range(400)] + [(1000, "short", "tiny"), (1001, good(5), "tiny2"), (1002, "short", "tiny2")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[1000].kept and got[1001].kept  # one failure of two isn't a host's habit


def test_edge_cases(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, good(1), "s", 1, "x"), (1, good(1), "s", 1, "x"), (None, None, None, None, None)], SCHEMA + ", host int, SOURCE string")
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.judge(df).collect())
    assert got == [("1", 20, True), ("1", 20, True), ("None", 0, False)]
