import random

from pyspark.sql import functions as F

from otgraph.llm import line_dedup as L
from otgraph.llm.common import text_key

BASE = ["the quick brown fox jumps over the lazy dog number one", "completely different line of text with some words here",
        "short one", "tiny", "another rather long line that will be edited in a few places by the test", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]


def _edit(rng, s):
    i, k = rng.randrange(len(s)), rng.random()
    if k < .33:
        return s[:i] + s[i + 1:]
    return s[:i] + rng.choice("abz") + (s[i:] if k < .66 else s[i + 1:])


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _rows():
    rng = random.Random(3)
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(BASE)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                s = _edit(rng, s)
            lines.append(s)
        rows.append((d, "\n".join(lines)))
    long = "".join(rng.choice("abcdefgh ") for _ in range(700))
    for d in range(100, 140):                            # copies of a long line: equal, one edit, a word, two places
        s = long
        for _ in range(d % 4):
            s = _edit(rng, s) if d % 3 else s[:50 * (d % 7)] + "word" + s[50 * (d % 7):]
        rows.append((d, s + "\nMenu\n" + rng.choice(["x", "OK", "", " "])))
    return rows + [(None, "null id line that is long enough to count"), (70, None), (71, ""), (5, rows[5][1])]


def test_matches_brute_force(spark, clash):
    rows = _rows()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    tk = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", text_key(F.col("text"))).collect()}
    lines = []
    for d, t in set(rows):
        for i, line in enumerate((t or "").split("\n")):
            if len(line.strip(" \t\r")) >= L.MIN_CHARS:
                lines.append(((-1 if d is None else d, tk[d, t], i), line.strip(" \t\r"), (d, t)))
    lines.sort()
    first = {}
    for k, line, _ in lines:
        first.setdefault(line, k)
    drop = {}
    for k, line, row in lines:
        near = len(line) >= L.MIN_FUZZY and any(
            len(m) >= L.MIN_FUZZY and f < first[line] and m != line and _one_edit(line, m) for m, f in first.items())
        if first[line] < k or near:
            drop.setdefault(row, set()).add(k[2])
    want = sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop.get((d, t), ())))
                   for d, t in rows), key=str)
    got = L.dedup_lines(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert sum(r.n_removed for r in got) >= 40
    kept = L.remove_lines(df)
    assert kept.columns == df.columns
    emptied = sum(1 for d, t in rows if (d, t) in drop and not "".join(
        x for i, x in enumerate(t.split("\n")) if i not in drop[d, t]).strip())
    assert kept.count() == len(rows) - emptied


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert L.dedup_lines(df).count() == 0 and L.remove_lines(df).count() == 0


def test_deletion_keys_agree_with_string_hashing():
    a, at, own = L.deletion_keys("abca")
    assert len(a) == 4 and list(at) == [0, 1, 2, 3]
    for i in range(4):
        assert a[i] == L.deletion_keys("abca"[:i] + "abca"[i + 1:])[2]
    runs = L.deletion_keys("aab")
    assert list(runs[1]) == [0, 2] and runs[0][0] == runs[0][1]
