import random
from itertools import permutations

import numpy as np

from phonolake.llm import filter_audit

SPACES = " \t\n\x0b\x0c\r"


def fails(rows):
    """Letters that each row fails, read off the definitions."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = "".join(" " if c in SPACES else c for c in text).split(" ")
        words = [w for w in words if w]
        lost = "A" if len(words) < 100 else ""
        lost += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        lost += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
        lost += "D" if any(c in "#$%&*|" for c in text) else ""
        own = -(2**63) if doc_id is None else doc_id
        lost += "E" if any((t or "") == text and (-(2**63) if i is None else i) < own for i, t, _ in rows) else ""
        out.append(lost)
    return out


def brute(rows, labels):
    """Every order applied to every document, one after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    lost = fails(rows)
    table = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, lost, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone, rest = [d for d in left if c in d[1]], [d for d in left if c not in d[1]]
                redundant = sum(c in f for _, f in mine) - len(gone)
                unique = sum(f == c for _, f in mine)
                table[part, "".join(order), step] = [len(rest), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                total[c] += len(gone)
                left = rest
        for (p, order, step), row in table.items():
            if p == part:
                row.append(total[order[step - 1]])
    return table


def collected(df):
    return {tuple(r)[:3]: list(r)[3:] for r in df.collect()}


def test_positional_counts():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 8, 100, 4097):
        words = draw.integers(0, 2**32, n, dtype=np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int((words >> k & 1).sum()) for k in range(32)]


def test_survival_words():
    words = filter_audit.survival_words()
    assert int(words[0]) == 2**32 - 1 and all(int(words[f]) >> s & 1 == (f & s == 0) for f in range(32) for s in range(32))


def test_odd_rows_equal_brute_force(spark):
    draw = random.Random(2)
    def text():
        words = [draw.choice(["ab", "cd", "EF", "Gh", "i#", "é ", "x\x1cy", f"w{draw.randint(0, 400)}"]) for _ in range(draw.choice([0, 5, 99, 100, 120]))]
        return draw.choice([" ", "\n", "\x0b", "  "]).join(words)
    rows = [(i, text(), draw.choice(["en", "fr", "", None])) for i in range(120)]
    rows += [(200 + i, rows[draw.randint(0, 40)][1], "en") for i in range(60)]
    rows += [(None, None, "en"), (None, rows[3][1], "fr"), (201, rows[5][1], "en"), (201, rows[5][1], "en"), (300, "", "de"), (301, "W " * 30000, "de")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 1, 1) for i, t, p in rows], "doc_id long, text string, lang string, part int, failed int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audit(docs.repartition(3), marks)) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    got = collected(filter_audit.audit(docs, marks))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_many_parts_leave_a_task_in_time(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id AS doc_id", "'x' AS text", "cast(id % 50 AS string) AS lang")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 7)
    assert filter_audit.audit(docs, marks).where("filter_order = 'ABCDE' AND step = 1").selectExpr("sum(removed) AS n").first().n == 200
