import random
import re

from phonolake.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))


def brute(text, threshold=0.8):
    words = WORD.findall(lowered(text))
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, most = set(), 0.0
    for label, own in licenses.template_sets(licenses.TEMPLATES):
        cut = re.split(r"\n\s*\n", lowered(text)) if len(own) >= licenses.LONG else lowered(text).split("\n")
        for block in cut:
            shared = len(set(own) & set(WORD.findall(block)))
            if shared >= licenses.needed(own, threshold):
                labels.add(label)
                most = max(most, shared / len(own))
    base = {x for _, x in places}
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else most)


def odd_texts():
    draw = random.Random(4)
    whole = [t for _, t in licenses.TEMPLATES]
    fixed = [None, "", "the MIT\tlicense the mit-license THE MIT LICENSE\nLicense", "éthe mit license", "the mit licenseé", "the mit license2", "K the mıt license", "cc by nc cc by nc", "Apache License, Version 2.0 the mit license", "x " * 60_000 + "CC BY-NC", "12 34\x00the.mit.license", "The MIT License " * 500]
    for t in whole:
        words = t.split()
        for _ in range(6):
            cut = [w for w in words if draw.random() > draw.choice((0.05, 0.15, 0.25, 0.4))]
            draw.shuffle(cut)
            fixed.append("intro line\n\n" + draw.choice((" ", "\n")).join(cut) + "\n \nlast the mit license" * draw.randrange(2))
    return fixed


def test_rows_equal_brute_force(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(odd_texts())] + [(None, "cc by nc", 1), (1, "", 1), (1, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    got = sorted(map(str, (tuple(r) for r in licenses.license_scan(docs).collect())))
    assert got == sorted(str((i, *brute(t))) for i, t, _ in rows)


def test_empty_tables_and_no_python(spark, capsys):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert licenses.license_scan(docs.limit(0)).count() == 0
    assert [r.labels for r in licenses.license_scan(docs, templates=[]).collect()] == [""]
    licenses.license_scan(docs).explain()
    plan = capsys.readouterr().out
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan
