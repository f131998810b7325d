import random

from phonolake.llm import line_dedup
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"

def solid_chunks(text):
    """Bodies of the chunks of two or more lines that are not blank."""
    lines = text.split("\n")
    solid = [i for i, line in enumerate(lines) if line.strip()]
    cut = line_dedup.line_chunks(line_dedup.line_hashes(lines, solid))
    assert [i for a, b in cut for i in range(a, b)] == list(range(len(solid)))
    return ["\n".join(lines[solid[a] : solid[b - 1] + 1]) for a, b in cut if b - a > 1]


def chunks_brute(rows):
    """Walk over the documents in order of their ids: the places of the chunks that were there before."""
    out, seen = {}, set()
    for key, text in sorted(set(rows)):
        for place, body in enumerate(solid_chunks(text)):
            if body in seen:
                out.setdefault(key, set()).add(place)
            seen.add(body)
    return out


def later_chunks(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.key_id: set(r.chunks) for r in line_dedup.repeated_chunks(line_dedup.keyed(docs)).collect()}


def test_chunks_equal_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = later_chunks(spark, rows)
    assert got == chunks_brute(rows) and got
    draw = random.Random(2)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "d", "", " "]) for _ in range(draw.randrange(30)))) for i in range(60)]
    assert later_chunks(spark, rows) == chunks_brute(rows)


def test_chunks_do_most_of_a_shifted_passage(spark):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(40))
    rows = [(1, f"{passage}\nend of one"), (2, f"other start\nanother\nthird\n{passage}\nend of two"), (3, passage), (3, passage)]
    got = later_chunks(spark, rows)
    assert got.keys() == {2, 3}
    for key, text in rows[1:]:
        assert sum(solid_chunks(text)[place].count("\n") + 1 for place in got[key]) >= 30
    done = {r.doc_id: r for r in line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done[1].text == rows[0][1] and done[2].text == "other start\nanother\nthird\nend of two" and done[3].text == ""
    # the seeds of the second step leave out what the chunks removed
    assert len(line_dedup.pair_seeds(rows[1][1], list(got[2]))[0]) < len(line_dedup.pair_seeds(rows[1][1])[0]) / 2


def test_long_texts(spark):
    long = "\n".join(f"row {i % 7} {i}" for i in range(30_000))
    rows = [(6, long), (7, long), (8, "one"), (9, f"one\n{long}\nmore")]
    done = {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done == {6: long, 7: "", 8: "one", 9: "one\nmore"}


def passages_brute(rows):
    """Walk over the documents in order of their ids; a line goes with a pair of successive lines that was there before."""
    out, seen = {}, {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for p, (a, b) in enumerate(zip(solid, solid[1:], strict=False)):
            body = tuple(lines[a : b + 1])
            if seen.setdefault(body, (key, p)) not in ((key, p), (key, p - 1)):
                gone |= set(range(a, b + 1))
        out[key] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_planted_passages_of_any_length_go(spark):
    draw, fresh = random.Random(4), iter(range(10**6))
    line = lambda: f"line {next(fresh)} of its own {draw.random()}"
    rows, left = [], {}
    for n in range(2, 11):
        for gap in ("\n", "\n\n", "\n \n\n"):
            for _ in range(5):
                passage = gap.join(line() for _ in range(n))
                before, after = "\n".join(line() for _ in range(draw.randrange(1, 8))), "\n".join(line() for _ in range(draw.randrange(1, 8)))
                rows += [(len(rows), f"{line()}\n{passage}\n{line()}"), (len(rows) + 1, f"{before}\n{passage}\n{after}")]
                left[rows[-1][0]] = f"{before}\n{after}"
    got = {r.doc_id: r for r in line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == dict(rows) | left
    assert {r.n_chunks_removed for i, r in got.items() if i in left} == {1}


def test_passages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.where("text is not null").collect()]
    got = {r.doc_id: r for r in LLM_QUERIES["op2_line_dedup"](spark, SF).collect()}
    done = {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(docs).where("text is not null").collect()}
    want = passages_brute(rows)
    assert done == want and {i: len(t) for i, t in want.items()} == {i: got[i].n_chars_kept for i in want}
    draw = random.Random(6)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "d", "", " "]) for _ in range(draw.randrange(12)))) for i in range(60)]
    rows += [(100, "z\nz\nz"), (101, "y\ny\ny\ny"), (102, "z\nz\nz"), (103, "z\nq")]
    done = {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done == passages_brute(rows)
    assert (done[100], done[101], done[102], done[103]) == ("z\nz\nz", "y\ny", "", "z\nq")


def test_passages_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "\n\n"), (None, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc"), (8, "one"), (9, "one")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, key_id string")
    got = line_dedup.remove_repeated_passages(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines_removed, r.key_id) for r in got if r.text is not None) == sorted(
        [("2", "", 0, "s"), ("3", "\n\n", 0, "s"), ("4", "\n\n", 0, "s"), ("None", "a\nb\nc", 0, "s"), ("5", "", 3, "s"), ("5", "", 3, "s"), ("8", "one", 0, "s"), ("9", "one", 0, "s")]
    )
    assert len(got) == len(rows) and line_dedup.remove_repeated_passages(docs.limit(0)).count() == 0
