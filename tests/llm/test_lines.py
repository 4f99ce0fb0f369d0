import random
import re

from pagestrata.llm import line_dedup


def brute(rows, most):
    kept = {}
    for d, t in rows:
        lines = [(i, x, len(re.findall(line_dedup.WORD, x))) for i, x in enumerate(t.split("\n"))] if t is not None else []
        kept[d] = [x for x in lines if x[2]]
    every = []
    for d, lines in kept.items():
        spans = set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += lines[j][2]
                if n >= most:
                    spans.add((i, j))
                    break
            n = 0
            for j in range(i, -1, -1):
                n += lines[j][2]
                if n >= most:
                    spans.add((j, i))
                    break
        every += [(d, lines[a][0], lines[b][0], tuple(x[1] for x in lines[a : b + 1])) for a, b in spans]
    first, gone = {}, {d: set() for d, _ in rows}
    for d, a, b, c in sorted(every):
        f = first.setdefault(c, (d, a, b))
        if (d, a, b) != f and (d != f[0] or a > f[2]):
            gone[d] |= set(range(a, b + 1))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def maximal_runs(rows, most):
    """Line numbers to delete by the definition: a line of any run of lines with words, of at least ``most`` words, that stands earlier too."""
    kept = {d: [(i, x) for i, x in enumerate(t.split("\n")) if re.search(line_dedup.WORD, x)] for d, t in rows if t is not None}
    runs = [(d, a, b) for d, lines in kept.items() for a in range(len(lines)) for b in range(a, len(lines)) if sum(len(re.findall(line_dedup.WORD, x)) for _, x in lines[a : b + 1]) >= most]
    places, gone = {}, {d: set() for d, _ in rows}
    for d, a, b in sorted(runs):
        content = tuple(x for _, x in kept[d][a : b + 1])
        before = places.setdefault(content, [])
        if any(e != d or to < a for e, to in before):
            gone[d] |= set(range(kept[d][a][0], kept[d][b][0] + 1))
        before.append((d, b))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_against_maximal_runs(spark):
    rng = random.Random(7)
    pool = ["a b", "c", "d e f", "", "g  h", "x y z w q", "one two three four five six", "k"]
    shared = [[rng.choice(pool) for _ in range(6)] for _ in range(6)]
    rows = [(i, "\n".join(x for _ in range(rng.randint(0, 3)) for x in (rng.choice(shared) if rng.random() < 0.5 else [f"own {i} {rng.random()}", rng.choice(pool)]))) for i in range(60)]
    for most in (4, 9):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()
        assert {r["doc_id"]: r["text"] for r in got} == maximal_runs(rows, most)


def test_fewer_fingerprints_than_lines(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefgh", k=4)) + f" {i}" for _ in range(40))) for i in range(20)]
    lines = line_dedup._lines_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 20 * 40 / 8 < line_dedup.fingerprints(lines).count() < 20 * 40 / 2


def test_columns_named_like_its_own(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage, *range(9)) for i in range(2)] + [(None, "null id", *range(9))]
    names = ["key", "own", "row", "cuts", "_key", "_cuts", "_own", "h", "n_lines"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", *names[:-1], "n_lines", "removed_lines"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == passage and got[1]["text"] == "" and got[None]["text"] == "null id"
    assert all([r[c] for c in names[:-1]] == list(range(8)) for r in got.values())


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["a b", "c", "d e f", "", "g  h", "x y z w q", "one two three four five six"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(99, None), (98, ""), (97, "\n\n")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows, 5)


def test_passage_goes_and_clean_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"alpha beta\n{passage}\ngamma"), (2, f"delta\n{passage}"), (3, "only own words here"), (4, passage)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "delta", 3: rows[2][1], 4: ""}


def test_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs, 3)
    assert set(out.columns) == set(odd_docs.columns) | {"removed_lines"}
    got = sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()), key=str)
    assert (5, "", 1) in got and (1, "a plain text of some words", 0) in got and (2, None, 0) in got and len(got) == 8
    assert line_dedup.dedup_lines(no_docs).count() == 0
