import random

from rollgrid.llm import line_dedup
from tests.llm.helpers import ODD_DOCS, no_docs, odd_docs


def brute(rows):
    seen, cut = {}, {i: set() for i, _ in rows}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        for i in range(max(1, len(lines) - 2)):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" ") == "":
                continue
            if window in seen:
                cut[doc].update(range(i, i + len(window)))
            seen.setdefault(window, (doc, i))
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut[doc]) for doc, text in rows}


def test_equals_brute_force(spark):
    rng = random.Random(6)
    passages = [[f"p{p} {i}" for i in range(rng.randint(2, 6))] for p in range(6)]
    rows = []
    for doc in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(40)}"] * rng.randint(1, 5)
            lines += [""] * rng.randrange(3)
        rows.append((doc, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want
    for r in got:
        assert r["n_lines"] == len(dict(rows)[r["doc_id"]].split("\n"))


def test_odd_rows(spark):
    done = line_dedup.dedup_lines(odd_docs(spark))
    assert done.columns == ["doc_id", "text", "fp", "row", "n_lines", "n_removed"]
    rows = done.collect()
    assert len(rows) == len(ODD_DOCS)
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in rows if r["doc_id"] == 2] == [(None, 0, 0)]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [ODD_DOCS[0][1]] * 2
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0
