"""Maximal repeated line runs of any length, against plain Python over all pairs of places."""

import random

import pytest
from data import WORD

from offerlens.llm.linedup import dedup_lines
from offerlens.llm.queries import QUERIES, prepare


def expected(texts, least):
    """Per text: maximal earlier-copied runs as (line, visible lines), and the lines they cover."""
    visible = [[i for i, line in enumerate(t.split("\n")) if WORD.search(line)] for t in texts]
    seqs = [[t.split("\n")[i] for i in v] for t, v in zip(texts, visible)]
    places = {}
    out = []
    for d, seq in enumerate(seqs):
        longest = []
        for j, line in enumerate(seq):
            best = 0
            for e, k in places.get(line, []):
                n = 0
                while j + n < len(seq) and k + n < len(seqs[e]) and seq[j + n] == seqs[e][k + n]:
                    n += 1
                best = max(best, n)
            longest.append(best)
            places.setdefault(line, []).append((d, j))
        runs = [(j, n) for j, n in enumerate(longest) if n >= least and (j == 0 or longest[j - 1] != n + 1)]
        gone = {visible[d][j + x] for j, n in runs for x in range(n)}
        out.append(([(visible[d][j], n) for j, n in runs], gone))
    return out


def cases():
    rng = random.Random(3)
    block = [f"block {i}" for i in range(40)]
    texts = ["\n".join(["a", "", "b", " ", "c"] + block), "\n".join(block[7:] + ["b", "c"]), "\n".join(["x"] + block + ["\t", "x", "y"])]
    # The end of one text and the start of the next are no run; a line repeated inside a text.
    texts += ["p\nq", "r\ns", "z\np\nq\nr\ns\np", "\n".join(["o"] * 37), "\n".join(["o"] * 5 + ["x"] + ["o"] * 9), "", "\n \n"]
    # Few different lines: copies of every length that overlap and branch everywhere.
    texts += ["\n".join(rng.choice("uvw" if rng.random() < 0.9 else ["", "t"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [texts[10], "\n".join(texts[11:14])]
    return texts


@pytest.mark.parametrize("least", [1, 2, 3, 6])
def test_runs_of_any_length(spark, least):
    prepare(spark)
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in dedup_lines(docs, min_lines=least).collect()}
    for d, (runs, gone) in enumerate(expected(texts, least)):
        assert [tuple(c) for c in found[d]["_copies"] or []] == runs, d
        assert {s + i for s, n in found[d]["_runs"] or [] for i in range(n)} == gone
        assert found[d]["text"] == "\n".join(line for i, line in enumerate(texts[d].split("\n")) if i not in gone)
    assert max(n for r in found.values() for _, n in r["_copies"] or []) == 40


def test_the_query_tells_the_runs(spark, tmp_path):
    """op5_line_dedup works on runs of any length, not on single lines alone."""
    texts = cases()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_removed"], r["n_runs"], r["longest_run"]) for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {d: (len(gone), len(runs), max([n for _, n in runs], default=0)) for d, (runs, gone) in enumerate(expected(texts, 1))}
