"""Registered queries against plain Python over the whole small tables."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import connect, difference  # noqa: E402

from offerlens.llm import catalog  # noqa: E402
from offerlens.llm.ann import build_tree, nearest_neighbours  # noqa: E402
from offerlens.llm.bagminhash import shingles, signatures  # noqa: E402
from offerlens.llm.fmindex import FMIndex, WaveletMatrix, matched_windows  # noqa: E402
from offerlens.llm.quality import divergence  # noqa: E402
from offerlens.llm.queries import QUERIES, tokenizer_file  # noqa: E402
from offerlens.llm.substring import repeated_windows  # noqa: E402
from offerlens.llm.tokens import ChunkEncoder, safe_pieces  # noqa: E402
from offerlens.llm.toxicity import label_model  # noqa: E402
from offerlens.llm.words import words_of  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def texts(table):
    return dict(zip(table["doc_id"].tolist(), table["text"].tolist()))


def test_queries_with_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in catalog.ORACLES.items():
        assert difference(spark, con, catalog.QUERIES[name], sql, sf_dir)[0] is None


def test_packing(spark, sf_dir, texts):
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in QUERIES["op1_pack"](spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for sequence, held in windows.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 2048 or sequence == max(windows)


def test_token_counts(spark, sf_dir, texts):
    plain = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_never_change_ids(name):
    coder = ChunkEncoder(tokenizer_file(name))
    assert coder.kind != "whole"
    rng = np.random.default_rng(3)
    bits = ["a", "b ", " ", "\n", "'s", "é", "́", "1", "!", "<|endoftext|>", " ", " ", "Z", "\t", "\0", "\x1c", "日", "🙂", "İ", "Σς"]
    odd = ["", " ", " a", "a ", "a   b", "a\n b", "x <|endoftext|> y", "\0\na", *("".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(1500))]
    expected = [e.ids for e in coder.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.ids(odd)] == expected
    assert ChunkEncoder(tokenizer_file(name)).counts(odd) == [len(e) for e in expected]
    long_text = "some words, and more\n " * 9000
    pieces = list(safe_pieces(long_text, 1000))
    assert "".join(pieces) == long_text and len(pieces) > 100
    assert sum(len(coder.tokenizer.encode(p, add_special_tokens=False).ids) for p in pieces) == len(coder.tokenizer.encode(long_text, add_special_tokens=False).ids)


def test_language_on_held_out_rows(spark, sf_dir, table):
    lang = dict(zip(table["doc_id"].tolist(), table["lang"].tolist()))
    rows = QUERIES["op2_language"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_dictionary_counts_copies_once_and_reads_past_the_head(spark):
    from offerlens.llm.langid import language_dictionaries

    text = lambda i: "head " * 220 + " ".join(f"t{i}x{j}" for j in range(1000))
    rows = [(text(i), "en") for i in range(60) for _ in range(1 if i % 5 else 40)]
    held = language_dictionaries(spark.createDataFrame(rows, "text string, lang string"))["en"].decode().split()
    tails = {w.split("x")[0] for w in held if re.fullmatch(r"t\d+x\d+", w)}
    assert len(" ".join(held)) > 30_000 and len(tails) >= 25


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, sf_dir).collect()
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.7, 0.02), (0.6, 0.05), (0.5, 0.01), (0.4, 0.03))], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # two voters that always agree
    posterior, accuracy, correlation = label_model(votes, 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.9
    assert abs(accuracy[1, 1] - 0.6) < 0.1 and accuracy[0].max() < 0.1
    assert correlation[0, 4] > 0.95 and abs(correlation[0, 1]) < 0.4


def test_quality_counts(spark, sf_dir, texts):
    for r in QUERIES["op4_quality_rules"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = Counter(windows)
        covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed
        )
        assert not (failed and r["kept"])


def test_quality_keeps_prose_and_drops_junk(spark):
    sf_dir = "/root/testdata/sf0.01"
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op4_quality_rules"](spark, sf_dir).collect() if r["doc_id"] in quality and not r["base_failed"]]
    good = [r["kept"] for r in rows if quality[r["doc_id"]] == 1]
    junk = [r["kept"] for r in rows if quality[r["doc_id"]] == 0]
    assert sum(good) == len(good)
    assert sum(junk) < 0.6 * len(junk)


def test_divergence():
    p, q = np.array([[1.0, 1, 0]]), np.array([[0.0, 1, 1]])
    assert math.isclose(divergence(p, q)[0], 0.5)
    assert divergence(p, p)[0] == 0 and divergence(p, p * 0)[0] == 0


def test_near_classes(spark, sf_dir, texts):
    bags = {}
    for doc, text in texts.items():
        words = WORD.findall(text)
        bags[doc] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    holders = defaultdict(list)
    for doc, bag in bags.items():
        for shingle in bag:
            holders[shingle].append(doc)
    root = {doc: doc for doc in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {p for docs in holders.values() for p in combinations(docs, 2)}:
        low = (bags[a] & bags[b]).total()
        if low >= 0.8 * (bags[a].total() + bags[b].total() - low):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = QUERIES["op7_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {doc: find(doc) for doc in bags}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, 40)
    b = np.where(rng.random(40) < 0.5, a, rng.integers(0, 9, 40))
    item = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    doc = np.repeat([0, 1], 40)
    weight = np.concatenate([a, b])
    keep = weight > 0
    table = signatures(doc[keep], np.concatenate([item, item])[keep], weight[keep], 2, 4096)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((table[0] == table[1]).mean() - exact) < 0.03


def test_shingles_of_short_texts():
    import pyarrow as pa

    doc, item, times = shingles(words_of(pa.array(["a b", "a  b", None, "", "a b a b a b a b"])), 3)
    assert doc.tolist() == [0, 1, 4, 4] and times.tolist() == [1, 1, 3, 3] and item[0] == item[1]


@pytest.mark.parametrize("limits", [{}, {"hot_segments": 2, "shard_words": 3000}])
def test_repeated_windows(spark, sf_dir, texts, limits):
    first, words_in = {}, {doc: WORD.findall(text) for doc, text in texts.items()}
    for doc, words in words_in.items():
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = repeated_windows(docs, **limits).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = words_in[r["doc_id"]]
        gone = {k for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < r["doc_id"] for k in range(i, i + 50)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert {k for s in r["spans"] for k in range(s["start"], s["start"] + s["length"])} == gone


def test_segments_of_a_hot_anchor_never_meet_in_one_index(spark, monkeypatch):
    from offerlens.llm import substring

    def bounded(index, flat, bounds, owners, window, run=substring.matched_windows):
        assert len(bounds) - 1 <= 40
        return run(index, flat, bounds, owners, window)

    monkeypatch.setattr(substring, "matched_windows", bounded)
    rng = np.random.default_rng(4)
    passage, own = [f"p{i}" for i in range(30)], lambda: [f"w{n}" for n in rng.integers(0, 10**9, 60)]
    words_in = {i: own() + passage + own() for i in range(90)}
    # Fifteen documents repeat ten, twenty or thirty words around the passage of an earlier one.
    for i in range(75, 90):
        n = 10 * (1 + i % 3)
        words_in[i][60 - n : 60], words_in[i][90 : 90 + n] = words_in[i - 70][60 - n : 60], words_in[i - 70][90 : 90 + n]
    first = {}
    for doc, words in words_in.items():
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc)
    docs = spark.createDataFrame([(doc, " ".join(words)) for doc, words in words_in.items()], "doc_id long, text string")
    rows = repeated_windows(docs, hot_segments=20, shard_words=1000).collect()
    assert len(rows) == 90 and sum(r["n_removed"] > 0 for r in rows) == 15
    for r in rows:
        words = words_in[r["doc_id"]]
        gone = {k for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < r["doc_id"] for k in range(i, i + 50)}
        assert {k for s in r["spans"] for k in range(s["start"], s["start"] + s["length"])} == gone


def test_wavelet_ranks_and_matches():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 11, 500)
    matrix = WaveletMatrix(text, 11)
    symbol, at = rng.integers(0, 11, 300), rng.integers(0, 501, 300)
    assert matrix.rank(symbol, at).tolist() == [int((text[:i] == c).sum()) for c, i in zip(symbol, at)]
    flat, bounds, owners = rng.integers(0, 2, 400), np.arange(0, 401, 40), np.arange(10)[::-1].copy()
    hits = matched_windows(FMIndex(flat, bounds, owners), flat, bounds, owners, 6)
    for s in range(10):
        for i in range(s * 40, s * 40 + 40):
            part = flat[i : i + 6].tolist()
            held = any(owners[o] < owners[s] and part == flat[j : j + 6].tolist() for o in range(10) for j in range(o * 40, o * 40 + 35))
            assert hits[i] == (i + 6 <= s * 40 + 40 and held)


def test_mixing(spark, sf_dir, table):
    rows = QUERIES["op9_mix_sources"](spark, sf_dir).collect()
    assert len(rows) == len(table)
    size = {d: len(WORD.findall(t)) for d, t in zip(table["doc_id"], table["text"])}
    source = dict(zip(table["doc_id"], table["source"]))
    totals = Counter()
    for doc, n in size.items():
        totals[source[doc]] += n
    names = sorted(totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * totals[s]}
        for s in full or open_:
            target[s] = 2 * totals[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == totals[r["source"]] and math.isclose(r["target"], target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == int(1.5 * sum(totals.values()))
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    again = QUERIES["op9_mix_sources"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_neighbours(spark, sf_dir):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    found = defaultdict(dict)
    for r in QUERIES["op10_nearest_neighbours"](spark, sf_dir).collect():
        found[r["query_id"]][r["vec_id"]] = (r["rank"], r["score"])
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len({int(ids[i]) for i in order} & set(found[q]))
        total += len(order)
        assert [v for v, _ in sorted(found[q].items(), key=lambda p: p[1][0])] == sorted(found[q], key=lambda v: (d[ids == v][0], v))
        assert all(math.isclose(s, d[ids == v][0], rel_tol=1e-12) for v, (_, s) in found[q].items())
    assert hits >= 0.9 * total


def test_leaf_of_equal_vectors_is_cut_into_blocks(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), float(i)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    query = vectors["vec_id"] == 1
    found = nearest_neighbours(vectors, query, block_rows=50, leaf_rows=8).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [i for i in range(2, 600) if i % 3][:10]


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 8))
    tree = build_tree(x, 4, 20)
    assert sorted(tree.best_bins(x[0])) == list(range(tree.leaves))
    assert next(tree.best_bins(x[0])) == tree.assign(x[:1])[0] or tree.leaves > 1


def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} <= set(texts)
    ends = defaultdict(int)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 2048
        ends[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in ends.items() if s != max(ends))


def test_pipeline_drops_every_later_copy_of_a_line(spark, sf_dir, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    seen, expected = set(), {}
    for doc, text in texts.items():
        left = []
        for line in text.split("\n"):
            if not WORD.search(line) or line not in seen:
                left.append(line)
            if WORD.search(line):
                seen.add(line)
        if any(map(WORD.search, left)) or not WORD.search(text):
            expected[doc] = "\n".join(left)
    assert found == expected


def near_firsts(texts):
    """The smallest id of each class of near copies, by comparing all pairs that share a shingle."""
    bags, holders = {}, defaultdict(list)
    for doc, text in texts.items():
        words = WORD.findall(text)
        bags[doc] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
        for shingle in bags[doc]:
            holders[shingle].append(doc)
    linked = defaultdict(set)
    for a, b in {p for docs in holders.values() for p in combinations(docs, 2)}:
        low = (bags[a] & bags[b]).total()
        if low >= 0.8 * (bags[a].total() + bags[b].total() - low):
            linked[a].add(b)
            linked[b].add(a)
    firsts, met = set(), set()
    for doc in sorted(bags):
        if doc not in met:
            firsts.add(doc)
            todo = [doc]
            while todo:
                x = todo.pop()
                if x not in met:
                    met.add(x)
                    todo += linked[x]
    return firsts


def test_every_stage_of_the_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    from offerlens.llm.toxicity import fit_toxicity, score_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given, came, frames = {}, {}, {}
    for name, stage in cp.STAGES:
        given[name], frames[name] = docs.collect(), docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        came[name] = docs.collect()

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").select("doc_id", "toxic")
    plain = frames["toxicity"].select("doc_id", "text")
    score = {r["doc_id"]: r["score"] for r in score_toxicity(plain, fit_toxicity(plain, labels)).collect()}
    assert sorted(came["toxicity"]) == sorted(r for r in given["toxicity"] if score[r["doc_id"]] < 0.3)
    assert 0 < len(came["toxicity"]) < len(given["toxicity"])

    seen, expected = set(), []
    for r in sorted(given["line_dedup"]):
        left = []
        for line in r["text"].split("\n"):
            if line not in seen:
                left.append(line)
            if WORD.search(line):
                seen.add(line)
        text = "\n".join(left)
        if WORD.search(text) or not WORD.search(r["text"]):
            expected.append((r["doc_id"], text, r["lang"], r["source"], len(text) if text != r["text"] else r["n_chars"]))
    assert sorted(map(tuple, came["line_dedup"])) == expected

    firsts = near_firsts({r["doc_id"]: r["text"] for r in given["near_dedup"]})
    assert sorted(came["near_dedup"]) == sorted(r for r in given["near_dedup"] if r["doc_id"] in firsts)

    told = cp.weighted_fair_mix(frames["mixing"].select("doc_id", "text", "source")).collect()
    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in told}
    assert set(times.values()) <= {0, 1, 2}
    assert Counter(came["mixing"]) == Counter({r: times[r["doc_id"]] for r in given["mixing"] if times[r["doc_id"]]})

    coder = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    copies, covered, pieces = Counter(given["packing"]), defaultdict(Counter), defaultdict(list)
    ids = {r["doc_id"]: np.array(coder.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in copies}
    for r in came["packing"]:
        assert bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {r["doc_id"]: Counter(dict.fromkeys(range(len(ids[r["doc_id"]])), n)) for r, n in copies.items()}
    for sequence, held in pieces.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 2048 or sequence == max(pieces)
