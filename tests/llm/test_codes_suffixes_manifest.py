"""Vector codes, suffix dedup and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from data import SCHEMA, odd_rows, prose
from pyspark.sql import functions as F

from offerlens.llm import merkle, suffixdedup
from offerlens.llm.merkle import Block, addresses, document_leaves, merkle_manifest, proofs
from offerlens.llm.queries import QUERIES, prepare
from offerlens.llm.suffixdedup import anchors, multikey_order, without_repeats
from offerlens.llm.vectorcodes import code_text, encode, fit_codebooks, nearest_entries, with_group_error


# --- vector codes ----------------------------------------------------------------


def plain_codes(x, parts, entries, rounds):
    cut = np.array_split(x, parts, axis=1)
    books = [p[:entries].copy() for p in cut]
    nearest = lambda p, c: ((p[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, c in zip(cut, books):
            best = nearest(p, c).argmin(1)
            for e in set(best.tolist()):
                c[e] = p[best == e].sum(0) // (best == e).sum()
    told = [nearest(p, c) for p, c in zip(cut, books)]
    return np.stack([t.argmin(1) for t in told], 1), sum(t.min(1) for t in told), books


def test_walk_finds_the_nearest_entry_with_shared_prefixes_and_ties():
    rng = np.random.default_rng(1)
    for spread, width, n in ((2, 6, 3000), (1000, 16, 700), (3, 1, 50), (1 << 27, 16, 300)):
        points, entries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (40, width))
        entries[7] = entries[3]
        best, distance = nearest_entries(points, entries)
        plain = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all()


@pytest.mark.parametrize("copies", [1, 900])
def test_codes_on_small_tables(spark, copies):
    rng = np.random.default_rng(2)
    x = rng.integers(-60, 60, (300, 8)) / 32
    rows = [(i, x[i].tolist(), i % 3 or None) for i in range(300)] + [(1000 + i, x[5].tolist(), 1) for i in range(copies)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = fit_codebooks(vectors, parts=2, entries=16, rounds=3)
    whole = np.array([[int(np.floor(1024 * v)) for v in r[1]] for r in rows])
    codes, error, plain = plain_codes(whole, 2, 16, 3)
    assert all((a == b).all() for a, b in zip(books.entries, plain))
    found = with_group_error(encode(vectors, books), "label").select("*", code_text(F.col("_codes"), 16).alias("text")).collect()
    by_id, group = {r["vec_id"]: r for r in found}, {}
    for r, e in zip(rows, error):
        group[r[2]] = group.get(r[2], 0) + int(e)
    assert len(found) == len(rows)
    for r, c, e in zip(rows, codes, error):
        told = by_id[r[0]]
        assert (told["_codes"], told["_error"], told["group_error"]) == (c.tolist(), int(e), group[r[2]])
        assert told["text"] == "".join(f"{v:x}" for v in c)


def test_odd_vectors_have_codes_or_leave(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.5, -0.25]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 0.0]), (9, [0.0, 0.0]), (None, [-1.5, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [1e30, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "vec_id long, embedding array<double>, _codes string, _error long, _row long")
    books = fit_codebooks(vectors, parts=4, entries=3)
    found = encode(vectors, books)
    assert found.columns == ["vec_id", "embedding", "_row", "_codes", "_error"]
    assert sorted(str(r["vec_id"]) for r in found.collect()) == ["3", "9", "9", "None"]
    assert fit_codebooks(vectors.where("false")) is None
    assert encode(vectors, None).count() == 0


# --- suffix dedup ------------------------------------------------------------------


def plain_removed(rows, length):
    """(id, text) -> bytes that stay and number of removed runs."""
    order = lambda i: suffixdedup.LOWEST if i is None else i
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], order(i))
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        out[i, text] = (bytes(c for c, g in zip(raw, gone) if not g), sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1])))
    return out


def check_suffixes(spark, rows, **limits):
    told = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    plain = plain_removed(rows, limits.get("length", 50))
    assert len(told) == len(rows)
    want = sorted((str(i), len((t or "").encode()), len((t or "").encode()) - len(plain[i, t][0]), plain[i, t][1], plain[i, t][0]) for i, t in rows)
    assert sorted((str(r["_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in told) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in told)
    return told


@pytest.mark.parametrize("limits", [{}, {"bucket_bytes": 500, "sample_docs": 40, "sample_keys": 60}], ids=["one range", "many ranges"])
def test_repeats_across_texts(spark, limits):
    prepare(spark)
    rng = random.Random(4)
    passage = prose(rng, 30)
    # A short passage between texts that differ: its windows at both ends differ in every text.
    brief = "the quick brown fox jumps over the lazy dog twice"
    rows = [(i, prose(rng, 40) + " " + (passage if i % 3 == 0 else brief) + " " + prose(rng, 25)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[3][1][5:-7]), (201, rows[4][1].replace("w1", "q1")), (201, rows[5][1]), (7, rows[8][1])]
    rows += [(300, "ab" * 400), (301, "ab" * 300 + "c"), (302, "x" * 2000), (303, "x" * 49), (304, "x" * 50), (305, "é日🙂" * 60), (306, "日🙂é" * 60), (307, "\0" * 120), (308, "a\0" * 80), (309, "\0" * 90)]
    told = check_suffixes(spark, rows, **limits)
    assert sum(r["n_removed"] for r in told) > 5000


def test_more_ranges_do_not_open_more_windows(spark):
    prepare(spark)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "_o long, _text string, _h int")
    sample = suffixdedup._sampled(docs, 50, 1000, 200)
    keys = [np.frombuffer(bytes(r["_k"]), np.uint8)[None, :50] for r in sample.collect()]
    right = np.concatenate(keys)
    splitters = suffixdedup._splitters(sample, 30, 4000)
    assert len(splitters) > 10
    # A suffix that shares less than a gram with the splitters has no window in two ranges.
    assert (suffixdedup._edge(right, splitters, 50) >= suffixdedup.GRAM).sum() == 0


def test_every_length_and_random_short_alphabets(spark):
    prepare(spark)
    rng = random.Random(6)
    for length in (20, 50):
        rows = [(rng.randrange(40), "".join(rng.choice("ab") for _ in range(rng.randrange(0, 140)))) for _ in range(60)]
        check_suffixes(spark, sorted(set(rows)), length=length, bucket_bytes=300, sample_docs=30, sample_keys=50)


def test_suffix_dedup_on_odd_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = [(r[0], r[1]) for r in odd_rows()]
    plain = plain_removed(list(set(rows)), 50)
    told = without_repeats(docs).collect()
    assert sorted((str(r["_id"]), bytes(r["kept"])) for r in told) == sorted((str(i), plain[i, t][0]) for i, t in rows)
    assert without_repeats(docs.where("false")).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 4000).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = anchors(data, bounds, 50)
    monkeypatch.setattr(suffixdedup, "PIECE", 1000)
    pieces = anchors(data, bounds, 50)
    covered = lambda a: {(int(p - r), int(p)) for p, n, f in zip(a.at, a.near, a.far) for r in range(n, f + 1)}
    assert covered(whole) == covered(pieces) and {s for s, _ in covered(whole)} == set(range(len(text) - 49))


def test_long_document(spark):
    prepare(spark)
    rng = random.Random(9)
    long_text = prose(rng, 900_000, 50_000)
    assert len(long_text) > 5_000_000
    told = without_repeats(spark.createDataFrame([(1, long_text[1_000_000:1_000_400]), (2, long_text)], "doc_id long, text string")).orderBy("_id").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in told] == [(0, 0), (400, 1)]


def test_multikey_order():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 3, (9000, 21)).astype(np.uint8)
    keys[2000:7000] = keys[0]
    found = keys[multikey_order(keys)]
    assert [bytes(r) for r in found] == sorted(bytes(r) for r in keys)


# --- Merkle manifest ---------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: plain_tree([leaf(r) for r in ordered[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(ordered[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            digest = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for left, right in path:
                digest = sha(left + digest + right)
            yield (r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), digest, digest == top[-1][0])


def manifest_of(docs, **kw):
    when = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaves = document_leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": F.regexp_replace("text", "\n", "")}, when)
    return proofs(merkle_manifest(leaves, ["_id"]), "_shown", **kw)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_with_every_source_size(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = [(1000 * k + i, None if k == 0 else f"s{k}", "en", i, f"line\n{i}" if i % 2 else f"{i}") for k, n in enumerate((1, 1, 2, 3, 4, 9, 10, 28)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest_of(docs, siblings=True).select("_id", F.lower(F.hex("_leaf")), "subroot", "root", "proof_sha256", "folded_root", F.expr("folded_root = root"), "siblings").collect()
    assert sorted(tuple(r)[:7] for r in found) == sorted(plain_manifest(rows))
    for r in found:
        assert sha("".join(s["l"] + s["r"] for s in r["siblings"])) == r["proof_sha256"]


def test_manifest_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    found = manifest_of(docs).select("_id", F.lower(F.hex("_leaf")), "subroot", "root", "proof_sha256", "folded_root", F.expr("folded_root = root")).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, plain_manifest(rows)))
    assert manifest_of(docs.where("false")).count() == 0


def test_manifest_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()]
    assert sorted(found) == sorted(plain_manifest(rows))
    assert {r[-1] for r in found} == {True, False}


def test_layout_keeps_subtrees_together():
    for height in range(7):
        places = addresses(height)
        flat = np.concatenate(places)
        assert sorted(flat.tolist()) == list(range(len(flat)))
        assert [len(p) for p in places] == [3**d for d in range(height + 1)]
    # Seven levels: the upper three first, then 27 lower trees of four levels, 40 nodes each.
    lower = [np.concatenate([addresses(6)[3 + e][j * 3**e : (j + 1) * 3**e] for e in range(4)]) for j in range(27)]
    assert [(int(p.min()), int(p.max())) for p in lower] == [(13 + 40 * j, 52 + 40 * j) for j in range(27)]


def test_block_reads_back():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    levels = plain_tree([d.hex() for d in leaves])
    block = Block.of(leaves, 3)
    assert block.root.hex() == levels[-1][0]
    assert [block.read(3 - k, 0, len(level)) for k, level in enumerate(levels)] == levels
    assert block.paths() == [plain_path(levels, i) for i in range(20)]
