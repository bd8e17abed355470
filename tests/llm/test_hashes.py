"""Words, lines and texts that a polynomial hash modulo 2**64 takes for equal."""

import numpy as np
import pytest

from offerlens.llm.bagminhash import near_duplicates
from offerlens.llm.quality import language_references, quality_rules
from offerlens.llm.queries import prepare
from offerlens.llm.substring import repeated_windows
from offerlens.llm.words import span_hash


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIR = thue_morse(2048), thue_morse(2048, "ba")


@pytest.fixture
def docs(spark):
    prepare(spark)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, w, *words[::-1]]) for w in PAIR]
    # A text whose two lines and two windows differ in one such word only.
    twice = "\n".join(" ".join(["one two three four five six seven", w]) for w in PAIR)
    return spark.createDataFrame([(1, texts[0], "en"), (2, texts[1], "en"), (3, " ".join([PAIR[0]] * 5), "en"), (4, " ".join([PAIR[1]] * 5), "en"), (5, twice, "en")], "doc_id long, text string, lang string")


def test_spans_of_any_length():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 40_000).astype(np.uint8)
    data[20_000:22_048] = np.frombuffer(PAIR[0].encode(), np.uint8)
    data[30_000:32_048] = np.frombuffer(PAIR[1].encode(), np.uint8)
    starts = np.concatenate([rng.integers(0, 39_000, 500), [20_000, 30_000, 5, 5]])
    ends = np.concatenate([starts[:500] + rng.integers(0, 40, 500), [22_048, 32_048, 5, 6]])
    hashes = span_hash(data, starts, ends)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    same = {}
    for text, h in zip(texts, hashes.tolist()):
        assert same.setdefault(text, h) == h
    assert len(set(same.values())) == len(same)


def test_different_texts_stay_different(docs):
    assert len({r["_class"] for r in near_duplicates(docs).where("_id in (3, 4)").collect()}) == 2
    removed = {r["doc_id"]: r["n_removed"] for r in repeated_windows(docs).collect()}
    # Only the 60 words on either side of the middle word repeat.
    assert removed[2] == 120 and removed[4] == 0
    counts = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules(docs, language_references(docs)).collect()}
    assert counts[5] == (0, 0)


def test_a_worker_gives_a_large_token_cache_back(monkeypatch):
    """Pipeline: what packing learned must not stand beside the next job's tasks."""
    import public_tokenizers

    from offerlens.llm import tokens

    coder = tokens.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = coder.ids(["one two three four"])
    monkeypatch.setattr(tokens, "IDLE_LIMIT", 3)
    coder.rest()
    assert not coder.cache and coder.ids(["one two three four"]) == first


def test_words_are_found_as_columns_and_tokens_are_the_librarys():
    """op1_pack: every word of every text went through a Python dictionary."""
    import pyarrow as pa
    import public_tokenizers

    from offerlens.llm import tokens

    coder = tokens.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [
        "", " ", "a", "  a b", " a", "a ", "a  b", "\n a", "a\nb c\n", "x \x85y", "mix Жа 中文 ok", "<|endoftext|> a", "a b<|endoftext|>c d", "a\0b c", "\0",
        "a \x1c b", "ab cd " * 50 + "ef", "\ta b", "a \tb", "don't it's 'll we'd", "12 3a 4.5,6", "İ ı", "\n\n a b\n\n", "a b\n\n c",
    ]
    plain = ["one two three four " * 3 + "x", "four three\ntwo one y"]
    for texts in (odd, plain, odd + plain, []):
        ids, ends = coder.arrays(pa.array(texts, pa.string()))
        got = [part.tolist() for part in np.split(ids, ends)[:-1]]
        assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    fresh = tokens.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    fresh.arrays(pa.array(plain))
    assert len(fresh.cache) == len(plain)
    rows = [pa.record_batch([pa.array(list(range(i, i + 4))), pa.array(["ab" * i, None, "", "c"])], ["i", "t"]) for i in range(0, 40, 4)]
    runs = list(tokens.byte_runs(iter(rows), 1, 100))
    assert sum((r.column(0).to_pylist() for r in runs), []) == list(range(40))
    assert len(runs) < 10 and max(r.column(1).nbytes for r in runs) < 400
