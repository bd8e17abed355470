"""Token ids of whole texts through a cache of chunks between spaces.

A tokenizer file's own rules are kept: a text is cut only where no token can reach
across, each distinct chunk is encoded by the library once per worker, and texts in which
such cuts are not provably safe go to the library whole or in long safe pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

# A space next to more white space, or at an end: the pre-tokenizer looks across it.
_AMBIGUOUS = re.compile(r" \s|^ | $")
# Between two ASCII letters a single space always starts a new pre-token.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
# Control separators on which Python and the tokenizers disagree about white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LONG = 1 << 16
CACHE_LIMIT = 1_000_000
#: Chunks that a worker may keep while it waits for a task; idle workers stay for a while.
IDLE_LIMIT = 250_000


def safe_pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut before a space between two
    ASCII letters. Without such a place the piece runs on: a cut is never forced."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def byte_batches(texts: list[str], limit: int = 1 << 20) -> Iterator[list[int]]:
    """Positions of the texts in groups of about ``limit`` characters, longest first, so
    that no group waits for one long text at its end."""
    group: list[int] = []
    size = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if group and size + len(texts[i]) > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i])
    if group:
        yield group


# Fixed value: the word pattern of byte-level pre-tokenizers.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _rank_encoder(model: dict):
    """A faster encoder with the same vocabulary, if ids rise in the order of the merges:
    then the lowest merged id is the first merge, and both encoders merge alike."""
    vocab, merges = model["vocab"], model["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if model.get("ignore_merges") or not all(x < y for x, y in zip(made, made[1:])) or made[0] < 256:
        return None
    # Bytes without a printable form are written as characters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    used = {i for i in made}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i in used or (len(t) == 1 and t in byte_of)}
    coder = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(b) for b in ranks]

    def encode(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each led by a space, and how many a word of ``sizes`` bytes has. No word changes its
        neighbour: they are encoded as one text, and the tokens' byte lengths tell where one ends."""
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            ids = np.array(coder.encode_ordinary(" " + " ".join(part)), np.uint32)
            ends = np.cumsum(sizes[i : i + 8192] + 1)
            found.append(ids)
            counts.append(np.diff(np.searchsorted(np.cumsum(width[ids]), ends) + 1, prepend=0))
        return np.concatenate(found), np.concatenate(counts)

    return encode


class ChunkEncoder:
    """Encodes texts by chunks; ``counts`` gives lengths only, ``ids`` packed uint32 bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, object] = {}
        self.quick = None
        # Two known shapes: spaces lead the next word (byte-level), or white space is dropped.
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre, norm = rules["pre_tokenizer"] or {}, rules["normalizer"]
        self.marks = [t["content"] for t in rules["added_tokens"]]
        plain_marks = not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        steps = pre.get("pretokenizers", [])
        dropped = steps and steps[0]["type"] == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"\s" not in steps[0]["pattern"]["Regex"].replace(r"[^\s", "")
        known = [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "lead"
            self.quick = _rank_encoder(rules["model"])
        elif dropped and known and plain_marks:
            self.kind = "drop"

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks whose encodings add up to the text's, or None where that is not certain."""
        if self.kind == "drop" and not _ODD_SPACE.search(text):
            return text.split()
        if self.kind == "lead" and "\0" not in text and not _AMBIGUOUS.search(text) and not any(m in text for m in self.marks):
            parts = text.split(" ")
            # All chunks but the first follow a space; a zero byte tells the first apart.
            parts[0] = "\0" + parts[0]
            return parts
        return None

    def _learn(self, names: list[str], pack, unpack) -> None:
        if len(self.cache) + len(names) > CACHE_LIMIT:
            self.cache.clear()
        texts = names
        if self.kind == "lead":
            texts = [n[1:] if n[:1] == "\0" else " " + n for n in names]
        if self.quick is not None:
            simple = [t[:1] == " " and (t.isascii() or max(t) < "\u0250") for t in texts]
            led = [t for t, ok in zip(texts, simple) if ok]
            ids, counts = self.quick([t[1:] for t in led], np.array([len(t.encode()) - 1 for t in led], np.int64))
            raw, edges = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            parts = (raw[a:b] for a, b in zip(edges, edges[1:]))
            self.cache.update(zip((n for n, ok in zip(names, simple) if ok), map(unpack, parts)))
            names = [n for n, ok in zip(names, simple) if not ok]
            texts = [t for t, ok in zip(texts, simple) if not ok]
        if names:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self.cache.update((n, pack(e.ids)) for n, e in zip(names, found))

    def _encode(self, texts: list[str], pack, unpack, join) -> list:
        """``pack`` makes a cache entry of ids, ``unpack`` of packed ids, ``join`` adds entries up."""
        out: list = [None] * len(texts)
        for group in byte_batches(texts):
            short: dict[int, tuple[list[str], list]] = {}
            for i in group:
                chunks = self._chunks(texts[i])
                if chunks is None:
                    pieces = list(safe_pieces(texts[i]))
                    out[i] = join(pack(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))
                    continue
                values = list(map(self.cache.get, chunks))
                if None in values:
                    short[i] = (chunks, values)
                else:
                    out[i] = join(values)
            # One copy of each missing chunk; the others of the group wait for it.
            missing = list({c for chunks, values in short.values() for c, v in zip(chunks, values) if v is None})
            if missing:
                self._learn(missing, pack, unpack)
            for i, (chunks, values) in short.items():
                # A chunk still missing here left with a full cache, whose copy in values stays good.
                out[i] = join(self.cache[c] if v is None else v for c, v in zip(chunks, values))
        return out

    def rest(self) -> None:
        """At the end of a task: a large cache is given back, since the next task may be another job's."""
        if len(self.cache) > IDLE_LIMIT:
            self.cache.clear()

    def counts(self, texts: list[str]) -> list[int]:
        return self._encode(texts, len, lambda raw: len(raw) >> 2, sum)

    def ids(self, texts: list[str]) -> list[bytes]:
        return self._encode(texts, lambda ids: np.asarray(ids, "<u4").tobytes(), lambda raw: raw, b"".join)

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end. Texts are cut and their distinct
        words found as columns, so that Python sees a word once a call; nulls are not allowed.

        Words lead with a space, except a text's first; that one, and whole texts in which such
        cuts are not safe, go the way of ``ids``.
        """
        if self.quick is None or not len(texts):
            raw = self.ids(texts.to_pylist())
            return np.frombuffer(b"".join(raw), "<u4"), np.cumsum([len(r) >> 2 for r in raw], dtype=np.int64)
        split = pc.split_pattern(texts, " ")
        edges = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, np.asarray(coded.indices)
        listed = words.to_numpy(zero_copy_only=False)
        # An empty word or one that starts with white space: the pre-tokenizer looks across it.
        sizes = np.asarray(pc.binary_length(words)).astype(np.int64)
        odd = (sizes == 0) | np.asarray(pc.match_substring_regex(words, f"^[{_SPACES}]"))
        for mark in ("\0", *self.marks):
            odd |= np.asarray(pc.match_substring(words, mark))
        unsafe = np.diff(np.append(0, np.cumsum(odd[at]))[edges]) > 0
        for mark in self.marks:
            if " " in mark:
                unsafe |= np.asarray(pc.match_substring(texts, mark))
        simple = ~odd & ~np.asarray(pc.match_substring_regex(words, "[\u0250-\U0010ffff]"))
        rare = np.flatnonzero(~odd & ~simple)
        flat, counts = self.quick(listed[simple].tolist(), sizes[simple])
        pack, unpack = lambda ids: np.asarray(ids, "<u4").tobytes(), lambda raw: raw
        values = list(map(self.cache.get, listed[rare]))
        missing = [w for w, v in zip(listed[rare], values) if v is None]
        if missing:
            self._learn(missing, pack, unpack)
        values = [self.cache[w] if v is None else v for w, v in zip(listed[rare], values)]
        firsts = pc.if_else(pa.array(unsafe), texts, split.flatten().take(pa.array(edges[:-1])))
        values += self.ids(firsts.to_pylist())
        # Entries: the words, then one for each text.
        size = np.zeros(len(listed) + len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(simple), rare, np.arange(len(listed), len(size))])
        size[order] = np.concatenate([counts, np.array([len(v) >> 2 for v in values], np.int64)])
        start = np.zeros(len(size), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate([flat, np.frombuffer(b"".join(values), "<u4")])
        entry = at.astype(np.int64)
        entry[edges[:-1]] = np.arange(len(listed), len(size))
        held = np.diff(edges)
        if unsafe.any():
            kept = ~np.repeat(unsafe, held)
            kept[edges[:-1]] = True
            entry, held = entry[kept], np.where(unsafe, 1, held)
        n = size[entry]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(start[entry] - ends + n, n)]
        return ids, ends[np.cumsum(held) - 1]


def byte_runs(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of a column, or of one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        upto = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)))
        cuts = [0, *(np.flatnonzero(np.diff(upto[1:] // limit)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and size + upto[b] - upto[a] > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += upto[b] - upto[a]
    if held:
        yield pa.concat_batches(held)


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, use: str) -> ChunkEncoder:
    """One encoder per worker, file and kind of result; its cache outlives a task."""
    if (path, use) not in _encoders:
        _encoders[path, use] = ChunkEncoder(path)
    return _encoders[path, use]
