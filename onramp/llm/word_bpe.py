"""Operator 3: BPE encoding and decoding with contiguous rank arrays.

A text is cut at the vocabulary's special tokens, then at ASCII white space into chunks.
Each chunk is normalised (NFC, lower case) and split by the vocabulary's pattern into
words; the bytes of a word become symbols, the last one with the word-end suffix. A short
word holds its parts and the merge ranks of adjacent parts in two contiguous arrays: the
smallest rank is found by a scan (leftmost of equals), its boundary deleted, and the two
neighbouring ranks refreshed, until no rank is left. Short words of one length are worked
on together as the rows of two matrices: every row that still has a rank loses exactly
one part a round, so the matrices stay dense. Words over ``SHORT`` symbols would make the
scan quadratic and use a heap over linked parts instead, with the same result.

Chunks are independent of each other, so each task keeps the ids of words and chunks it
has seen, in two generations of bounded size. Decoding joins the token strings of the ids
by single blanks, which is what a vocabulary file without a decoder asks for.

Edge cases: null is the empty text; a text without words gives no ids and the empty
decoded text; invalid UTF-8 counts as U+FFFD; repeated rows are encoded alike; an empty
table gives an empty result; very long texts are encoded whole, long chunks by the heap;
other columns, also of clashing names, are ignored. NFC and lower case are those of the
vocabulary's own library (its normaliser alone), as its Unicode tables and the interpreter's
differ in some marks and capitals.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import normalizers

from .common import pick, raw_bytes, ready, table

SHORT = 64
CACHED = 200_000       # words, and chunks, of one cache generation
CACHED_BYTES = 4 * SHORT  # longer chunks are not kept
BATCH_BYTES = 4 << 20  # text encoded together
NO_RANK = 1 << 30
VOCABULARY_BYTES = 16 << 20  # bound of the vocabulary file that is broadcast


normalised = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, otherwise the next free code point from 256."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


# Blocks with letters and numbers that Unicode 16 added, which the
# vocabulary's library knows although the interpreter's own tables end before them.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F),
    (0x10EC2, 0x10EC4), (0x11380, 0x113E2), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)


def newer_letters() -> str:
    """Ranges (as in a character class) of the letters and numbers that the ``regex`` module
    knows but Unicode 16, which the vocabulary's library follows, does not."""
    known = regex.compile(r"[\p{L}\p{N}]").match
    out: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.category(ch := chr(c)) == "Cn" and known(ch) and not any(a <= c <= b for a, b in ADDED_IN_16):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) or "\\U0010ffff"


class Generations:
    """A bounded cache: entries of the last generation that are used again move on."""

    def __init__(self) -> None:
        self.now: dict[bytes, bytes] = {}
        self.last: dict[bytes, bytes] = {}

    def __contains__(self, key: bytes) -> bool:
        if key in self.now:
            return True
        got = self.last.get(key)
        if got is None:
            return False
        self.now[key] = got
        return True

    def turn(self) -> None:
        if len(self.now) >= CACHED:
            self.now, self.last = {}, self.now


def portions(texts: list[bytes], most: int = BATCH_BYTES):
    """Consecutive runs of texts of about ``most`` bytes."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


class WordBpe:
    """Encoder and decoder of one vocabulary (the text of a tokenizer JSON file)."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"].encode(): t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for token, i in vocab.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.decode()
        self.cut = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        newer = newer_letters()
        self.newer = regex.compile(f"[{newer}]").search
        self.words_newer = regex.compile("(?V1)" + re.sub(r"\\p\{([LN])\}", lambda m: f"[\\p{{{m[1]}}}--[{newer}]]", pattern)).findall
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [vocab[a] << 32 | vocab[b] for a, b in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(pairs, np.int64)[order], order.astype(np.int32)
        self.word_ids, self.chunk_ids = Generations(), Generations()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of parts, NO_RANK where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK).astype(np.int32)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length, each a row of ``parts`` with its row of ``ranks``."""
        n = len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        rows, out = np.arange(len(words)), [b""] * len(words)

        def done(which: np.ndarray, ids: np.ndarray) -> None:
            raw_ids, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, row in enumerate(which.tolist()):
                out[row] = raw_ids[k * width:(k + 1) * width]

        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            if (ended := least == NO_RANK).any():
                done(rows[ended], parts[ended])
                live = ~ended
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
                if not len(rows):
                    break
            width = parts.shape[1]
            k = np.arange(len(rows))
            parts[k, at] = self.merged[least]
            stays = np.ones(parts.shape, bool)
            stays[k, at + 1] = False
            parts = parts[stays].reshape(len(rows), width - 1)
            stays = np.ones(ranks.shape, bool)
            stays[k, at] = False
            ranks = ranks[stays].reshape(len(rows), width - 2)
            if (left := np.flatnonzero(at > 0)).size:
                i = at[left]
                ranks[left, i - 1] = self.rank_of(parts[left, i - 1], parts[left, i])
            if (right := np.flatnonzero(at < width - 2)).size:
                i = at[right]
                ranks[right, i] = self.rank_of(parts[right, i], parts[right, i + 1])
        done(rows, parts)
        return out

    def merge_long(self, word: bytes) -> bytes:
        parts = [int(self.inner[b]) for b in word]
        parts[-1] = int(self.last[word[-1]])
        rank_of, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue  # made from parts that have been merged since
            parts[i], gone[j], after[i] = int(self.merged[r]), 1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := rank_of(parts[i] << 32 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (q := rank_of(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return np.array([p for p, g in zip(parts, gone) if not g], "<u4").tobytes()

    def words_of(self, chunk: bytes) -> list[bytes]:
        text = chunk.decode("utf-8", "replace")
        find = self.words
        if not text.isascii():
            text = normalised(text)
            if self.newer(text):
                find = self.words_newer
            return [w.encode() for w in find(text)]
        return [w.encode() for w in find(text.lower())]

    def learn(self, chunks) -> None:
        """Bring the ids of ``chunks`` into the cache's present generation."""
        new = [c for c in chunks if c not in self.chunk_ids]
        if not new:
            return
        split = [self.words_of(c) for c in new]
        by_length: dict[int, list[bytes]] = {}
        long_words: dict[bytes, bytes] = {}
        for w in set().union(*split):
            if len(w) > SHORT:
                long_words[w] = self.merge_long(w)
            elif w not in self.word_ids:
                by_length.setdefault(len(w), []).append(w)
        ids = self.word_ids.now
        for words in by_length.values():
            ids.update(zip(words, self.merge_short(words)))
        of = ids.__getitem__ if not long_words else (lambda w: long_words[w] if w in long_words else ids[w])
        self.chunk_ids.now.update(zip(new, (b"".join(map(of, words)) for words in split)))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        pieces = [[t] if self.cut is None or not self.cut.search(t) else self.cut.split(t) for t in texts]
        split = [[None if p in self.special else p.split() for p in own] for own in pieces]
        chunks = set().union(*(c for own in split for c in own if c))
        self.learn(chunks)
        of = self.chunk_ids.now.__getitem__
        out = []
        for own, cut in zip(pieces, split):
            out.append(b"".join(self.special[p].to_bytes(4, "little") if c is None else b"".join(map(of, c)) for p, c in zip(own, cut)))
        for c in chunks:
            if len(c) > CACHED_BYTES:
                self.chunk_ids.now.pop(c, None)
        self.word_ids.turn()
        self.chunk_ids.turn()
        return out

    def forget(self) -> None:
        self.word_ids, self.chunk_ids = Generations(), Generations()

    def encode_raw(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return ids_of(self.encode_raw((text or "").encode("utf-8", "replace")))

    def decode(self, ids) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


_LOADED: dict[str, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    """One encoder per worker process and vocabulary, kept between tasks (without its caches)."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def vocabulary(spark, path: str):
    """The vocabulary file, read by the driver and broadcast; its size is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(spec)} characters; at most {VOCABULARY_BYTES} are broadcast")
    return spark.sparkContext.broadcast(spec)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, as asked, the ids and the decoded
    text of every row."""
    d = pick(df, doc_id=id_col, text=text_col)
    spec = vocabulary(df.sparkSession, path)
    kind = d.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if keep_text:
        fields.append(T.StructField("decoded", T.StringType()))

    def encoded(bpe: WordBpe, ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        got = bpe.encode_all(texts)
        sizes = np.array([len(g) // 4 for g in got], np.int64)
        decoded = [bpe.decode(ids_of(g)) for g in got] if keep_text else (bpe.decode(ids_of(g)) for g in got)
        cols = [ids, pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
        if keep_ids:  # as one buffer: no Python number per token
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))))
        if keep_text:
            cols.append(pa.array(decoded, pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    def run(batches):
        bpe = loaded(spec.value)
        try:
            for batch in batches:
                at = 0
                for own in portions([t or b"" for t in raw_bytes(batch, "text")]):
                    yield encoded(bpe, batch.column("doc_id").slice(at, len(own)), own)
                    at += len(own)
        finally:
            bpe.forget()  # a worker lives on, with other work that needs the memory

    return d.mapInArrow(run, T.StructType(fields))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_word_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(ready(spark), sf_dir, "documents"), default_path(), keep_ids=False, keep_text=False)
