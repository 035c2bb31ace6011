"""Operator 2: language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled texts, and that
into cuts of ``CUT`` bytes. A text is divided into equal blocks of at most ``BLOCK`` bytes;
block j is encoded with cut j of every language, and texts under ``ENCODED`` bytes go on
with further cuts until about ``ENCODED`` bytes (or every cut) have been encoded, so that the
sum is fine enough for a text of a few words. Each encoding starts from the fresh dictionary,
behind ``CONTEXT`` bytes of the language whose own size is taken off: matches are then worth
their bits, not the overhead of a frame. The language with the smallest sum wins (ties: the
first by name). If the runner-up's sum is less than ``MARGIN`` larger, relatively, the row is
marked ``rejected``; the prediction stays. One rule holds for all lengths: texts under about
ten bytes hold too little for it and are mostly rejected.

Learning reads a bounded sample: of each language the ``SAMPLE_TEXTS`` texts with the
smallest hash of their content, of each an equal part of ``DICTIONARY_BYTES`` (more where a
language has fewer texts): one stretch that begins at a place chosen by the hash, so that
shared openings do not fill a dictionary. Copies count once and the dictionary has a known
size. Predictions use the text alone.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected;
without any labelled row everything is ``und``; more than ``LANGUAGES`` languages raise
``ValueError``; very long texts are read whole, block by block; other columns, also of
clashing names, are ignored; a single learned language always wins
with score 1; rows with a null lang are predicted but not learned from; rows with a null
id are not learned from and not held out; repeated rows are predicted alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, pick, raw_bytes, table

DICTIONARY_BYTES = 256 << 10
SAMPLE_TEXTS = 512          # per language
CUT = 4 << 10
CONTEXT = 16
BLOCK = 2 << 10
ENCODED = 2 << 10
MARGIN = 0.03               # relative difference of sizes under which a row is rejected
SHARPNESS = 30.0            # score = 1 - exp(-SHARPNESS * margin)
COMPRESSORS = 4096          # of one model: languages share them (each holds about 100 kB)
LANGUAGES = 512             # most languages one model may hold (a model is broadcast); more raise an error

ascii_letter = re.compile(rb"[A-Za-z]").search
has_letter = regex.compile(r"\p{L}").search


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, list[bytes]]:
    """{lang: texts} of the rows (text, lang) with the smallest content hashes.

    The number of different texts of a language (a sketch) sets the hash below which about
    1.5 x ``texts`` of them lie; only those rows are grouped and brought to the driver."""
    rows = (labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
            .select("lang", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")))
    different = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(LANGUAGES + 1).collect()
    if len(different) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not different:
        return {}
    below, room = F.lit(False), F.lit(0)
    for r in different:
        # the sketch may count a few texts too many or too few: ``dictionaries`` cuts at the size
        room = F.when(F.col("lang") == r.lang, F.lit(max(1, size // max(1, min(texts, r.n))))).otherwise(room)
        share = min(1.0, 1.5 * texts / max(1, r.n))
        below = below | ((F.col("lang") == r.lang) & (F.col("h") <= min(2**63 - 1, int(-2**63 + share * 2**64))))
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.lit(0), F.length("text") - room) + 1).cast("int")
    rows = rows.filter(below).select("lang", "h", F.substring(F.col("text"), begin + 1, room).alias("text"))
    got: dict[str, list] = {}
    for r in rows.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
        got.setdefault(r.lang, []).append((r.h, bytes(r.text)))
    return {lang: [t for _, t in sorted(own)[:texts]] for lang, own in got.items()}


# everything but letters and the bytes of other scripts
between = re.compile(rb"[^a-z\x80-\xff]+").sub


def folded(text: bytes) -> bytes:
    """Lower case with one blank before, between and after words: they match wherever they
    stand, and digits and signs, which all languages share, take no part."""
    return between(b" ", b" " + text.decode("utf-8", "replace").lower().encode() + b" ")


# small tables for small inputs, three-byte matches
PARAMETERS = zstandard.ZstdCompressionParameters(window_log=15, chain_log=13, hash_log=12, search_log=3, min_match=3, target_length=24,
                                                 strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False)


def encoders(raw: bytes, most: int) -> list[tuple]:
    """(compress, context, size of the context alone) for the cuts of a dictionary."""
    n = max(1, min(most, len(raw) // CUT))
    out = []
    for j in range(n):
        cut = raw[j * len(raw) // n:(j + 1) * len(raw) // n]
        context, rest = cut[:CONTEXT], cut[CONTEXT:] if len(cut) > 4 * CONTEXT else cut
        d = zstandard.ZstdCompressionDict(rest, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=PARAMETERS)
        compress = zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMETERS).compress
        out.append((compress, context, len(compress(context))))
    return out


def block_plan(size: int, cuts: int) -> tuple[list[int], int]:
    """Bounds of a text's equal blocks, and how many times each of them is encoded."""
    n = -(-size // BLOCK)
    return [i * size // n for i in range(n + 1)], max(1, min(cuts // n, -(-ENCODED // size)))


class Model:
    """Encoders of each language, made once per worker."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.langs = [lang for lang, _ in dictionaries]
        most = max(1, min(DICTIONARY_BYTES // CUT, COMPRESSORS // max(1, len(dictionaries))))
        self.encoders = [encoders(raw, most) for _, raw in dictionaries]
        self.cuts = max(map(len, self.encoders), default=0)

    def sizes(self, text: bytes) -> list[int]:
        """The text's encoded size per language."""
        at, times = block_plan(len(text), self.cuts)
        parts = [text[a:b] for a, b in zip(at, at[1:])]
        out = []
        for own in self.encoders:
            total = 0
            for j in range(len(parts) * times):
                compress, context, alone = own[j % len(own)]
                total += len(compress(context + parts[j % len(parts)])) - alone
            out.append(total)
        return out

    def predict(self, text: bytes | None) -> tuple[str, float, float]:
        """(language, score, margin)"""
        if not self.langs or not text or not (ascii_letter(text) or has_letter(text.decode("utf-8", "replace"))):
            return "und", 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        sizes = self.sizes(folded(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(1, second)
        return self.langs[best], 1.0 - math.exp(-SHARPNESS * max(0.0, margin)), margin


def dictionaries(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary) of each language, by name."""
    return [(lang, b"".join(folded(t.decode("utf-8", "ignore").encode()) for t in texts)[:DICTIONARY_BYTES]) for lang, texts in sorted(sample(labelled).items())]


def identify(d: DataFrame, model: list[tuple[str, bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The columns of ``d`` without the text, plus lang_pred, score and rejected."""
    spec = d.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES x DICTIONARY_BYTES
    kept = [c for c in d.columns if c != text]
    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()),
                          T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        own = Model(spec.value)
        for b in batches:
            got = [own.predict(t) for t in raw_bytes(b, text)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                               pa.array([g[2] < margin for g in got], pa.bool_())], names=schema.names)

    return d.mapInArrow(run, schema)


def learned(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Dictionaries from the rows of ``docs`` outside the held-out third."""
    d = pick(docs, doc_id="doc_id", text="text", lang="lang")
    train = d.filter(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    return dictionaries(train.select("text", "lang"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = pick(docs, doc_id="doc_id", text="text")
    d = d.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return identify(d, learned(docs))
