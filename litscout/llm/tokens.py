"""Token counts by a digest cache (operator 8), and the tokenizer that operators 3 and 8 share.

``encoder(path)`` gives exactly the library's ids. For the word vocabulary white space is dropped and
nothing is merged across it, so a text is split at white space and only words not met before go to the
library. Texts of plain letters, digits and marks are split into letters, digits and marks, as the library's
splitter does it, which leaves fewer different words; many such texts are split at once, their different words
are looked up once, and a word not met before goes to the library's merges alone. A worker keeps what it met
and starts anew beyond a fixed number of words. Texts in
which that does not hold (special strings, U+001C to U+001F) go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import SPACE_RUN, table, text_of, worker_memo

MOST_WORDS = 900_000
#: Texts encoded in one call.
AT_ONCE = 512
#: Texts of letters without normal forms or odd lower case, digits, marks but the apostrophe, and white space;
#: and how the library's splitter parts such a text once it is in lower case: runs of letters, single digits, runs of marks.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9 \t-\r\x85\xa0!-&(-/:-@\[-`{-~]*")
DROPPED, LETTER, MARK, DIGIT, TEXT_END = range(5)
KINDS = np.zeros(256, np.uint8)
for _kind, _these in ((LETTER, "[a-zß-öø-ÿ]"), (DIGIT, "[0-9]"), (MARK, r"[!-&(-/:-@\[-`{-~]"), (TEXT_END, r"\0")):
    KINDS[[i for i in range(256) if re.match(_these, chr(i))]] = _kind
#: U+001C to U+001F split words for Python but not for the library; "<|" may begin a special string.
UNEVEN = re.compile(r"[\x1c-\x1f]|<\|")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text), as little-endian unsigned 32-bit numbers, as the library for the file gives them, without added special tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.whole = lambda text: model.encode(text, add_special_tokens=False).ids
            self.by_word = splits_at_space(path)
            if self.by_word:
                self.merge = model.model.tokenize
                # the letters that the splitter writes a character's bytes as
                self.written = {c: model.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in np.flatnonzero(KINDS).tolist() if KINDS[c] != TEXT_END}
        self.path = path

    @property
    def known(self) -> dict[str | bytes, bytes]:
        """The ids of words: bytes (Latin-1) are those of plain texts."""
        return worker_memo(f"ids {self.path}")

    def _look_up(self, words: list, learn) -> list[bytes]:
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) + found.count(None) > MOST_WORDS:
                known.clear()
            for i, word in enumerate(words):
                if found[i] is None:
                    if (ids := known.get(word)) is None:
                        ids = known[word] = learn(word)
                    found[i] = ids
        return found

    def _merged(self, word: bytes) -> bytes:
        """The ids of one word of a plain text; the end of a text has none."""
        if word == b"\0":
            return b""
        return array("I", [t.id for t in self.merge(word.decode("latin-1").translate(self.written))]).tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are plain: their words are found, numbered and replaced by ids in one array for all."""
        letters = np.frombuffer("\0".join([*texts, ""]).lower().encode("latin-1"), np.uint8)
        kinds = KINDS[letters]
        starts = (kinds >= DIGIT) | (np.diff(kinds, prepend=np.uint8(DROPPED)) != 0)
        there = kinds != DROPPED
        letters, starts = letters[there], np.flatnonzero(starts[there])
        offsets = np.append(starts, len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        raw = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self._merged)
        sizes, word = np.fromiter(map(len, raw), np.int64, len(raw)) // 4, words.indices.to_numpy()
        first, n = np.cumsum(sizes) - sizes, sizes[word]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(first[word] - upto + n, n) + np.arange(n.sum())].tobytes()
        ends = (4 * upto[letters[starts] == 0]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, text: str) -> bytes:
        if not self.by_word or UNEVEN.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        return b"".join(self._look_up(text.split(), lambda word: np.array(self.whole(word), "<u4").tobytes()))

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [self.by_word and "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        found = iter(self._plain([t for t, p in zip(texts, plain) if p])) if any(plain) else iter(())
        return [next(found) if p else self._ids(t) for t, p in zip(texts, plain)]

    def ids(self, text: str) -> bytes:
        return self.all([text])[0]

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


def splits_at_space(path: str) -> bool:
    """Whether the vocabulary's normalizer makes white space runs one space and its splitter drops spaces."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return '"\\\\s+"' in json.dumps(spec.get("normalizer")) and spec["model"].get("end_of_word_suffix") == "</w>"


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def version_of(path: str) -> str:
    """A digest of the tokenizer's file: counts of another version are never reused."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The content that the cache is keyed by and that is encoded: as far as the vocabulary's own normaliser treats texts alike.

    Vocabularies that make white space runs one space and drop spaces give a text and the same with single spaces
    equal ids; for all others nothing is changed.
    """
    return F.regexp_replace(text, SPACE_RUN, " ") if path.endswith(".json") and splits_at_space(path) else text


def content_digest(text: Column, version: str) -> Column:
    """SHA-256 of the tokenizer version and the normalised content."""
    return F.unhex(F.sha2(F.concat(F.lit(version + "\n"), text), 256))


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).all
        for batch in batches:
            texts = batch.column("text")
            n = pa.array([len(x) // 4 for a in range(0, len(texts), AT_ONCE) for x in ids(texts.slice(a, AT_ONCE).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), n], names=["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    ``cache`` is a folder of Parquet files (digest, n_tokens) in storage that all executors share; the
    distinct texts whose digest it lacks are encoded once and appended to it. By default a new one is made
    below the shared folder. Copies are combined before the shuffle. Null text counts as empty; repeated
    rows and null ids are rows like others, ties do not arise; very long texts are encoded whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path, cache = tokenizer_file(tokenizer), cache or shared_dir(spark)
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(text, path).alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    keyed = keyed.withColumn("digest", content_digest(F.col("text"), version_of(path)))
    schema = "digest binary, n_tokens bigint"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # so that it can be read
    known = spark.read.schema(schema).parquet(cache)
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    missing = distinct.join(known.select("digest"), "digest", "left_anti")
    missing.select("digest", "text").mapInArrow(_counter(path), schema).write.mode("append").parquet(cache)
    known = spark.read.schema(schema).parquet(cache).dropDuplicates(["digest"])
    out = keyed.select("doc_id", "n_bytes", "digest").join(known, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
