"""BPE encoding and decoding through a table of distinct words.

A word is what lies between white space. The vocabulary's normaliser and its split never reach
across white space, so a text's ids are its words' ids in order. Tasks split blocks of documents
into words and send each block's distinct words, dealt into hash buckets; a bucket sees every
occurrence of its words in the corpus and encodes each distinct word once; the ids go back to
the block and are put in place by position. Only distinct words per block and three bytes per
position are shuffled, and no task holds more than one block or one bucket's distinct words.

Defined results: null text counts as empty and has no ids; repeated rows each get their ids.
Ids are packed as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import shuffle_partitions, table

# Unicode's white space, which is what the vocabulary's normaliser folds to a space.
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
FOLDS = re.compile("[^\x00-\xff]")  # beyond these, lower-casing a text at once may differ from folding each character
ODD = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, Unicode doesn't
BUCKETS = 1024

_tokenizers: dict = {}
_packed: dict[str, list[bytes]] = {}


def tokenizer(path: str):
    """The vocabulary file, loaded once per worker, without truncation or padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii() or not FOLDS.search(text):
        text = text if "<|" in text else text.lower()  # the normaliser's own case folding, here per character
    return [w for w in WHITE.split(text) if w] if ODD.search(text) else text.split()


# Lower-case Latin letters that no normaliser changes, and ASCII punctuation but apostrophes behind them: the vocabulary splits
# between the two, so the ids are those of the letters, which go to the merges directly, and those of what is behind.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + rest.index(b)) for b in range(256)}


_LETTERS = _byte_letters()


def word_packer(path: str):
    """A function from a word to its ids, as little-endian unsigned 32-bit integers. It asks `known`, which takes a word
    and gives its ids so, for the parts of a word with punctuation behind it."""
    t = tokenizer(path)
    if path not in _packed:
        _packed[path] = [i.to_bytes(4, "little") for i in range(t.get_vocab_size(with_added_tokens=True))]
    merge, encode, packed, whole = t.model.tokenize, t.encode, _packed[path], PLAIN.fullmatch

    def pack(word: str, known) -> bytes:
        if not (word.isascii() and word.isalpha() and word.islower()):
            m = whole(word)
            if m is None:
                return b"".join([packed[i] for i in encode(word, add_special_tokens=False).ids])
            if m[2]:
                return known(m[1]) + known(m[2])
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_LETTERS)
        return b"".join([packed[x.id] for x in merge(word)])

    return pack


class Packed(dict):
    """word -> its ids, packed, of every word that was asked for; `older` is a table of words to look in first."""

    def __init__(self, path: str, older: dict[str, bytes] | None = None):
        super().__init__()
        self.pack, self.older = word_packer(path), older or {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.pack(word, self.__getitem__)
        self[word] = got
        return got


def encode_words(path: str, words: list[str]) -> list[np.ndarray]:
    """The ids of each word, as uint32."""
    return [np.frombuffer(x, "<u4") for x in map(Packed(path).__getitem__, words)]


def text_chunks(batches: Iterable[pa.RecordBatch], max_chars: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the batches' rows, cut where the texts grow past max_chars."""
    for b in batches:
        ids, texts, n = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            texts.append(s := t.as_py())
            n += len(s or "")
            if n >= max_chars:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts


class _Numbers(dict):
    """Numbers words in the order they come up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterable[pa.RecordBatch], buckets: int, max_chars: int):
    """Per block: its id, its rows' ids, its words by bucket, each row's word positions. The id is
    a digest of the block's words in order, so it names the same table wherever it is made."""
    for ids, texts in text_chunks(batches, max_chars):
        seen = _Numbers()
        rows = []
        for t in texts:
            words = words_of(t)
            rows.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
        by: list[list[str]] = [[] for _ in range(buckets)]
        for w in seen:
            by[xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % buckets].append(w)
        place, n, digest = np.empty(len(seen), np.uint32), 0, xxhash.xxh3_64()
        for part in by:
            part.sort()
            place[[seen[w] for w in part]] = np.arange(n, n + len(part), dtype=np.uint32)
            n += len(part)
            digest.update((" ".join(part) + "\n").encode("utf-8", "surrogatepass"))
        yield digest.intdigest() >> 1, ids, by, (place[r] for r in rows)


_ROW = "block long, kind int, bucket int, doc_id long, lo binary, hi binary"


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "doc_id": pa.int64(), "lo": pa.binary(), "hi": pa.binary(), "words": pa.string(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], list(columns))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, max_chars: int = 24_000_000) -> DataFrame:
    """(key, text) -> (key, ids binary). Both branches below read the same rows in the same
    partitions; a block whose words and positions disagree raises instead of mixing up ids."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def words(batches):
        for block, _, by, _ in _blocks(batches, buckets, max_chars):
            full = [(b, w) for b, w in enumerate(by) if w]
            yield _rows(block=[block] * len(full), bucket=[b for b, _ in full], words=[" ".join(w) for _, w in full])

    def positions(batches):
        for block, ids, _, rows in _blocks(batches, buckets, max_chars):
            n, packed = len(ids), [(p.astype("<u2").tobytes(), (p >> 16).astype("u1").tobytes()) for p in rows]
            yield _rows(block=[block] * n, kind=[1] * n, bucket=[0] * n, doc_id=ids, lo=[p[0] for p in packed], hi=[p[1] for p in packed])

    def encoded(batches):
        known, now = None, None
        for b in batches:
            out: dict[str, list] = {"block": [], "kind": [], "bucket": [], "doc_id": [], "lo": [], "hi": []}
            for block, bucket, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    known, now = Packed(path), bucket
                got = [known[w] for w in line.split(" ")]
                out["block"].append(block)
                out["kind"].append(0)
                out["bucket"].append(bucket)
                out["doc_id"].append(None)
                out["lo"].append(b"".join(got))
                out["hi"].append(np.array([len(x) // 4 for x in got], "<u4").tobytes())
            yield _rows(**out)

    def placed(batches):
        now, last, ids, sizes, start, size, flat = None, None, [], [], None, None, None
        for b in batches:
            names, packed, size_now = [], [], 0
            for block, kind, bucket, doc_id, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    now, last, ids, sizes, start = block, None, [], [], None
                if kind == 0:
                    if bucket == last:  # the same words from another block
                        continue
                    last = bucket
                    ids.append(np.frombuffer(lo, "<u4"))
                    sizes.append(np.frombuffer(hi, "<u4"))
                    continue
                if start is None:
                    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
                    size = (np.concatenate(sizes) if sizes else np.empty(0, np.uint32)).astype(np.int64)
                    start = np.cumsum(size) - size
                    ids, sizes = [], []
                at = np.frombuffer(lo, "<u2").astype(np.int64) | (np.frombuffer(hi, "u1").astype(np.int64) << 16)
                if len(at) and at.max() >= len(size):
                    raise ValueError("a block's words and positions do not belong together")
                n = size[at]
                ends = np.cumsum(n)
                pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)
                names.append(doc_id)
                packed.append(flat[pick].astype("<u4").tobytes())
                size_now += len(packed[-1])
                if size_now > 8_000_000:
                    yield _rows(doc_id=names, ids=packed)
                    names, packed, size_now = [], [], 0
            if names:
                yield _rows(doc_id=names, ids=packed)

    table_ = src.mapInArrow(words, "block long, bucket int, words string").repartition(parts, "bucket").sortWithinPartitions("bucket")
    both = table_.mapInArrow(encoded, _ROW).unionByName(src.mapInArrow(positions, _ROW))
    out = both.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(placed, "doc_id long, ids binary")
    return out.select(F.col("doc_id").alias(key), "ids")


def pieces(path: str) -> list[str]:
    """The id-to-piece table of a vocabulary; its size is the vocabulary's."""
    t = tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids: the pieces of the id-to-piece table joined by a space, which is
    what decoding gives for a vocabulary without a decoder. The table (one row an id) is sent to
    every task, so this is a map-side join on the id."""
    if tokenizer(path).decoder is not None:
        raise ValueError("this vocabulary has a decoder of its own")
    sent = df.sparkSession.sparkContext.broadcast(pieces(path))
    at, schema = df.columns.index(ids), StructType([*df.schema.fields, StructField(out, StringType())])

    def joined(batches):
        known = np.array(sent.value, object)
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                texts = [None if x is None else " ".join(known[np.frombuffer(x, "<u4")].tolist()) for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(joined, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    ids = encode(table(spark, sf_dir, "documents"), path)
    out = decode(ids, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
