import hashlib
import zlib
from collections import defaultdict

import numpy as np
from . import rows as R

from assay.llm import bpe, packing

ODD = ["Ünïcode ßtraße İstanbul ΣΑΣ", "<|endoftext|> in <|STARTOFTEXT|>x<|startoftext|>", "don't we'LL it's 'S", "tab\tnew\nline\x1cfile\x85nel\u2003em\u200bzero", "日本語 テキスト 한국어", "a" * 3000, "..,, !? word. word, .word", "e\u0301 combining \u0301 alone"]


def _texts():
    return R.documents() + [(500 + k, t) for k, t in enumerate(ODD)]


def _want():
    t = bpe.tokenizer(bpe.vocabulary())
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in _texts()]


def test_ids_and_text_equal_the_library(spark, tmp_path):
    t = bpe.tokenizer(bpe.vocabulary())
    got = sorted(map(tuple, bpe.op3_bpe(spark, R.table(spark, tmp_path, _texts())).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.decode(x, skip_special_tokens=False).encode())) for i, x in _want()]
    assert got == sorted(want, key=str)


def test_small_blocks_give_the_same(spark):
    docs = R.frame(spark, _texts())
    a = sorted(map(str, bpe.encode(docs, bpe.vocabulary()).collect()))
    assert a == sorted(map(str, bpe.encode(docs, bpe.vocabulary(), buckets=7, max_chars=500).collect()))


def test_packing(spark, tmp_path):
    got = packing.op5_packing(spark, R.table(spark, tmp_path, [x for x in _texts() if x[0] is not None])).collect()
    ids = {i: np.array([*x, 1], "<u4") for i, x in _want()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole)
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    assert set(pieces) == set(ids) - {None}
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, n, tier in sorted(s):
            assert offset == at
            at += n
        assert at == tier and at & (at - 1) == 0 and at <= 2048  # full: nothing is padded


def test_empty(spark, tmp_path):
    d = R.table(spark, tmp_path, [])
    assert bpe.op3_bpe(spark, d).count() == 0 and packing.op5_packing(spark, d).count() == 0


def test_words_kept_by_a_packing_worker_are_bounded():
    words = [f"w{k}" for k in range(200_000)]
    encoder = packing.Encoder(bpe.vocabulary())
    for at in range(0, len(words), 20_000):
        encoder([" ".join(words[at : at + 20_000])])
        assert len(encoder.known) <= 150_000


def test_frequent_words_stay_and_ends_are_as_the_library_has_them():
    packing._known.clear()  # a worker's encoders share it
    path = bpe.vocabulary()
    t, encoder = bpe.tokenizer(path), packing.Encoder(path, most=4000)
    letters, last = "abcdefghijklmnopqrstuvwxyzßäöüéèêíóñ", set()
    name = lambda k: letters[k % 36] + letters[k // 36 % 36] + letters[k // 1296 % 36] + "tion"
    ends = ["", ".", ",", "!!", "$$$", "&&&,", ".%%%", "'", "'s", "^`", "<|", "((_))", "\\", "@x.y", "-z", "...", "’", "́"]
    for at in range(0, 20_000, 500):
        words = [name(k) + ends[k % len(ends)] for k in range(at, at + 500)] + [e for e in ends if e]
        (got,) = encoder([" ".join(words)])
        assert got.tolist() == t.encode(" ".join(words), add_special_tokens=False).ids
        assert last <= encoder.known.keys()  # what was asked last is there, however full the table was
        assert len(encoder.known) <= 4000
        last = set(words[:400])
    assert [x.tolist() for x in bpe.encode_words(path, words)] == [t.encode(w, add_special_tokens=False).ids for w in words]
