import hashlib

import numpy as np
from . import rows as R

from assay.llm import fingerprints as FP


def test_against_brute_force(spark, tmp_path):
    docs = R.order([(i, t or "") for i, t in R.documents()])
    got = {r["doc_id"]: r for r in FP.op1_fingerprints(spark, R.table(spark, tmp_path)).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = (FP.chunk_digests(x) for x in (t, edited, after))
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert FP.parse(r["fingerprint"]) == a and FP.parse(r["edited_fingerprint"]) == b
        assert r["near_edited"] == FP.contained(a, b) and r["near_next"] == FP.contained(a, c)
    assert got[1]["fingerprint"] == got[4]["fingerprint"]


def test_chunks_cover_and_resist_shifts():
    text = R.words(9, 3000)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = FP.boundaries(points)
    assert ends[-1] == len(points) and all(0 < b - a <= FP.GREATEST for a, b in zip([0, *ends], ends))
    moved = FP.chunk_digests("a few words put before " + text)
    assert FP.contained(FP.chunk_digests(text), moved) > 0.95
    h = FP.gear_hash(points[:200])
    assert (h[100:] == FP.gear_hash(points[69:200])[31:]).all()  # only the last 32 code points count


def test_empty_table_and_one_row(spark, tmp_path):
    assert FP.op1_fingerprints(spark, R.table(spark, tmp_path / "a", [])).count() == 0
    r = FP.op1_fingerprints(spark, R.table(spark, tmp_path / "b", [(1, "abc " * 40)])).first()
    assert r["near_next"] == 1.0
    assert FP.fingerprint(R.frame(spark)).count() == len(R.documents())
