"""Small documents with every odd case, and helpers of the tests beside."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, drop string"


def words(seed: int, n: int, stem: str = "w") -> str:
    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(4000)}" for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text): nulls, empties, ties, repeats, near copies, one very long text."""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for k in range(0, 120, 12):
        far[k] = f"other{k}"
    out = [(1, base), (2, " ".join(near)), (3, " ".join(far)), (4, base), (5, None), (6, ""), (7, "   \n\t "), (8, "one two"), (9, "One  TWO"), (10, words(2, 40_000)), (11, "12345 !!"), (12, words(3, 300) + "\n" + base[:300]), (None, "lost text here now then"), (13, "x" * 70_000)]
    for k in range(40):
        out.append((100 + k, f"Shared header line for everyone number{k % 2}\n" + words(50 + k, 30, "abc"[k % 3]) + f"\nthe closing line that all of these documents have{'!' * (k % 3)}"))
    return out


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    full = [(i, t, ["en", "fr", None][(i or 0) % 3], "s", len(t or ""), "a", "b") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def table(spark, tmp_path, rows=None, **more):
    """A folder of tables as queries read them."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name, df in more.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
