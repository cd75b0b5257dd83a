"""Citations with odd line numbers and excerpts, held against hand-written results."""

from assay.operators.checks import citation_check


def test_odd_citations(spark):
    text = "line one\n\tline two  \nlast"
    cited = [
        (1, "a.c", 0, 0, "anything", None),  # the whole file
        (2, "a.c", 2, 0, "line two", None),  # an end of 0 is the line of the start
        (3, "a.c", 2, 2, "  line two\n", None),
        (4, "a.c", 1, 1, "lin", "excerpt differs"),  # a part is not the line
        (5, "a.c", 3, 4, "", "lines outside"),
        (6, "a.c", 0, 2, "", "lines outside"),
        (7, "a.c", 2, 1, "", "lines outside"),
        (8, "..b/a.c", 1, 1, "", "escapes"),
        (9, "/a.c", 1, 1, "", "escapes"),
        (10, "b.c", 0, 0, "", "absent"),
        (11, "./a.c", 1, 3, text, None),
        (12, "a.c", 1, 1, None, None),
    ]
    c = spark.createDataFrame([x[:5] for x in cited], "case_id int, file string, start_line int, end_line int, excerpt string")
    files = spark.createDataFrame([(x[0], "a.c", text) for x in cited], "case_id int, path string, text string")
    got = {r["case_id"]: r["rule"] for r in citation_check(c, files).collect()}
    assert got == {x[0]: x[5] for x in cited if x[5]}


def test_many_citations_of_one_file(spark):
    """Ranges are cut out once each; null lines mean the whole file, a file without text is absent."""
    text = "\n".join(f"line {k}" for k in range(1, 201))
    rows = [(1, "a", k % 200 + 1, k % 200 + 1, f"line {k % 200 + 1 + (k % 7 == 0)}") for k in range(1000)] + [(1, "a", None, None, "x"), (1, "b", 1, 1, "x")]
    c = spark.createDataFrame(rows, "case_id int, file string, start_line int, end_line int, excerpt string")
    files = spark.createDataFrame([(1, "a", text), (1, "b", None)], "case_id int, path string, text string")
    got = [r["rule"] for r in citation_check(c, files).collect()]
    assert got.count("excerpt differs") == sum(k % 7 == 0 for k in range(1000)) and got.count("absent") == 1 and len(got) == got.count("excerpt differs") + 1
