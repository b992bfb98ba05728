from foldwise.llm import line_dedup
from tests.llm.conftest import CLASHING, prose


def test_templates(odd):
    found = {r.row.doc_id: r for r in line_dedup.without_repeats(odd).collect() if r.row.doc_id in (11, 12)}
    assert found[11].n_dropped == 0  # the first document keeps the line
    assert found[12].n_dropped == 1 and "station" not in found[12].text and found[12].text.count("\n") == 1


def test_odd_rows(odd, empty):
    got = line_dedup.deduplicated(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    # The one line of document 10 differs from that of document 9 in one token.
    assert len(rows) == odd.count() - 1 and 10 not in {r.doc_id for r in rows}
    assert all(list(r[c] for c in CLASHING) == list(range(len(CLASHING))) for r in rows)
    assert next(r for r in rows if r.doc_id == 0).text is None
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert line_dedup.deduplicated(empty).count() == 0


def test_clean_lines_stay(spark):
    """Short lines and lines that only begin alike are not touched; a copy without anything of its own goes."""
    passage = prose(20, 60)
    rows = [
        (1, f"Yes, it is.\n{prose(21, 30)}\nthe same four tokens here {prose(22, 9)}"), (2, f"Yes, it is.\n{prose(23, 30)}\nthe same four tokens here {prose(24, 9)}"),
        (3, f"{prose(25, 40)}\n{passage}"), (4, f"{passage}\n{prose(26, 40)}"), (5, passage), (6, f"{passage}\n{passage}\n\nend of it all")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = dict(rows)
    assert got == {1: before[1], 2: before[2], 3: before[3], 4: prose(26, 40), 6: "\nend of it all"}


def test_values_that_recur(spark):
    """A field stays one where its values recur, in copied documents and beside another template of its leaf."""
    def line(station, day):
        return f"This page was made by station {station} of the old northern line on day {day} for all our readers"

    other = "This page was made by hand {} and printed twice for each and every one of the many friends"
    assert len(line(1, 1).split(" ")) == len(other.split(" "))
    made = [line(12, 3), line(57, 3), line(12, 3), line(57, 9), line(12, 9), line(80, 9), line(12, 3)] + [other.format(k % 3) for k in range(6)]
    rows = [(k, f"{prose(40 + k, 20)}\n{x}") for k, x in enumerate(made)]
    rows += [(100 + k, t) for k, t in rows]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if k in (0, 7) else prose(40 + k, 20) for k, t in rows if k < 100}
