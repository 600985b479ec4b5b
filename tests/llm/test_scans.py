from docketry.llm import scans
from docketry.session import materialise

SCHEMA = "node_id string, act string, title string, text string, p0 int, p1 int, line string, word string"
TITLE = "Rovakine Town Planning Act, 1980"
PLAIN = "The registrar may by general or special order exempt any section of this permit. Every tenant shall furnish returns to the family-court in a summary manner for the working of compensation."


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    marked = scans.lines(df, "node_id", "act", "title", "text", "p0", "p1")
    rows = materialise(scans.tokens(marked, printed=True))
    words = scans.repair(rows)
    out = {(r.record, "running_line", r.line) for r in marked.filter("running").collect()}
    out |= {(r.record, "broken_word", r.repaired) for r in words.filter("broken").collect()}
    return out | {(r.record, "misread_word", r.repaired) for r in words.filter("misread").collect()}, scans.paragraphs(marked, rows, words)


def clean(n=6):
    return [(f"clean{i}", "a", TITLE, PLAIN, 1, 2) for i in range(n)]


def test_damage(spark):
    text = (
        "The reg-\nistrar may by gen¬\neral or special order exempt any section of this perm!t. Every ten-\n\n- 5 -\n   ROVAK1NE TOWN PLANNING ACT, 1980  No. 31 of 1980\nant shall fumish returns to the family-\r\n"
        "court in a summ@ry manner for the\n5\x0cvvorking of com-\npcnsation.\n(2) Fee payable:\n750\n"
    )
    got, texts = found(spark, [*clean(), ("n", "a", TITLE, text, 4, 5)])
    assert {x[1:] for x in got if x[0] == "n"} == {
        ("broken_word", "registrar"), ("broken_word", "general"), ("broken_word", "tenant"), ("broken_word", "family-court"), ("broken_word", "compensation"),
        ("misread_word", "permit"), ("misread_word", "furnish"), ("misread_word", "summary"), ("misread_word", "working"), ("misread_word", "compensation"),
        ("running_line", "- 5 -"), ("running_line", "ROVAK1NE TOWN PLANNING ACT, 1980  No. 31 of 1980"), ("running_line", "5"),
    }
    assert not [x for x in got if x[0] != "n"]
    mine = [r.text for r in sorted(texts.filter("record = 'n'").collect(), key=lambda r: r.paragraph)]
    assert mine == [PLAIN, "(2) Fee payable: 750"]


def test_copies_of_a_damaged_text(spark):
    """A damaged text of many records counts once: its misread words are found, and are no form of sound words."""
    damaged = PLAIN.replace("furnish", "fumish").replace("registrar may", "registrar rnay")
    sound = [(f"sound{i}", "a", TITLE, f"{PLAIN} Part {i}.", 1, 2) for i in range(6)]
    got, _ = found(spark, [*sound, *[(f"copy{i:02d}", "a", TITLE, damaged, 1, 2) for i in range(40)]])
    assert got == {(f"copy{i:02d}", "misread_word", word) for i in range(40) for word in ("furnish", "may")}


def test_gazette_heads(spark):
    rows = [(f"g{i}", f"act{i}", f"Name{i} Ferries Act, 19{60 + i}", f"Every tenant shall furnish\nName{i} Gazette Extraordinary\nreturns to the family-court.", 1, 2) for i in range(4)]
    got, _ = found(spark, [*rows, *clean()])
    assert got == {(f"g{i}", "running_line", f"Name{i} Gazette Extraordinary") for i in range(4)}


def test_numbers_that_are_text(spark):
    """A number on a line of its own is the page's only if it is one of the record's pages."""
    rows = [("n", "a", TITLE, "returns to the family-court within\n12\nof this permit under section\n7.\nany section 12A of this permit", 3, 4), ("m", "a", TITLE, "any section\n4\nof this permit", None, None)]
    assert found(spark, [*rows, *clean()])[0] == set()


def test_nulls_empty_repeats(spark):
    rows = [("n", None, None, None, 1, 1), ("m", None, None, "", 1, 1), (None, "a", TITLE, "perm-\nit", 1, 1), ("r", "a", TITLE, "this perm-\nit.", 1, 1), ("r", "a", TITLE, "this perm-\nit.", 1, 1)]
    assert found(spark, [*rows, *clean()])[0] == {("r", "broken_word", "permit")}
    assert found(spark, [])[0] == set()


def test_very_long(spark):
    text = "\n".join(["Every tenant shall furnish returns to the family-", "court in a summary manner"] * 3000)
    assert found(spark, [("n", "a", TITLE, text, 1, 1), *clean()])[0] == {("n", "broken_word", "family-court")}
