from hypothesis import given, settings
from hypothesis import strategies as st

from filament.operators.packed import Grammar, split_packed

SPACED, BARE = Grammar(True), Grammar(False)


def values(text, g=SPACED):
    return [v for v, _ in g.parse(text)]


def test_separators_quotes_and_escapes():
    assert values("a b, c; d|e\nf，g；h、i||j") == ["a b", "c", "d", "e", "f", "g", "h", "i", "j"]
    assert values('"x, y", z') == ["x, y", "z"]
    assert values('"read ""R2"" absent, log", z') == ['read "R2" absent, log', "z"]
    assert values("'a, b'; lab's own, c") == ["a, b", "lab's own", "c"]
    assert values(r"a\, b, c\|d") == ["a, b", "c|d"]
    assert values('["a, b", "c \\"d\\""]') == ["a, b", 'c "d"']
    assert values("['a, b', \"lab's\"]") == ["a, b", "lab's"]
    assert values("group (x, y), z") == ["group (x, y)", "z"]
    assert values("a, , b,,a;") == ["a", "b", "a"]


def test_values_without_white_space():
    for text in ("/f/A/ /f/B/", "/f/A/,/f/B/", "['/f/A/', '/f/B/']", '"/f/A/, /f/B/"', " /f/A/ ;\r\n /f/B/;", "/f/A/\t/f/B/"):
        assert values(text, BARE) == ["/f/A/", "/f/B/"], text


def test_malformed_quotes_are_text_and_flagged():
    assert SPACED.parse('"a, b') == [('"a', True), ("b", False)]
    assert SPACED.parse("a (b, c") == [("a (b", True), ("c", False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab c'\"\\,;|()", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoting_round_trip(items):
    import json

    assert values(json.dumps(items)) == items
    plain = [x for x in items if "\\" not in x]
    if plain:
        assert values(", ".join('"' + x.replace('"', '""') + '"' for x in plain if not x.endswith('"') and '",' not in x and '";' not in x and '"|' not in x and '" ' not in x)) == [x for x in plain if not x.endswith('"') and '",' not in x and '";' not in x and '"|' not in x and '" ' not in x]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a '\"\\,;|()[]\n", max_size=40))
def test_any_text_is_read(text):
    for g in (SPACED, BARE):
        for v in values(text, g):
            assert v and v == v.strip()


def test_table(spark):
    schema = "row_id long, f string, w string, item_value string"
    df = spark.createDataFrame([(1, "A,B", "x y", "k"), (1, "A,B", None, "k"), (2, " ", "", None), (3, None, "p; q", None), (4, "A,", "one two", None)], schema)
    rows = sorted(tuple(r) for r in split_packed(df, "row_id", {"f": False, "w": True}, least=2).select("row_id", "field_name", "ordinal", "item_value").collect())
    assert rows == [(1, "f", 1, "A"), (1, "f", 1, "A"), (1, "f", 2, "B"), (1, "f", 2, "B"), (3, "w", 1, "p"), (3, "w", 2, "q")]
    assert split_packed(spark.createDataFrame([], schema), "row_id", {"f": False}).count() == 0
    assert split_packed(df, "row_id", {"f": False, "w": True}, least=1).where("row_id = 4").count() == 2


def test_long_text_in_linear_time():
    text = '"' + "a,b;" * 100_000
    assert len(values(text)) == 200_000
    assert len(values("(" * 100_000)) == 1
