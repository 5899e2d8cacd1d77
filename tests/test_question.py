import pytest

from askweave.functions.question import filled, find_pattern, is_date, is_number, is_year, repaired, segments, tag_tokens, to_number, without_values


def test_numbers_and_dates():
    assert [to_number(x) for x in ("1,200", "-3", "2.5", "seven", "15%", "x")] == [1200, -3, 2.5, 7, 15, 0]
    assert is_number("1,200") and not is_number("1,20x") and is_date("2020-01-02") and not is_date("2020") and is_year("1999") and not is_year("3999")


def test_tags():
    tags = {t.text: t.tag for t in tag_tokens("Which of the 3 singers in 1999 have no 'Big Hit' , the highest average over 61.")}
    assert (tags["3"], tags["1999"], tags["no"], tags["'Big Hit'"], tags["highest"], tags["average"], tags["over"], tags["61"], tags["."], tags["singers"]) == ("NUM", "YEAR", "NOT", "DB", "JJS", "AGG", "GR", "NUM", "PUNCT", "")
    assert tag_tokens("") == []


def test_segments():
    assert segments("Show the name of suppliers whose balance is over 90 for each nation") == [("select", "Show the name of suppliers"), ("condition", "whose balance is over 90 for"), ("group", "each nation")]
    assert segments("") == []


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        ("GR than NUM", "more than 5 and less than 3", [(0, 3, False)]),
        ("GR than NUM", "more not than 7", [(0, 4, True)]),
        ("between NUM and NUM", "between 1 and 2", [(0, 4, False)]),
        ("$the top NUM", "top 5 or the top 6", [(0, 2, False), (3, 6, False)]),
        ("singer -who", "singers who sing or singers that sing", [(4, 6, False)]),
        ("* ?", "names of birds", [(0, 2, False)]),
        ("_ _ _", "one", []),
    ],
)
def test_patterns(pattern, text, want):
    assert find_pattern(pattern, tag_tokens(text)) == want


def test_repaired():
    assert repaired("the ‘custmoers’ of custmoers with at least one ordres", ["customers", "orders"]) == "the 'custmoers' of customers with any orders"


@pytest.mark.parametrize(
    "sql, question, want",
    [
        ("SELECT a FROM t WHERE b = 'x' AND c > 5", "a of t with b 'x y' and c over 61.", "SELECT a FROM t WHERE b = 'x y' AND c > 61"),
        ("SELECT a FROM t WHERE c BETWEEN 1 AND 2 AND d LIKE '%x%'", "between 9 and 7 with 'q' in d", "SELECT a FROM t WHERE c BETWEEN 7 AND 9 AND d LIKE '%q%'"),
        ("SELECT a FROM t WHERE d LIKE 'x%'", "d starting with 'q'", "SELECT a FROM t WHERE d LIKE 'q%'"),
        ("SELECT a FROM t ORDER BY b DESC LIMIT 3", "the top 7 a by b", "SELECT a FROM t ORDER BY b DESC LIMIT 7"),
        ("SELECT a FROM t WHERE b = 3", "nothing here", "SELECT a FROM t WHERE b = 'terminal'"),
    ],
)
def test_filled(sql, question, want):
    assert filled(without_values(sql), question) == want
