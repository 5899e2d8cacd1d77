"""Words, token sequences, mentions, patterns, parts and readings on small written-down cases."""

import re

import pytest

from askweave.functions.patterns import Annotated, action, compiled, directed, find, first, whole
from askweave.functions.reading import Flags, first_and_last, flags_of, linking_column, read, same_columns
from askweave.functions.schema_words import BASE, COMPOUND, EXACT, PART, Mention, SchemaWords, name_words, spelled_like, suffix_toggled
from askweave.functions.segments import correct_values, edit_distance, homes, numbered, parts_of, rewritten
from askweave.functions.sqltext import sql_tokens
from askweave.functions.tokens import LEMMA, STEM, TAG, Token, Tokens
from askweave.functions.words import aliases, column_words_of, degree, direction, is_long_number, is_negative, lemma, number_of, stem
from askweave.plans.question_queries import PLAIN
from askweave.sources.catalog import Catalog
from tests.test_language import STAR

WORDS = SchemaWords(Catalog(STAR.tables, STAR.primary, STAR.foreign, {f"{t}.{c}": PLAIN.get(b, b) for t, cs in STAR.tables.items() for c in cs for b in [re.sub(r"^[a-z]+_", "", c)]}))


def annotate(q):
    t = Tokens.read(rewritten(q))
    return Annotated(t, tuple(WORDS.mentions(t)))


def test_words():
    assert [lemma(w) for w in "Cities boxes is had children buses glasses status largest hotter as".split()] == "city box be have child bus glass status large hot as".split()
    assert [stem(w) for w in "running runs presumably multiplied happiness May oldest ünder".split()] == ["run", "run", "presum", "multiply", "happy", "may", "old", "ünder"]
    assert degree("Largest") == ("JJS", "large") and degree("worse") == ("JJR", "bad") and degree("table") is None
    assert direction("young", ["age"]) == -1 and direction("young", ["birth", "date"]) == 1 and direction("young", ["price"]) == 0
    assert ("weight", 1) in column_words_of("heavy")
    assert aliases("US")[0] == "united states of america" and aliases("nowhere") == []
    assert is_negative("-3") and not is_negative("3") and is_long_number("12345") and is_long_number("9999") and not is_long_number("1999")
    assert number_of("Three") == "3" and number_of("many") == "many"


def test_token_sequences():
    t = Tokens.read("Show the running costs of 'Big Ones' and the largest city, please")
    assert t.find(Tokens.words("largest city")) == 8 and t.find(Tokens.words("big city"), by=LEMMA) == -1 and t.find(Tokens.words("large cities"), by=LEMMA) == 8
    assert t.find(Tokens.words("cost"), by=STEM) == 3 and t.match_at(4, Tokens.words("of")) and t.find(Tokens()) == -1
    assert t.part("largest city").text() == "largest city" and t.part("no such") == ()
    assert t[1:3].joined(t[:1]).text() == "the running Show" and t.updated(0, Token.of("List"))[0].text == "List"
    assert [x.text() for x in t.split("the")] == ["Show", "running costs of 'Big Ones' and the largest city , please"] and len(t.split("the", once=False)) == 3
    assert "the" not in t.without_stop_words().text() and "," not in t.without_punctuation().text() and t.count("THE") == 2
    assert t.without("cost").count("costs") == 0 and t.replaced("city", "town").part("town") and t.lemmas(keep_degrees=True).split()[8 + 1] == "largest"
    assert t.without_suffixes()[2].lemma == "runn" and t[5].key(TAG) == "DB"
    assert Tokens(Token.of(w) for w in "a ' b c ' d".split()).in_quotes(2) and not Tokens(Token.of(w) for w in "a ' b c ' d".split()).in_quotes(5)
    assert list(t[:3].runs(2)) == [(0, 2), (1, 3), (0, 1), (1, 2), (2, 3)]


def test_mentions_by_tier():
    found = {(m.table, m.column): m.tier for m in annotate("Show the account balances and names of customers in each region").mentions}
    assert found["customer", "c_acctbal"] == BASE and found["region", ""] == EXACT and ("supplier", "s_acctbal") not in found and ("nation", "n_name") not in found
    compound = SchemaWords(Catalog({"line_item": {"first_name": "string", "birthdate": "date"}}))
    t = Tokens.read("the fname and birth date of a lineitem")
    assert {(m.column, m.tier) for m in compound.mentions(t)} == {("first_name", COMPOUND), ("birthdate", COMPOUND), ("", COMPOUND)}
    assert WORDS.equal(Tokens.words("balance account"))[0] == BASE and WORDS.containing("balance", "supplier") == [("supplier", "s_acctbal")]
    assert WORDS.without_aggregate(Tokens.words("average of account balance"), "customer") == ("avg", [("customer", "c_acctbal")])
    assert WORDS.shared_noun(["max", "min age"]) == ["max age", "min age"] and WORDS.table_of(Tokens.words("suppliers")) == ["supplier"]
    assert WORDS.resolve(Tokens.words("name"), ["part"]) == [("part", "p_name")] and WORDS.by_adjective("cheap", ["part"])[0] == (("part", "p_retailprice"), -1)
    assert WORDS.of_structure(t, []) == [] and name_words("firstName_x").text() == "first name x" and suffix_toggled("ship") == [""] and suffix_toggled("relation") == ["relationment", "relationship"]
    assert spelled_like(Tokens.read("all custmers and pats"), [*WORDS.tables.values()]).text() == "all customers and pats"
    assert WORDS.mentions(Tokens.read("")) == [] and SchemaWords(Catalog({})).mentions(Tokens.read("any part")) == []
    many = [Mention(0, 1, "part", "p_name", EXACT), Mention(1, 2, "part", "p_size", PART)]
    assert WORDS.tables_of(many) == ["part"] and WORDS.columns_from_tables(many) == "part" and WORDS.tables_near([many, [], []], 2) == ["part"]


@pytest.mark.parametrize(
    "pattern, question, places",
    [
        ("GR NUM", "parts with size over 10", [(3, 5, False)]),
        ("have TABLE", "parts that have no supplier", [(2, 5, True)]),
        ("COL of TABLE", "the retail prices of parts", [(1, 5, False)]),
        ("+ which TABLE", "show which part", []),
        ("$the COL of", "size of parts and the size of parts", [(0, 2, False), (4, 7, False)]),
        ("-the COL", "the size or size", [(2, 4, False)]),
        ("NO#the COL", "the size or size", [(3, 4, False)]),
        ("with/of COL", "parts with size", [(1, 3, False)]),
        ("@ 2&NUM", "sizes 3 and 4", [(3, 4, False)]),
        ("? *", "of stuff", [(0, 2, False)]),
        ("PCOL", "the part and its size", [(4, 5, False)]),
    ],
)
def test_patterns(pattern, question, places):
    a = annotate(question)
    a = Annotated(a.tokens, a.mentions, tuple(m.table for m in a.mentions if not m.column))
    assert [(f.start, f.end, f.negated) for p in compiled(pattern) for f in find(p, a)] == places


def test_actions_and_directions():
    assert action(annotate("for each nation"))[0] == "group" and action(annotate("sorted by size"))[0] == "order" and action(annotate("hm"))[0] == "nothing"
    assert first("NUM | DB", annotate("size 3 of 'x'")).start == 1 and whole("size NUM", annotate("size 3 .")).end == 2 and whole("size", annotate("size 3")) is None
    assert directed(annotate("the cheapest part by retail price"))[1] == "SM_JJS" and directed(annotate("the highest size"))[1] == "GR_JJS"


def test_rewriting_and_values():
    assert rewritten("How many x, and at least one y from 3 to 5, 'how many'") == "number of x and any y between 3 and 5, 'how many'"
    assert [edit_distance(a, b, 2) for a, b in (("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("a", "abcd"))] == [1, 1, 3, 3]
    values = {"France": [("nation", "n_name")], "M": [("p", "sex")], "2020-05-03": [("p", "born")], "Middle East": [("region", "r_name")]}
    t, at = correct_values(Tokens.read("male people of Frence born May 3 2020 in 'Midle East'"), values)
    assert set(at.values()) == {"France", "M", "2020-05-03", "Middle East"} and "'Middle East'" in t.text() and t[3].text == "France"
    assert homes({0: "a", 1: "b"}, {"a": [("t", "x"), ("u", "y")], "b": [("u", "z")]}) == {0: [("u", "y")], 1: [("u", "z")]}


def test_parts_and_readings():
    a = annotate("Show the highest and lowest account balance of customers for each nation.")
    parts, r = read(a, WORDS)
    assert [p.kind for p in parts] == ["select", "group"] and numbered(parts) == [0, -1] and [s.agg for s in r.select] == ["", "max", "min"]
    assert parts_of(Annotated(Tokens())) == [] and numbered([]) == []
    assert flags_of(annotate("the top 3 parts by size")) == Flags(False, True, True, 3) and flags_of(annotate("size over 3")).where
    assert first_and_last(annotate("first birthdate"), SchemaWords(Catalog({"t": {"birthdate": "date"}})), ("t", "birthdate")) == "earliest" and first_and_last(annotate("last size"), WORDS, ("part", "p_size")) == "last"
    assert linking_column(WORDS, "customer", "nation") == ("customer", "c_nationkey") and linking_column(WORDS, "part", "nation") is None
    assert ("customer", "c_nationkey") in same_columns(WORDS, ("nation", "n_nationkey"))
    for question in ("", "?", "and or but", "each", "with with 3", "'", "by by by the"):
        read(annotate(question), WORDS)


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("select person.age from person where personfriend.name = 'Zach' and @.@ = max ( personfriend.year ) and personfriend.name = 'Zach'", 19),
        ("select sum ( order_items.order_quantity ) from customers where customers.customer_name = 'Rodrick Heaney'", 11),
    ],
)
def test_shorthand_tokens(text, tokens):
    assert len(sql_tokens(text)) == tokens and " ".join(sql_tokens(text)) == text
