"""Work for a question: only names it may mean are looked for, only what is wished of it is made, and nothing is moved after it."""

import random

from askweave.functions import segments
from askweave.functions.patterns import Annotated, action
from askweave.functions.reading import flags_of, read
from askweave.functions.schema_words import SchemaWords
from askweave.functions.segments import parts_and_actions, parts_of, rewritten, shapes
from askweave.functions.tokens import Tokens
from askweave.operators import annotation
from askweave.operators.linking import exact_matches
from askweave.plans import question_queries as queries
from askweave.plans.question_queries import FIXTURE
from askweave.sources.catalog import Catalog
from tests.test_words import WORDS


def test_only_names_with_a_word_of_the_question_are_looked_for(monkeypatch):
    words = SchemaWords(Catalog({f"t{i}": {f"first_{i}": "string", f"second_{i}": "string"} for i in range(200)} | {"city": {"full_name": "string", "size": "double", "_": "string"}}))
    looked, found = [], SchemaWords._found
    monkeypatch.setattr(SchemaWords, "_found", lambda self, tokens, name: (looked.append(name.text()), found(self, tokens, name))[1])
    mentions = words.mentions(Tokens.read("Show the size and fullname of the cities"))
    assert {(m.table, m.column) for m in mentions if m.size} == {("city", ""), ("city", "size"), ("city", "full_name")}
    assert len(looked) < 10  # it was one a name, 602 here


def test_names_that_are_near_are_all_that_are_mentioned():
    names = [w for x in (*WORDS.tables.values(), *WORDS.columns.values()) for w in x.text().split()]
    some = random.Random(5)
    for _ in range(300):
        said = [some.choice([some.choice(names), some.choice(names) + "s", some.choice(names).upper(), some.choice(names) + some.choice(names), "line", "item", "the", "of", "than", "'x'", "5"]) for _ in range(some.randint(0, 9))]
        t = Tokens.read(" ".join(said))
        every = [*WORDS.table_mentions(t), *(m for x in WORDS.tables for m in WORDS.column_mentions(t, x))]
        assert WORDS.mentions(t) == WORDS.cleaned(t, every)


def test_columns_and_fields_that_are_wished_are_those_of_the_whole_record():
    for _, question, *_ in FIXTURE:
        whole = annotation.record(question, WORDS, {"X": [("nation", "n_name")]})
        for fields in ({"parts": annotation.FIELDS["parts"]}, {"tokens": ("text",), "parts": ("kind", "text"), "conditions": ("table_name",)}, {"ordered": ("column_name",)}, {"selected": ("agg",)}, {"grouped": ("table_name",), "mentions": ("tier", "start")}):
            got = annotation._entries(question, WORDS, {"X": [("nation", "n_name")]}, fields)
            assert got == {c: [tuple(x[f] for f in own) for x in whole[c]] for c, own in fields.items()}


def test_questions_of_one_shape_are_cut_once(monkeypatch):
    cut, whole = [], segments._cut
    monkeypatch.setattr(segments, "_cut", lambda a: (cut.append(a), whole(a))[1])
    monkeypatch.setattr(segments, "_TOLD", {})
    seen = []
    for value in ("'Red'", "'Green and blue'", "'who'"):
        t = Tokens.read(rewritten(f"List the name of parts whose size is {value} and sorted by size"))
        a = Annotated(t, tuple(WORDS.mentions(t)))
        parts, actions = parts_and_actions(a)
        assert actions == [action(a.part(p.start, p.end))[0] for p in parts]
        assert read(a, WORDS, None, frozenset({"flags"}))[1].flags == [flags_of(a.part(p.start, p.end)) for p in parts] == read(a, WORDS)[1].flags
        seen.append(parts)
    assert len(cut) == 1 and seen[0] == seen[1] == seen[2]
    other = Tokens.read("List the name of parts whose size is 5 or whose size is 7")
    assert parts_of(Annotated(other)) != seen[0] and len(cut) == 2 and shapes(Annotated(Tokens())) == ()


def test_annotated_questions_are_not_moved_again(spark):
    """The checks need no second look at the questions: after the annotation only the counts of each task are moved."""
    plan = queries.question_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(q_id" not in plan[: plan.index("MapInArrow")]


def test_values_are_met_whatever_number_a_question_has(spark):
    questions = spark.createDataFrame([(None, "D ", "in red wine"), (1, "d", "red"), (1, "d", "Red wine"), (2, "e", "red wine"), (3, None, "red")], "q_id int, db_id string, question string")
    index = spark.createDataFrame([("d", "t", "c", "Red Wine"), ("d", "t", "b", "Red Wine"), ("d", "t", "c", "wine red")], "db string, table_name string, column_name string, cell_value string")
    assert sorted(map(str, (tuple(r) for r in exact_matches(questions, index).collect()))) == sorted(str((q, "t", c, "Red Wine")) for q in (None, 1) for c in "bc")


def test_a_task_keeps_the_catalogs_of_all_its_questions():
    assert annotation._schema.cache_info().maxsize >= 1000  # a task of check_l has questions of some 850 databases, in every batch of rows


def test_words_are_mended_once_a_catalog(monkeypatch):
    words, mended = SchemaWords(Catalog({"customer": {"name": "string"}})), []
    one = type(words.spelling)._mended
    monkeypatch.setattr(type(words.spelling), "_mended", lambda self, t: (mended.append(t.text), one(self, t))[1])
    for _ in range(3):
        assert words.spelling.of(Tokens.read("list all customrs")).text() == "list all customers"
    assert len(mended) == 3
