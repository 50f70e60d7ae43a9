"""The word-prefix rule against a plain loop over bytes."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions.match import Rule, clamp, normalise_needle, prefix_match


def by_loop(needle: str, source: str, coef: float) -> bool:
    """Weights of equal bytes from each word's start, until the coefficient is reached."""
    t, s, coef = needle.encode(), source.encode(), clamp(coef)
    n, m = len(t), len(s)
    if not n or not m or n > m:
        return False
    for place in range(m - int(n * (1 - coef))):
        start = 0 if place == 0 else place + 1
        for begin in {0: [0] + ([1] if s[0:1] == b" " else [])}.get(place, [start] if s[place : place + 1] == b" " else []):
            weight = 0.0
            for a, b in zip(t, s[begin:], strict=False):
                if a != b:
                    break
                weight += 1.0 / n
                if weight >= coef:
                    return True
    return False


def by_rule(needle: str, source: str, coef: float) -> bool:
    rule, s = Rule.of(needle, coef), source.encode()
    if rule is None or len(s) < rule.size:
        return False
    place = s[1:].find(b" " + rule.prefix) + 1
    return (s.startswith(rule.prefix) and len(s) > rule.tail) or 0 < place < len(s) - rule.tail


words = st.text(alphabet="ab é", max_size=12).map(normalise_needle)


@settings(max_examples=2000, deadline=None)
@given(words, words, st.floats(0, 0.99))
def test_constants(needle, source, coef):
    assert by_rule(needle, source, coef) == by_loop(needle, source, coef)


CASES = [
    ("ab", "ab", 0.0, False), ("ab", "abc", 0.0, True), ("ax", "abc", 0.0, True), ("war", "war and peace", 0.99, True), ("peace", "war and peace", 0.99, True),
    ("eace", "war and peace", 0.99, False), ("long needle", "short", 0.5, False), ("", "anything", 0.75, False), ("éon", "un éonier", 0.99, True), ("é", "aé", 0.99, False),
]


def test_column(spark):
    for needle, source, coef, want in CASES:
        got = spark.createDataFrame([(source,)], "s string").select(prefix_match(F.col("s"), needle, coef)).first()[0]
        assert (needle, source, got) == (needle, source, want) == (needle, source, by_loop(needle, source, coef))
    assert spark.createDataFrame([(None,)], "s string").select(prefix_match(F.col("s"), "a", 0.5)).first()[0] is False


def test_column_on_random_words(spark):
    import random

    r = random.Random(5)
    made = ["".join(r.choice("ab é") for _ in range(r.randrange(14))) for _ in range(400)]
    sources = [normalise_needle(x) for x in made]
    df = spark.createDataFrame([(x,) for x in sources], "s string").coalesce(1)
    for _ in range(8):
        needle, coef = normalise_needle("".join(r.choice("ab é") for _ in range(r.randrange(1, 6)))), r.random()
        got = [x[0] for x in df.select(prefix_match(F.col("s"), needle, coef)).collect()]
        assert got == [by_loop(needle, x, coef) for x in sources]


def test_constants_of_long_needles():
    assert [len(Rule.of("x" * n, c).prefix) for n, c in ((4, 0.75), (10, 0.7), (99, 0.99), (100, 0.99))] == [3, 7, 99, 99]
    assert (clamp(1), clamp(-0.1), clamp(0)) == (0.99, 0.99, 0)


def test_any_of_an_array(spark):
    import random

    from folioscope.functions.match import joined

    r = random.Random(6)
    made = [["".join(r.choice("ab é\t ") for _ in range(r.randrange(14))) for _ in range(r.randrange(4))] for _ in range(300)] + [None, [None, "ab"], [""]]
    df = spark.createDataFrame([(x,) for x in made], "s array<string>").coalesce(1)
    for _ in range(8):
        needle, coef = normalise_needle("".join(r.choice("ab é") for _ in range(r.randrange(1, 6)))), r.random()
        rule = Rule.of(needle, coef)
        if rule:
            got = [x[0] for x in df.select(rule.any_of(joined(F.col("s")))).collect()]
            assert got == [any(by_loop(needle, normalise_needle(t), coef) for t in x or [] if t) for x in made]


def test_search_stays_in_generated_code(spark):
    from folioscope.operators.search import Title, search
    from folioscope.schema import BOOKS

    books = spark.createDataFrame([], BOOKS).repartition(2)
    plan = search(books, [Title("small widg")])._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert len(filters) == 1 and filters[0].count("regexp_replace") <= 2
