import pytest
from hypothesis import given
from hypothesis import strategies as st
from folio.plans.parser import parse
from folio.types import Comparison, QueryError, QuerySpec


def spec(top=-1, flags=(), include=(), exclude=(), regex=(), where=(), sort=()):
    return QuerySpec(tuple(include), tuple(exclude), tuple(sort), tuple(regex), tuple(where), top, frozenset(flags))


SIZE, SIZE_QUOTED = Comparison("size", ">=", "40"), Comparison("size", ">=", "40", True)
BRAND = Comparison("brand", "==", "Brand#23", True)

CASES = {
    "": spec(),
    " \t\n ": spec(),
    "top 12": spec(12),
    "verbose": spec(flags=["verbose"]),
    "top 2 recent": spec(2, ["recent"]),
    "recent verbose top 31": spec(31, ["verbose", "recent"]),
    "select *": spec(include=["*"]),
    "select * top 1": spec(1, include=["*"]),
    "where size >= 40": spec(where=[SIZE]),
    'where size >= "40"': spec(where=[SIZE_QUOTED]),
    'where brand=="Brand#23"': spec(where=[BRAND]),
    "! steel": spec(regex=[(None, "steel")]),
    "!/small, red/": spec(regex=[(None, "small, red")]),
    "! steel and kind ~ plated": spec(regex=[(None, "steel"), ("kind", "plated")]),
    "kind ~ /hot|cold, rolled/ top 4 recent": spec(4, ["recent"], regex=[("kind", "hot|cold, rolled")]),
    "recent select kind top 6 verbose kind ~ /x y/": spec(6, ["verbose", "recent"], ["kind"], regex=[("kind", "x y")]),
    "order kind top 9": spec(9, sort=[("kind", True)]),
    "sort -size, kind where size >= 40 select price": spec(include=["price"], where=[SIZE], sort=[("size", False), ("kind", True)]),
    'select *, -weight ! /[a-f]+ end/ and kind ~ ^p recent where size >= 40 and brand  ==  "Brand#23" and made < 2023-11 top 5': spec(
        5, ["recent"], ["*"], ["weight"], [(None, "[a-f]+ end"), ("kind", "^p")], [SIZE, BRAND, Comparison("made", "<", "2023-11")]),
    "select -weight, kind, price order kind,-price": spec(include=["kind", "price"], exclude=["weight"], sort=[("kind", True), ("price", False)]),
    r"kind ~ /^(?:a|b)[A-Z \.]{2,}$/": spec(regex=[("kind", r"^(?:a|b)[A-Z \.]{2,}$")]),
    "where size >= 40 !/tin/ sort kind": spec(regex=[(None, "tin")], where=[SIZE], sort=[("kind", True)]),
    "RECENT Top 3 ORDER a": spec(3, ["recent"], sort=[("a", True)]),
    "top 0": spec(0),
    "top -5": spec(-5),
    "top 3 top 9": spec(9),
    "order a sort -b": spec(sort=[("a", True), ("b", False)]),
    "where a == 1 where b < -2.5": spec(where=[Comparison("a", "==", "1"), Comparison("b", "<", "-2.5")]),
    "where made >= 2024-05-01 10:30 order x": spec(where=[Comparison("made", ">=", "2024-05-01 10:30")], sort=[("x", True)]),
    "where made.dt.day == 13": spec(where=[Comparison("made.dt.day", "==", "13")]),
    "where list-price > 5": spec(where=[Comparison("list-price", ">", "5")]),
    "where p == 'it\\'s'": spec(where=[Comparison("p", "==", "it's", True)]),
    "order ~ x": spec(regex=[("order", "x")]),
    r"path ~ /a\/b/": spec(regex=[("path", r"a\/b")]),
}


@pytest.mark.parametrize("text", CASES)
def test_specs(text):
    assert parse(text) == CASES[text]


@pytest.mark.parametrize("text", ["top 2.5", "top 5%", "top inf", "top 1e3"])
def test_top_that_is_no_whole_number_is_ten(text):
    got = parse(text)
    assert got.top == 10 and len(got.messages) == 1


@pytest.mark.parametrize("text", ["nonsense", "! /no end", "top", "top x", "where", "where a", "where a ==", "where a != 1", "select", "select a,", "order", "a ~", "!", "! x and", "where a == 1 and", "where a == 1 or b == 2", "a = 1"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


_NAME = st.from_regex(r"[A-Za-z_][A-Za-z0-9_.\-]{0,8}", fullmatch=True).filter(lambda s: s.lower() not in {"top", "select", "where", "order", "sort", "recent", "verbose", "and"})
_PATTERN = st.text(st.characters(codec="utf-8", exclude_characters="/\\"), max_size=12)
_LITERAL = st.text(st.characters(codec="utf-8", exclude_characters='"\\'), max_size=12)


@given(
    st.integers(-100, 10**6), st.lists(_NAME, max_size=3), st.lists(_NAME, max_size=2), st.lists(st.tuples(_NAME, st.booleans()), max_size=3),
    st.lists(st.tuples(st.none() | _NAME, _PATTERN), max_size=3), st.lists(st.builds(Comparison, _NAME, st.sampled_from(["==", "<=", "<", ">", ">="]), _LITERAL, st.just(True)), max_size=3), st.randoms(),
)
def test_written_queries_are_read_back(top, include, exclude, sort, regex, where, rng):
    """Whatever the order of the clauses, the spec is the one that was written."""
    clauses = [f"top {top}"]
    if include or exclude:
        clauses.append("select " + ", ".join([*include, *(f"-{c}" for c in exclude)]))
    if sort:
        clauses.append("order " + ",".join(c if up else f"- {c}" for c, up in sort))
    if regex:
        clauses.append(" and ".join(f"! /{p}/" if f is None else f"{f} ~ /{p}/" for f, p in regex))
    if where:
        clauses.append("WHERE " + " and ".join(f'{c.column} {c.op} "{c.literal}"' for c in where))
    rng.shuffle(clauses)
    assert parse(" ".join(clauses)) == spec(top, (), include, exclude, regex, where, sort)
