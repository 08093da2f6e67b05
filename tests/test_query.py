import pytest

from quern.plans.query import And, Kind, Not, Or, QuerySyntaxError, Term, cost, optimize, parse, term_weights


@pytest.mark.parametrize(
    "text, want",
    [
        ("error AND (timeout OR disk)", 'AND("error", OR("timeout", "disk"))'),
        ("a or b and not c", 'OR("a", AND("b", NOT("c")))'),
        ("not not x", '"x"'),
        ("and", '"and"'),
        ("NOTfoo", '"notfoo"'),
        ("OR OR OR", 'OR("or", "or")'),
        ("  ERROR ", '"error"'),
    ],
)
def test_parse(text, want):
    assert str(parse(text)) == want


@pytest.mark.parametrize("text", ["a b", "(a", "()", "a AND", "", "   ", "é", "a)", "not"])
def test_parse_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_rewrites():
    assert optimize(And(Term(""), Term("x"))) == Term("x")
    assert optimize(And(Term(""), Or())) is None
    assert optimize(Not(Not(Term("x")))) == Term("x")
    assert And(And(Term("a"), Term("b")), None, Term("c")).kids == (Term("a"), Term("b"), Term("c"))
    assert Not(None).is_empty() and Term(" ").is_empty() and And().is_empty()
    assert optimize(And(Term("a"), Or(And(Term("b"), Term("c"))))).kind is Kind.AND


def test_weights_and_cost():
    q = Or(Term("a"), Not(And(Term("a"), Term("b"))))
    assert term_weights(q) == {"a": 2, "b": 1}
    assert cost(q, {"a": 3, "b": 2}, 10) == 3 + 8
    assert cost(Not(Term("z")), {}, 5) == 5
