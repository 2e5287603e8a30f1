import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.plans import queryparse as Q


def words(*ws):
    return Q.Phrase(tuple(ws))


def test_precedence():
    x, y, z, w = (words(c) for c in "xyzw")
    assert Q.parse("x NOT z AND w") == Q.Both((Q.Without(x, z), w))
    assert Q.parse("x OR w AND z") == Q.Either((x, Q.Both((w, z))))
    assert Q.parse("x NOT y z") == Q.Without(x, Q.Both((y, z)))
    assert Q.parse("x OR w z") == Q.Either((x, Q.Both((w, z))))


def test_phrases():
    assert Q.parse("foo_bar") == words("foo", "bar")
    assert Q.parse('"a b"') == Q.parse("a + b") == words("a", "b")
    assert Q.parse("pre*") == Q.Phrase(("pre",), prefix=True)
    assert Q.parse("^a") == Q.Phrase(("a",), initial=True)
    assert Q.parse("Ångström") == words("angstrom")
    assert Q.parse("heading : a") == Q.Phrase(("a",), columns=("heading",))
    assert Q.parse("{heading content} : a") == words("a")
    assert Q.parse("file_path : a") == Q.Phrase(("a",), columns=())
    assert Q.parse("NEAR(a b, 3)") == Q.Near((words("a"), words("b")), 3)


@pytest.mark.parametrize("bad", ["foo:bar", "-word", "what?", "a.b", "c++", '"open', "AND", "---", "", "(x OR y) z", "x (y)", "a AND (", "NEAR()", "a AND", "* a"])
def test_errors(bad):
    with pytest.raises(Q.QuerySyntaxError):
        Q.parse(bad)


def test_terms():
    assert Q.terms("foo AND -no bar-baz") == ['"foo"', '"bar"', '"baz"']
    assert Q.has_operators("a NOT b") and not Q.has_operators("NEAR(a b)")


@given(st.text(max_size=40))
def test_never_breaks(text):
    try:
        Q.parse(text)
    except Q.QuerySyntaxError:
        pass
    together = " ".join(Q.terms(text))
    if together:
        Q.parse(together)
