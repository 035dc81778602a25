import pytest

from typeloom.functions.types import Param, Type, View, both_ways, curried, fingerprint, function, member, method, normalize, read_terms, read_type, show_terms, structure, unify, without_implicits
from typeloom.functions.variance import CO, CONTRA, INV, flip, times


def t(text, *params):
    return read_type(text, set(params))


def test_variances():
    assert [flip(v) for v in (CO, CONTRA, INV)] == [CONTRA, CO, INV]
    assert times(CO, CONTRA) == CONTRA and times(CONTRA, CONTRA) == CO and times(INV, CO) == INV == times(CONTRA, INV)


def test_round_trips():
    for text in ("+Int", "-Map[-A, +List[+B]]", "+p.C[/X]"):
        x = t(text)
        assert Type.decode(x.encode()) == x
        assert read_type(str(x).replace("[X]", "[/X]")) == x
    fp = [("+A", False), ("-B", True)]
    assert read_terms(show_terms(fp)) == fp


@pytest.mark.parametrize("bad", ["", "+A[", "+A]", "A[,]", "A B"])
def test_unreadable(bad):
    with pytest.raises(ValueError):
        read_type(bad)


def test_positions():
    x = t("+List[+A]")
    assert str(x.at(CONTRA)) == "-List[-A]"
    assert str(x.at(INV)) == "List[A]"
    assert str(t("+F[-A, +B]").at(CONTRA)) == "-F[+A, -B]"
    assert t("/A").position(CO) == t("/A")


def test_derived_variances():
    x = read_type("<memberAccess>[List[A], <methodInvocation1>[scala.Function1[A, B], B]]", {"A", "B"}, CO)
    assert str(x) == "+<memberAccess>[-List[-A], +<methodInvocation1>[-scala.Function1[+A, -B], +B]]"


def test_normal_form_of_a_method():
    x = member(t("+List[+A]", "A").at(CONTRA), method([t("-Int")], t("+A", "A")))
    assert str(normalize(x, [Param("A")])) == "+<ignored3>[-List[-scala.Any], -Int, +scala.Nothing]"
    assert show_terms(fingerprint(x, [Param("A")])) == "!+scala.Nothing !-Int !-List !-scala.Any"


def test_curried_equals_uncurried():
    a, b, c = t("-A"), t("-B"), t("+C")
    assert normalize(function([a, b], c)) == normalize(function([a], function([b], c)))


def test_optional_terms():
    implicit = Type(CONTRA, "<implicit>", (t("-Ord"),))
    x = method([t("-A")], method([implicit], t("+B")))
    assert fingerprint(x) == [("+B", False), ("-A", False), ("-Ord", True)]
    assert str(without_implicits(x)) == "+<methodInvocation1>[-A, +B]"
    assert fingerprint(t("+scala.<repeated>[+A]")) == [("+A", False), ("+scala.<repeated>", True)]


def test_refinements_by_names_and_extremes():
    assert normalize(t("+<refinement2>[+java.lang.Object, +B]")) == normalize(t("+B"))
    assert normalize(t("+<byname>[+B]")) == normalize(t("+B"))
    assert str(normalize(t("+F[+X]", "F"), [Param("F")])) == "+<ignored1>[+<bottom1>[+X]]"
    assert fingerprint(t("+List[+A]"), polarized=False) == [("A", False), ("List", False)]


def test_shape():
    x = method([t("-Int"), t("-A")], t("+List[+A]"))
    assert str(structure(x)) == "+scala.Function1[_, +scala.Function1[_, _]]"
    assert structure(x) == structure(curried(x))


def test_views():
    box, my = Type(CO, "Box", (Type(CO, "T", (), True),)), Type(CO, "MyBox", (Type(CO, "T", (), True),))
    down, up = both_ways(box, my)
    assert str(down(t("+Box[+B]"))) == "+MyBox[+B]"
    assert str(up(t("-MyBox[-B]"))) == "-Box[-B]"
    assert down(t("-Box[-B]")) is None and down(t("+C")) is None
    assert down.retained == 1.0
    assert View(box, t("+CBox")).retained == 0.5
    assert View(Type(CO, "_", (), True), t("+scala.Nothing")).retained == 1.0
    assert down.then(View(my, t("+X"))).target == t("+X")
    assert down.source.key() == "+Box[+_]" and Type(CO, "_", (), True).key() == "+_"
    assert unify(box, t("+Box[+C]")) == {"T": t("+C")}
    assert (down.distance, View(box, box).distance) == (1, 0)
