import pytest

from typeloom.functions.types import Param, Type
from typeloom.plans.errors import NameAmbiguous, NameNotFound, SyntaxProblem, TooManyClauses, WrongArity
from typeloom.plans.expansion import Leaf, Max, Sum, candidate_terms, canonical, expand, fixpoint, itf, leaves, minimize, views_between, weigh
from typeloom.plans.language import Raw, parse
from typeloom.plans.resolve import Resolved, TypeName, resolve, to_type
from typeloom.plans.scoring import Scorer, final_score
from typeloom.functions.types import both_ways, read_terms, read_type, View
from typeloom.functions.variance import CO, CONTRA, INV


@pytest.mark.parametrize(
    "text, shown",
    [
        ("Int", "Int"), ("List[Int]", "List[Int]"), ("p.q.C[argument.Name]", "p.q.C[argument.Name]"), ("A => B", "scala.Function1[A, B]"),
        ("(A, B) => C", "scala.Function2[A, B, C]"), ("A => B => C", "scala.Function1[A, scala.Function1[B, C]]"), ("(A, B)", "scala.Tuple2[A, B]"),
        ("((A, B)) => C", "scala.Function1[scala.Tuple2[A, B], C]"), ("A => (B, C)", "scala.Function1[A, scala.Tuple2[B, C]]"), ("(A)", "A"), ("() => A", "scala.Function0[A]"), ("::[A, B]", "::[A, B]"), ("&~", "&~"),
    ],
)
def test_types(text, shown):
    assert str(parse(text).type) == shown


@pytest.mark.parametrize("text, words, shown", [("keyword: Int", "keyword", "Int"), ("k1 k2 k3: Int", "k1 k2 k3", "Int"), ('"k1 k2": Int', "k1 k2", "Int"), ("k1 k2 k3", "k1 k2 k3", None), ('"a b"', "a b", None)])
def test_keywords(text, words, shown):
    q = parse(text)
    assert q.keywords == words and (None if q.type is None else str(q.type)) == shown or (text == '"a b"' and q.keywords == words)


@pytest.mark.parametrize("prefix", ["", "k1 k2: "])
@pytest.mark.parametrize("text", ["List[]", "()", "A => ()", "(())", "(A, B", "A, B)", "(A, B => C", "A, B) => C", "A, B => C", "List[A", "Map[A, List[C]"])
def test_rejected(text, prefix):
    with pytest.raises(SyntaxProblem):
        parse(prefix + text)


TYPES = [TypeName("scala.Int"), TypeName("q.Int"), TypeName("p.Bb"), TypeName("p.Same"), TypeName("q.Same"), TypeName("scala.collection.immutable.List", (Param("A", CO),)), TypeName("p.List", (Param("A", CO),)), TypeName("scala.Function1", (Param("A", CONTRA), Param("B", CO)))]


def lookup(name):
    return [t for t in TYPES if t.name == name or t.name.endswith("." + name)]


def test_resolving():
    assert resolve(Raw("Int"), lookup).definition.name == "scala.Int"
    assert resolve(Raw("List"), lookup).definition.name == "scala.collection.immutable.List"
    assert resolve(Raw("A"), lookup) == Resolved(None)
    with pytest.raises(NameNotFound):
        resolve(Raw("Nope"), lookup)
    with pytest.raises(NameAmbiguous):
        resolve(Raw("Same"), lookup)
    with pytest.raises(WrongArity):
        resolve(Raw("List", (Raw("A"), Raw("B"))), lookup)
    f = to_type(resolve(parse("(Int => Bb) => List[A]").type, lookup))
    assert str(f) == "+scala.Function1[-scala.Function1[+scala.Int, -p.Bb], +scala.collection.immutable.List[+scala.Nothing]]"
    assert to_type(Resolved(None)).name == "<unknown>"


A, B, C, Ax, Bx, Cx, Dx = (Leaf(x) for x in ("A", "B", "C", "Ax", "Bx", "Cx", "Dx"))


@pytest.mark.parametrize(
    "tree, smaller",
    [
        (Max((Sum((A,)), Sum((B,)))), Max((A, B))),
        (Max((Sum((Max((A,)), Max((B,)))),)), Max((Sum((A, B)),))),
        (Max((Sum((Ax, Max((A, B)))), Sum((Bx, Max((A, B)))))), Max((Sum((Max((Ax, Bx)), Max((A, B)))),))),
        (Max((Sum((Ax, A)), Sum((Bx, A)), Sum((Cx, B)), Sum((Dx, B)))), Max((Sum((Max((Cx, Dx)), B)), Sum((Max((Ax, Bx)), A))))),
        (Sum((A, Max((Sum((A, A)), B)))), Sum((A, Max((Sum((A, A)), B))))),
        (Max((Sum((Ax, A, A)), Sum((Bx, A, A)))), Max((Sum((Max((Sum((Max((Ax, Bx)), A)),)), A)),))),
    ],
)
def test_minimizing(tree, smaller):
    assert canonical(minimize(tree)) == canonical(smaller)


def test_fixpoint_unwraps():
    assert canonical(fixpoint(Max((Sum((Max((A,)),)),)))) == canonical(A)


def b(name, boost, frequency=0.0):
    return Leaf("+" + name, boost=boost, frequency=frequency)


NESTED = Sum((Max((b("A", 0.9), b("B", 0.5))), b("A", 1), b("A", 1)))
SMALL = Sum((Max((b("A", 0.3), b("B", 0.5))), b("A", 1)))


@pytest.mark.parametrize(
    "tree, terms, score, penalty",
    [
        (b("A", 1), "!+A", 1, 0), (b("A", 1), "!+A !+B", 1, 1), (b("A", 1), "!+B", 0, 2), (Sum((b("A", 1), b("B", 2))), "!+A", 1, 1), (Sum((b("A", 1), b("B", 2))), "!+A !+B", 3, 0),
        (Max((b("A", 1), b("B", 2))), "!+A", 1, 0), (Max((b("A", 1), b("B", 2))), "!+B", 2, 0), (Max((b("A", 1), b("B", 2))), "!+A !+B", 2, 1), (Max((b("A", 1), b("B", 2))), "!+B !+A", 2, 1),
        (Max((b("A", 1), Sum((b("B", 2), b("C", 0.5))))), "!+A !+B !+C", 2.5, 1), (NESTED, "!+A !+A", 2, 1), (NESTED, "!+A !+B", 1.5, 1), (NESTED, "!+A !+A !+A", 2.9, 0), (NESTED, "!+B !+A !+A", 2.5, 0),
        (SMALL, "!+A !+B", 1.5, 0), (SMALL, "!+A !+A !+B", 1.5, 1), (b("A", 1), "!+A ?+A ?+B", 1, 0.2), (b("A", 1), "?+A ?+B", 1, 0.1), (b("A", 1), "?+B", 0, 1.1),
    ],
)
def test_scores(tree, terms, score, penalty):
    got = Scorer(tree).score(read_terms(terms))
    assert got[0] == pytest.approx(score, abs=1e-6) and got[1] == pytest.approx(penalty, abs=1e-6)


def test_weights_and_cutoff():
    assert itf(0, 2.7) == 1 and itf(0.5, 2.7) == pytest.approx(0.381, abs=1e-3) and itf(1, 2.7) == 0.001 and itf(0.5, 0) == 1
    assert candidate_terms(Sum((b("A", 1, 0.5), b("B", 0.9, 0.4), b("C", 0.8, 0.3))), 1) == ["+A", "+B"]
    assert candidate_terms(Sum((b("A", 1, 0.5), b("B", 0.9, 0.6), b("C", 0.8, 0.3))), 1) == ["+A", "+C"]
    w = weigh(Leaf("+A", 0.5, 1), lambda _: 0.0)
    assert w.boost == pytest.approx(0.4)
    assert float(final_score(2, 1, 0)) == pytest.approx(2 / 1.1, abs=1e-6)


def edge(base, sub, *params):
    return both_ways(read_type(base, set(params)), read_type(sub, set(params)))


GRAPH = [
    *edge("+A", "+B"), *edge("+A", "+C"), *edge("+C", "+D"), *edge("+Box[+T]", "+MyBox[+T]", "T"), *edge("+Box[+C]", "+CBox"), *edge("+Box[+Loop[+T]]", "+Loop[+T]", "T"), *edge("+Box[+T]", "+InvarBox[/T]", "T"),
    View(Type(CO, "_", (), True), Type(CO, "Nothing")), View(Type(INV, "_", (), True), Type(INV, "<unknown>")),
]


@pytest.mark.parametrize(
    "start, found",
    [
        ("+A", {"+B", "+C", "+D", "+Nothing"}), ("-D", {"-C", "-A"}), ("/B", {"<unknown>"}), ("+Box[+B]", {"+MyBox[+B]", "+InvarBox[B]", "+Nothing"}),
        ("+Box[+C]", {"+MyBox[+C]", "+CBox", "+InvarBox[C]", "+Nothing"}), ("-CBox", {"-Box[-C]"}), ("-Loop[-A]", {"-Box[-Loop[-A]]"}),
    ],
)
def test_alternatives(start, found):
    got = views_between(GRAPH, 3)(read_type(start))
    assert {str(x) for x, _ in got} == found and len(got) == len(found)


def test_expansion():
    tree = expand(read_type("+A"), views_between(GRAPH))
    assert canonical(minimize(tree)) == canonical(Sum((Max((Leaf("+A"), Leaf("+B"), Leaf("+C"), Leaf("+Nothing"))),)))
    assert [x.distance for x in leaves(tree)] == [0, 1, 1, 1]
    box = expand(read_type("+Box[+Q]"), lambda x: ())
    assert [(x.term, x.fraction) for x in leaves(box)] == [("+Box", 0.5), ("+Q", 0.5)]
    assert expand(read_type("-Loop[-Loop[-A]]"), views_between(GRAPH)) is not None  # ends
    with pytest.raises(TooManyClauses):
        expand(read_type("+A"), views_between(GRAPH), limit=2)
