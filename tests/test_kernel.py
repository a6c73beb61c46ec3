"""Unification, concatenation and cycles on single paths."""

import pytest

from scopeloom.operators import kernel as k


def symbols(names, variable=1):
    return {"symbols": [{"symbol": n, "scopes": None} for n in names], "variable": variable}


def scopes(names=(), variable=1):
    return {"scopes": list(names), "variable": variable}


def path(pre, post, start="s", end="s", **more):
    return {"file": "f", "start_nid": start, "end_nid": end, "sym_pre": symbols(pre), "sym_post": symbols(post), "sco_pre": scopes(), "sco_post": scopes(), "edges": [{"source": "s", "precedence": 0}]} | more


SCOPE = {"kind": "scope"}


@pytest.mark.parametrize(
    "pre, post, kind",
    [(["foo"], ["bar"], None), ([], ["bar"], "strengthens_postcondition"), (["foo"], [], "strengthens_precondition"), (["bar"], ["bar"], "strengthens_postcondition"), (["foo"], ["foo", "foo"], "strengthens_postcondition"), (["foo", "foo"], ["foo"], "strengthens_precondition")],
)
def test_cycles(pre, post, kind):
    assert k.cyclicity(path(pre, post), SCOPE) == kind
    assert k.cyclicity(path(pre, post) | {"edges": []}, SCOPE) is None


@pytest.mark.parametrize(
    "a, b, bound",
    [
        (symbols([], None), symbols([], None), {}), (symbols([], None), symbols([], 2), {2: symbols([], None)}), (symbols([], 1), symbols([], None), {1: symbols([], None)}), (symbols([], 1), symbols([], 2), {2: symbols([], 1)}),
        (symbols(["x"], None), symbols([], 2), {2: symbols(["x"], None)}), (symbols([], 1), symbols(["x", "y"], 2), {1: symbols(["x", "y"], 2)}), (symbols([], None), symbols(["x"], None), "no"), (symbols(["x"], None), symbols([], None), "no"),
        (symbols(["x"], 1), symbols([], 1), "no"), (symbols(["x"], 1), symbols(["y"], 2), "no"), (symbols(["x"], 1), symbols(["x", "z"], None), {1: symbols(["z"], None)}),
    ],
)
def test_unify(a, b, bound):
    if bound == "no":
        with pytest.raises(k.Mismatch):
            k.unify_symbols(a, b, {}, {})
    else:
        got = {}
        k.unify_symbols(a, b, got, {})
        assert got == bound


def test_concatenate():
    left, right = path([], ["a", "b"], "r", "[root]"), path(["a"], [], "[root]", "d")
    out = k.concatenate(left, right, {"kind": "root"})
    assert (out["start_nid"], out["end_nid"], [x["symbol"] for x in out["sym_post"]["symbols"]], len(out["edges"])) == ("r", "d", ["b"], 2)
    with pytest.raises(k.Mismatch):
        k.concatenate(left, path(["z"], [], "[root]", "d"), {"kind": "root"})


def test_jumps():
    open_jump = path([], [], "s", "[jump]")
    assert k.resolve_to_node(open_jump, "n")["sco_pre"] == scopes(["n"])
    assert k.resolve_jump(open_jump | {"sco_post": scopes(["n", "m"])})["end_nid"] == "n"
    with pytest.raises(k.Mismatch):
        k.resolve_jump(open_jump | {"sco_post": scopes([], None)})


def test_eliminate_variables():
    out = k.eliminate_variables(path([], ["x"]))
    assert out["sym_pre"]["variable"] is None and out["sym_post"] == symbols(["x"], None) and out["sco_post"] == scopes([], None)
