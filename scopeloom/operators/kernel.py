"""General path algebra on single paths with variables: unification, concatenation, cyclicity, partial path predicates.

A path is a dict with the columns of the paths table. Stacks: {"symbols": [{"symbol", "scopes"}], "variable"} and
{"scopes": [...], "variable"}. ``concatenated`` and ``cycles`` run it over tables, in Arrow batches; the searches themselves use
the column expressions of ``stacks``.
"""

from copy import deepcopy

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import JUMP, PATHS_DDL
from ..session import ship

ship(__name__)


class Mismatch(Exception):
    """Two stacks that can't be the same."""


def _bind(table: dict, variable: int, value: dict, unify) -> None:
    table[variable] = unify(table[variable], value) if variable in table else value


def unify_scopes(a: dict, b: dict, bound: dict) -> dict:
    """The common instance of two scope stacks; variables are entered in ``bound``."""
    x, y = a["scopes"], b["scopes"]
    k = min(len(x), len(y))
    if x[:k] != y[:k]:
        raise Mismatch
    (rest_x, rest_y), (va, vb) = (x[k:], y[k:]), (a["variable"], b["variable"])
    again = lambda p, q: unify_scopes(p, q, bound)
    if not rest_x and not rest_y:
        if va is None and vb is not None:
            _bind(bound, vb, {"scopes": [], "variable": None}, again)
            return a
        if vb is None and va is not None:
            _bind(bound, va, {"scopes": [], "variable": None}, again)
            return b
        if va is not None and va != vb:
            _bind(bound, vb, {"scopes": [], "variable": va}, again)
        return a
    if va is not None and va == vb:
        raise Mismatch
    if rest_x:
        if vb is None:
            raise Mismatch
        _bind(bound, vb, {"scopes": rest_x, "variable": va}, again)
        return a
    if va is None:
        raise Mismatch
    _bind(bound, va, {"scopes": rest_y, "variable": vb}, again)
    return b


def unify_symbols(a: dict, b: dict, bound: dict, scope_bound: dict) -> dict:
    """The same for symbol stacks: symbols agree, and either both or neither carry scopes."""
    x, y, head = a["symbols"], b["symbols"], []
    for p, q in zip(x, y):
        if p["symbol"] != q["symbol"] or (p["scopes"] is None) != (q["scopes"] is None):
            raise Mismatch
        head.append({"symbol": p["symbol"], "scopes": None if p["scopes"] is None else unify_scopes(p["scopes"], q["scopes"], scope_bound)})
    k = len(head)
    (rest_x, rest_y), (va, vb) = (x[k:], y[k:]), (a["variable"], b["variable"])
    again = lambda p, q: unify_symbols(p, q, bound, scope_bound)
    if not rest_x and not rest_y:
        if va is None and vb is not None:
            _bind(bound, vb, {"symbols": [], "variable": None}, again)
        elif vb is None and va is not None:
            _bind(bound, va, {"symbols": [], "variable": None}, again)
            return {"symbols": head, "variable": None}
        elif va is not None and va != vb:
            _bind(bound, vb, {"symbols": [], "variable": va}, again)
        return {"symbols": head, "variable": va}
    if va is not None and va == vb:
        raise Mismatch
    if rest_x:
        if vb is None:
            raise Mismatch
        _bind(bound, vb, {"symbols": rest_x, "variable": va}, again)
        return {"symbols": head + rest_x, "variable": va}
    if va is None:
        raise Mismatch
    _bind(bound, va, {"symbols": rest_y, "variable": vb}, again)
    return {"symbols": head + rest_y, "variable": vb}


def apply_scopes(s: dict, bound: dict) -> dict:
    """One level of substitution."""
    if s["variable"] is None or s["variable"] not in bound:
        return s
    v = bound[s["variable"]]
    return {"scopes": s["scopes"] + v["scopes"], "variable": v["variable"]}


def apply_symbols(s: dict, bound: dict, scope_bound: dict) -> dict:
    put = lambda x: {"symbol": x["symbol"], "scopes": None if x["scopes"] is None else apply_scopes(x["scopes"], scope_bound)}
    out = {"symbols": [put(x) for x in s["symbols"]], "variable": s["variable"]}
    if s["variable"] in bound and s["variable"] is not None:
        v = bound[s["variable"]]
        out = {"symbols": out["symbols"] + [put(x) for x in v["symbols"]], "variable": v["variable"]}
    return out


def with_offset(path: dict, symbols: int, scopes: int) -> dict:
    """The path with its variables renamed."""
    p = deepcopy(path)
    for c in ("sym_pre", "sym_post"):
        if p[c]["variable"] is not None:
            p[c]["variable"] += symbols
        for x in p[c]["symbols"]:
            if x["scopes"] is not None and x["scopes"]["variable"] is not None:
                x["scopes"]["variable"] += scopes
    for c in ("sco_pre", "sco_post"):
        if p[c]["variable"] is not None:
            p[c]["variable"] += scopes
    return p


def largest_variables(path: dict) -> tuple[int, int]:
    """Of the preconditions: largest symbol stack and scope stack variables, 0 if none."""
    inner = [x["scopes"]["variable"] or 0 for x in path["sym_pre"]["symbols"] if x["scopes"] is not None]
    return path["sym_pre"]["variable"] or 0, max([path["sco_pre"]["variable"] or 0, *inner])


def eliminate_variables(path: dict) -> dict:
    """Bind the top-level precondition variables to empty stacks everywhere."""
    bound = {v: {"symbols": [], "variable": None} for v in [path["sym_pre"]["variable"]] if v is not None}
    scope_bound = {v: {"scopes": [], "variable": None} for v in [path["sco_pre"]["variable"]] if v is not None}
    return path | {c: apply_symbols(path[c], bound, scope_bound) for c in ("sym_pre", "sym_post")} | {c: apply_scopes(path[c], scope_bound) for c in ("sco_pre", "sco_post")}


def resolve_to_node(path: dict, node: str) -> dict:
    """At an open jump, the next path starts at ``node``: the scope variable must stand for it (preconditions only)."""
    if path["end_nid"] != JUMP or node == JUMP:
        return path
    v = path["sco_post"]["variable"]
    if v is None:
        raise Mismatch
    bound = {v: {"scopes": [node], "variable": v}}
    return path | {"sym_pre": apply_symbols(path["sym_pre"], {}, bound), "sco_pre": apply_scopes(path["sco_pre"], bound), "end_nid": node}


def resolve_jump(path: dict) -> dict:
    if path["end_nid"] != JUMP:
        return path
    k = path["sco_post"]
    if not k["scopes"]:
        if k["variable"] is None:
            raise Mismatch
        return path
    return path | {"end_nid": k["scopes"][0], "sco_post": {"scopes": k["scopes"][1:], "variable": k["variable"]}, "edges": path["edges"] + [{"source": JUMP, "precedence": 0}]}


def join(left: dict, right: dict, node: dict) -> tuple[dict, dict]:
    """Bindings under which ``left`` may be followed by ``right`` at ``node``, whose own effect both sides contain and which is
    taken off first."""
    post, pre, scopes = left["sym_post"], right["sym_pre"], right["sco_pre"]
    if node["kind"].startswith("pop"):
        if not pre["symbols"]:
            raise Mismatch
        if node["kind"] == "pop_scoped_symbol":
            scopes = pre["symbols"][0]["scopes"]
        pre = {"symbols": pre["symbols"][1:], "variable": pre["variable"]}
    elif node["kind"].startswith("push"):
        post = {"symbols": post["symbols"][1:], "variable": post["variable"]}
    bound, scope_bound = {}, {}
    unify_symbols(post, pre, bound, scope_bound)
    unify_scopes(left["sco_post"], scopes, scope_bound)
    return bound, scope_bound


def concatenate(left: dict, right: dict, node: dict) -> dict:
    """``left`` followed by ``right``; ``node`` is the node at which they meet. Raises ``Mismatch`` where they can't."""
    left = resolve_to_node(left, right["start_nid"])
    if left["end_nid"] != right["start_nid"]:
        raise Mismatch
    left = with_offset(left, *largest_variables(right))
    bound, scope_bound = join(left, right, node)
    out = left | {
        "sym_pre": apply_symbols(left["sym_pre"], bound, scope_bound), "sco_pre": apply_scopes(left["sco_pre"], scope_bound),
        "sym_post": apply_symbols(right["sym_post"], bound, scope_bound), "sco_post": apply_scopes(right["sco_post"], scope_bound),
        "edges": left["edges"] + right["edges"], "end_nid": right["end_nid"],
    }
    return resolve_jump(out)


def cyclicity(path: dict, node: dict) -> str | None:
    """How a path from a node to itself changes when it is repeated: free, strengthens_precondition, strengthens_postcondition,
    or None where it can't follow itself."""
    if path["start_nid"] != path["end_nid"] or not path["edges"]:
        return None
    again = with_offset(path, *largest_variables(path))
    try:
        bound, scope_bound = join(path, again, node)
    except Mismatch:
        return None
    # the round before asks for more than it did, or the next one finds more than it needs
    for label, p, symbols, scopes in (("strengthens_precondition", path, "sym_pre", "sco_pre"), ("strengthens_postcondition", again, "sym_post", "sco_post")):
        if p[symbols]["variable"] in bound or p[scopes]["variable"] in scope_bound:
            return label
    return "free"


def _paths(table: pa.Table | pa.RecordBatch, name: str) -> list[dict]:
    return table.column(name).to_pylist()


def concatenated(pairs: DataFrame) -> DataFrame:
    """The paths that pairs of paths make: ``pairs`` has ``left`` and ``right`` (paths as structs) and ``kind``, that of the node at
    which they meet. Pairs that don't join have no row. Worked in Arrow batches; a join on ends comes before."""
    path = pairs.sparkSession.createDataFrame([], PATHS_DDL).schema
    arrow = to_arrow_schema(path)

    def run(batches):
        for b in batches:
            made = []
            for left, right, kind in zip(_paths(b, "left"), _paths(b, "right"), b.column("kind").to_pylist()):
                try:
                    made.append(concatenate(left, right, {"kind": kind}))
                except Mismatch:
                    continue
            yield pa.RecordBatch.from_pylist(made, arrow)

    return pairs.select("left", "right", "kind").mapInArrow(run, path)


def cycles(paths: DataFrame, key: str) -> DataFrame:
    """(key, cyclicity) of paths (``path`` as struct, ``kind`` of their end); null where a path can't follow itself."""
    schema = StructType([paths.schema[key]]).add("cyclicity", "string")

    def run(batches):
        for b in batches:
            found = [cyclicity(p, {"kind": k}) for p, k in zip(_paths(b, "path"), b.column("kind").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.string())], [key, "cyclicity"])

    return paths.select(key, "path", "kind").mapInArrow(run, schema)
