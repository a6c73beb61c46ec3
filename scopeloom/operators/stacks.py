"""Path algebra as column expressions: what a node does to the stacks of a path, jumps, ground matching, display.

A path row has start_nid, end_nid, sym_pre, sco_pre, sym_post, sco_post, edges. All expressions stay in the JVM; the general
unification of two paths with variables is in ``kernel``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import JUMP, SCOPES, SYMBOL, SYMBOLS

_NO_SCOPES = f"cast(null as {SCOPES})"


def _sql(text: str, p: str, n: str) -> Column:
    return F.expr(text.replace("$p", p).replace("$n", n).replace("$NULL", _NO_SCOPES).replace("$SYMBOL", SYMBOL))


_POP = "$nkind in ('pop_symbol', 'pop_scoped_symbol')"
_HEAD = "get($psym_post.symbols, 0)"
_FRESH = "(1 + greatest(coalesce($psco_pre.variable, 0), coalesce(array_max(transform($psym_pre.symbols, x -> x.scopes.variable)), 0)))"


def effect(p: str = "", n: str = "n_") -> dict[str, Column]:
    """The stacks after appending a node, and ``ok`` (false: the path ends here). Column prefixes of path and node are given.

    A push puts its symbol on the symbol stack (with the scope stack attached, its own scope on top, if scoped). A pop takes
    a matching head off, or, where only a variable is left, asks for the symbol in the precondition. ``drop_scopes`` empties
    the scope stack; a scoped pop replaces it by what the symbol had attached.
    """
    texts = {
        "ok": f"case when {_POP} and size($psym_post.symbols) > 0 then {_HEAD}.symbol = $nsymbol and ({_HEAD}.scopes is not null) = ($nkind = 'pop_scoped_symbol') "
        f"when {_POP} then $psym_post.variable is not null when $nkind = 'push_scoped_symbol' then $nscope is not null else true end",
        "sym_pre": f"case when {_POP} and size($psym_post.symbols) = 0 then named_struct('symbols', array_append($psym_pre.symbols, "
        f"cast(named_struct('symbol', $nsymbol, 'scopes', if($nkind = 'pop_scoped_symbol', cast(named_struct('scopes', array(), 'variable', {_FRESH}) as {SCOPES}), $NULL)) as $SYMBOL)), "
        "'variable', $psym_pre.variable) else $psym_pre end",
        "sco_pre": "$psco_pre",
        "sym_post": "case when $nkind = 'push_symbol' then named_struct('symbols', array_prepend($psym_post.symbols, cast(named_struct('symbol', $nsymbol, 'scopes', $NULL) as $SYMBOL)), 'variable', $psym_post.variable) "
        "when $nkind = 'push_scoped_symbol' then named_struct('symbols', array_prepend($psym_post.symbols, cast(named_struct('symbol', $nsymbol, 'scopes', "
        "named_struct('scopes', array_prepend($psco_post.scopes, $nscope), 'variable', $psco_post.variable)) as $SYMBOL)), 'variable', $psym_post.variable) "
        f"when {_POP} and size($psym_post.symbols) > 0 then named_struct('symbols', slice($psym_post.symbols, 2, size($psym_post.symbols)), 'variable', $psym_post.variable) else $psym_post end",
        "sco_post": f"case when $nkind = 'drop_scopes' then cast(named_struct('scopes', array(), 'variable', null) as {SCOPES}) "
        f"when $nkind = 'pop_scoped_symbol' and size($psym_post.symbols) > 0 then {_HEAD}.scopes "
        f"when $nkind = 'pop_scoped_symbol' then cast(named_struct('scopes', array(), 'variable', {_FRESH}) as {SCOPES}) else $psco_post end",
    }
    return {k: _sql(v, p, n) for k, v in texts.items()}


def lift(nodes: DataFrame, ground: bool = False) -> DataFrame:
    """Each node as a path of no edges. ``ground``: precondition variables are bound to empty stacks."""
    one = "null" if ground else "1"
    empty_symbols, empty_scopes = (F.expr(f"cast(named_struct('{k}', array(), 'variable', {one}) as {t})") for k, t in (("symbols", SYMBOLS), ("scopes", SCOPES)))
    base = nodes.select(*[F.col(c).alias(f"n_{c}") for c in nodes.columns]).withColumns({"sym_pre": empty_symbols, "sym_post": empty_symbols, "sco_pre": empty_scopes, "sco_post": empty_scopes})
    made = effect()
    rows = base.where(made["ok"]) if ground else base
    out = rows.select(F.col("n_file").alias("file"), F.col("n_nid").alias("start_nid"), F.col("n_nid").alias("end_nid"), *[made[c].alias(c) for c in ("sym_pre", "sco_pre", "sym_post", "sco_post")], *[F.col(f"n_{c}").alias(c) for c in nodes.columns if c not in ("nid", "file")])
    return out.withColumn("edges", F.expr("cast(array() as array<struct<source:string,precedence:int>>)"))


def resolve_jump(paths: DataFrame) -> DataFrame:
    """At the jump node, go to the scope on top of the scope stack; without one a variable may still bring one, else drop."""
    at = F.col("end_nid") == JUMP
    known = at & (F.size("sco_post.scopes") > 0)
    rows = paths.where(~at | (F.size("sco_post.scopes") > 0) | F.col("sco_post.variable").isNotNull())
    return rows.withColumns({
        "edges": F.when(known, F.array_append("edges", F.struct(F.lit(JUMP).alias("source"), F.lit(0).alias("precedence")))).otherwise(F.col("edges")),
        "end_nid": F.when(known, F.get("sco_post.scopes", F.lit(0))).otherwise(F.col("end_nid")),
        "sco_post": F.when(known, F.expr(f"cast(named_struct('scopes', slice(sco_post.scopes, 2, size(sco_post.scopes)), 'variable', sco_post.variable) as {SCOPES})")).otherwise(F.col("sco_post")),
    })


# ---- stacks and edge lists from both ends


def _with(stack: str, items: Column) -> Column:
    """A stack column with other items and the variable that it has."""
    name, kind = ("scopes", SCOPES) if stack.startswith("sco") else ("symbols", SYMBOLS)
    return F.struct(items.alias(name), F.col(f"{stack}.variable").alias("variable")).cast(kind)


def _of(stack: str) -> Column:
    return F.col(f"{stack}.{'scopes' if stack.startswith('sco') else 'symbols'}")


def push_front(stack: str, item: Column) -> Column:
    return _with(stack, F.array_prepend(_of(stack), item))


def push_back(stack: str, item: Column) -> Column:
    return _with(stack, F.array_append(_of(stack), item))


def pop_front(stack: str) -> tuple[Column, Column]:
    """The first item, null if there is none, and the rest."""
    return F.get(_of(stack), F.lit(0)), _with(stack, F.slice(_of(stack), 2, F.greatest(F.size(_of(stack)), F.lit(1))))


def pop_back(stack: str) -> tuple[Column, Column]:
    return F.get(_of(stack), F.size(_of(stack)) - 1), _with(stack, F.slice(_of(stack), 1, F.greatest(F.size(_of(stack)) - 1, F.lit(0))))


def edges_push(edges: str, edge: Column, front: bool = False) -> Column:
    return F.array_prepend(edges, edge) if front else F.array_append(edges, edge)


def edges_pop(edges: str, front: bool = False) -> tuple[Column, Column]:
    if front:
        return F.get(edges, F.lit(0)), F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1)))
    return F.get(edges, F.size(edges) - 1), F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0)))


# ---- variables


def largest_symbol_variable() -> Column:
    """Of the preconditions, 0 if there is none."""
    return F.coalesce(F.col("sym_pre.variable"), F.lit(0))


def largest_scope_variable() -> Column:
    return F.expr("greatest(coalesce(sco_pre.variable, 0), coalesce(array_max(transform(sym_pre.symbols, x -> x.scopes.variable)), 0))")


def fresh_scope_variable() -> Column:
    return largest_scope_variable() + 1


def renamed(stack: str, symbols: Column, scopes: Column) -> Column:
    """A stack whose variables are moved on: its own, and those of scopes attached to its symbols."""
    if stack.startswith("sco"):
        return F.struct(F.col(f"{stack}.scopes").alias("scopes"), (F.col(f"{stack}.variable") + scopes).alias("variable")).cast(SCOPES)
    attached = lambda x: F.when(x["scopes"].isNotNull(), F.struct(x["scopes"]["scopes"].alias("scopes"), (x["scopes"]["variable"] + scopes).alias("variable")))
    each = F.transform(F.col(f"{stack}.symbols"), lambda x: F.struct(x["symbol"].alias("symbol"), attached(x).alias("scopes")))
    return F.struct(each.alias("symbols"), (F.col(f"{stack}.variable") + symbols).alias("variable")).cast(SYMBOLS)


def bound(stack: str, value: str) -> Column:
    """A stack whose variable stands for another stack: that one's items follow, and its variable is the new one. Without a
    variable the stack stays."""
    joined = _with(value, F.concat(_of(stack), _of(value)))
    return F.when(F.col(f"{stack}.variable").isNotNull(), joined).otherwise(F.col(stack))


def symbols_text(col: str) -> Column:
    scopes = "if(x.scopes is null, '', concat('/(', array_join(transform(x.scopes.scopes, y -> concat('[', y, ']')), ','), if(x.scopes.variable is null, '', concat(if(size(x.scopes.scopes) > 0, ',', ''), '$', x.scopes.variable)), ')'))"
    return F.expr(f"concat('<', array_join(transform({col}.symbols, x -> concat(x.symbol, {scopes})), ''), if({col}.variable is null, '', concat(if(size({col}.symbols) > 0, ',', ''), '%', {col}.variable)), '>')")


def scopes_text(col: str) -> Column:
    return F.expr(f"concat('(', array_join(transform({col}.scopes, y -> concat('[', y, ']')), ','), if({col}.variable is null, '', concat(if(size({col}.scopes) > 0, ',', ''), '$', {col}.variable)), ')')")


def node_text(prefix: str) -> Column:
    """[root], [jump to scope], [file(1) definition x] and so on, from a node's columns under ``prefix``."""
    n = {c: F.col(f"{prefix}{c}") for c in ("nid", "kind", "symbol", "is_definition", "is_reference", "is_exported")}
    what = F.when(n["is_definition"], F.concat(F.lit("definition "), n["symbol"])).when(n["is_reference"], F.concat(F.lit("reference "), n["symbol"])).when(n["is_exported"], F.lit("exported scope"))
    what = what.when(n["kind"].startswith("push"), F.concat(F.lit("push "), n["symbol"])).when(n["kind"].startswith("pop"), F.concat(F.lit("pop "), n["symbol"])).otherwise(F.regexp_replace(n["kind"], "_", " "))
    return F.when(n["kind"] == "root", "[root]").when(n["kind"] == "jump_to", "[jump to scope]").otherwise(F.concat(F.lit("["), n["nid"], F.lit(" "), what, F.lit("]")))


def display(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``paths`` with the canonical text of each."""
    cols = ["nid", "kind", "symbol", "is_definition", "is_reference", "is_exported"]
    s, e = (nodes.select(*[F.col(c).alias(f"{p}{c}") for c in cols]) for p in ("s_", "e_"))
    rows = paths.join(s, F.col("start_nid") == F.col("s_nid")).join(e, F.col("end_nid") == F.col("e_nid"))
    text = F.concat_ws(" ", symbols_text("sym_pre"), scopes_text("sco_pre"), node_text("s_"), F.lit("->"), node_text("e_"), symbols_text("sym_post"), scopes_text("sco_post"))
    return rows.select(*paths.columns, text.alias("text"))
