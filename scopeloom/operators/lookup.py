"""Joining paths with stored partial paths: by start node, and at the root by compatible symbol stacks.

Two symbol stacks are compatible if one is a prefix of the other and the shorter one has a variable, or if they are equal.
That condition is never joined as such: stacks are exploded into prefix keys, and keys are joined by equality.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROOT, SCOPES, SYMBOLS
from .stacks import resolve_jump

def names(symbols: str) -> str:
    """SQL for the symbols' texts of a list, by which stacks are looked up: attached scopes don't count."""
    return f"transform({symbols}, x -> x.symbol)"


def prefix_keys(symbols: str) -> Column:
    """Keys of all prefixes of a symbol list, the empty one first; a key is an array, so no symbol can look like two."""
    return F.expr(f"transform(sequence(0, size({symbols})), k -> slice({names(symbols)}, 1, k))")


def storage_key(stack: str) -> Column:
    """The text under which a root path's precondition is stored: V for a stack with a variable, X without."""
    return F.expr(f"concat(if({stack}.variable is null, 'X', 'V'), '␞', array_join({names(stack + '.symbols')}, '␟'))")


def root_candidates(queries: DataFrame, paths: DataFrame, query_stack: str = "sym_post") -> DataFrame:
    """Pairs of ``queries`` (with a symbol stack) and root ``paths`` whose preconditions are compatible.

    (a) equal keys; (b) the query has a variable and the stored stack is longer; (c) the stored stack has a variable and is a
    proper prefix. Stored paths with an empty precondition are never found. Attached scopes don't count here.
    """
    mine, stored = f"{query_stack}.symbols", "r_sym_pre.symbols"
    q = queries.withColumns({"q_key": F.expr(names(mine)), "q_var": F.col(f"{query_stack}.variable").isNotNull()})
    p = paths.where((F.col("start_nid") == ROOT) & (F.size("sym_pre.symbols") > 0)).select(*[F.col(c).alias(f"r_{c}") for c in paths.columns])
    p = p.withColumns({"p_key": F.expr(names(stored)), "p_var": F.col("r_sym_pre.variable").isNotNull()})
    same = q.join(p, F.col("q_key") == F.col("p_key"))
    proper = "slice({0}, 1, size({0}) - 1)"  # all prefixes but the whole
    longer = q.where("q_var").join(p.withColumn("k", F.explode(prefix_keys(proper.format(stored)))), F.col("q_key") == F.col("k")).drop("k")
    shorter = q.where(F.size(mine) > 0).withColumn("k", F.explode(prefix_keys(proper.format(mine)))).join(p.where("p_var"), F.col("k") == F.col("p_key")).drop("k")
    return same.unionByName(longer).unionByName(shorter).drop("q_key", "q_var", "p_key", "p_var")


def node_candidates(queries: DataFrame, paths: DataFrame, at: str = "end_nid") -> DataFrame:
    """Pairs of ``queries`` and stored paths that start where the query ends."""
    p = paths.select(*[F.col(c).alias(f"r_{c}") for c in paths.columns])
    return queries.join(p, queries[at] == F.col("r_start_nid"))


def prepare_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Partial paths with the join's left-hand requirements worked out once: the start node's own push is already on the
    incoming stack, its own pop is already off it."""
    kind = nodes.select(F.col("nid").alias("k_nid"), F.col("kind").alias("k_kind"))
    rows = paths.join(kind, paths.start_nid == F.col("k_nid")).drop("k_nid")
    pops, pushes = F.col("k_kind").startswith("pop"), F.col("k_kind").startswith("push")
    need = F.when(pops, F.expr("slice(sym_pre.symbols, 2, size(sym_pre.symbols))")).otherwise(F.col("sym_pre.symbols"))
    scopes = F.when(F.col("k_kind") == "pop_scoped_symbol", F.get("sym_pre.symbols", F.lit(0))["scopes"]).otherwise(F.col("sco_pre"))
    return rows.select(
        F.col("start_nid").alias("p_start"), F.col("end_nid").alias("p_end"), need.alias("p_need"), F.col("sym_pre.variable").alias("p_var"),
        scopes.alias("p_scopes"), pushes.alias("p_push"), F.col("sym_post").alias("p_post"), F.col("sco_post").alias("p_sco"),
        F.col("edges").alias("p_edges"), F.expr(names("sym_pre.symbols")).alias("p_key"),
    )


def _cut(items: str, n: str) -> str:
    return f"slice({items}, 1, size({n}))"


def _rest(items: str, n: str) -> str:
    return f"slice({items}, size({n}) + 1, size({items}))"


# The stack that meets a path's need: without the start node's own push, which the path's precondition has not.
_STACK = "(if(p_push, slice(sym_post.symbols, 2, size(sym_post.symbols)), sym_post.symbols))"
#: Each symbol asked for (n) with the one that is there (s).
_ASKED = f"zip_with(p_need, {_cut(_STACK, 'p_need')}, (n, s) -> struct(n, s))"
#: Scopes that are there (h) begin with those asked for (a), and a variable takes the rest, or there is none.
_BEGINS = "({0} = {2}.scopes and ({2}.variable is not null or size({1}) = size({2}.scopes)))"


def _begins(here: str, asked: str) -> str:
    return _BEGINS.format(_cut(here, f"{asked}.scopes"), here, asked)


def join_paths(frontier: DataFrame, table: DataFrame) -> DataFrame:
    """Ground rows followed by each partial path that fits: equi-joins on the start node or, at the root, on the prefix key;
    then the remaining stack goes to the path's variables. Rows never join on the root itself, which all files share."""
    at_node = frontier.where(F.col("end_nid") != ROOT).join(table.where(F.col("p_start") != ROOT), F.col("end_nid") == F.col("p_start"))
    rows = frontier.where(F.col("end_nid") == ROOT).withColumn("key", F.explode(prefix_keys("sym_post.symbols")))
    stored = table.where((F.col("p_start") == ROOT) & (F.size("p_key") > 0))
    both = at_node.unionByName(rows.join(stored, F.col("key") == F.col("p_key")).drop("key"))
    symbol = f"z.n.symbol = z.s.symbol and (z.n.scopes is null) = (z.s.scopes is null) and coalesce({_begins('z.s.scopes.scopes', 'z.n.scopes')}, true)"
    size = f"size({_STACK}) >= size(p_need) and (p_var is not null or size({_STACK}) = size(p_need))"
    both = both.where(F.expr(f"{size} and forall({_ASKED}, z -> {symbol}) and {_begins('sco_post.scopes', 'p_scopes')}"))
    # what each scope variable stands for: read off where the path asks for it
    attached = f"transform(filter({_ASKED}, z -> z.n.scopes.variable is not null), z -> struct(z.n.scopes.variable as v, {_rest('z.s.scopes.scopes', 'z.n.scopes.scopes')} as scopes))"
    whole = f"if(p_scopes.variable is null, array(), array(struct(p_scopes.variable as v, {_rest('sco_post.scopes', 'p_scopes.scopes')} as scopes)))"
    both = both.withColumns({"read": F.expr(f"concat({attached}, {whole})"), "rest": F.expr(_rest(_STACK, "p_need"))})
    both = both.where(F.expr("forall(read, a -> forall(read, b -> a.v <> b.v or a.scopes = b.scopes))"))  # a variable asked for twice
    bound = "coalesce(get(filter(read, r -> r.v = {0}), 0).scopes, cast(array() as array<string>))"
    ground = f"cast(struct(concat({{0}}.scopes, {bound.format('{0}.variable')}) as scopes, cast(null as int) as variable) as {SCOPES})"
    scoped = f"if(x.scopes is null, cast(null as {SCOPES}), {ground.format('x.scopes')})"
    left = f"concat(transform(p_post.symbols, x -> struct(x.symbol as symbol, {scoped} as scopes)), if(p_post.variable is null, array(), rest))"
    post = f"cast(struct({left} as symbols, cast(null as int) as variable) as {SYMBOLS})"
    edges = F.concat("edges", "p_edges").alias("edges")
    made = [F.expr(post).alias("sym_post"), F.expr(ground.format("p_sco")).alias("sco_post"), F.size("rest").alias("low_mark")]
    turn = [c for c in ("turn",) if c in frontier.columns]
    return resolve_jump(both.select("file", *turn, "start_nid", "trail", F.col("p_end").alias("end_nid"), edges, "sym_pre", "sco_pre", *made))
