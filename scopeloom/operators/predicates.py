"""Predicates and orders of nodes, stacks and paths as columns, and filters of what is shown of a graph."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import JUMP
from . import graph

_FLAGS = ["kind", "is_definition", "is_reference", "is_exported"]


# ---- nodes


def _col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def is_root(prefix: str = "") -> Column:
    return _col(prefix, "kind") == "root"


def is_jump_to(prefix: str = "") -> Column:
    return _col(prefix, "kind") == "jump_to"


def is_endpoint(prefix: str = "") -> Column:
    return _col(prefix, "is_definition") | _col(prefix, "is_exported") | _col(prefix, "is_reference") | is_root(prefix)


def is_in_file(file: Column, prefix: str = "") -> Column:
    """The file's nodes, and those of no file, which are in every one."""
    return _col(prefix, "file").isNull() | (_col(prefix, "file") == file)


def attached_scope(prefix: str = "") -> Column:
    return F.when(_col(prefix, "kind") == "push_scoped_symbol", _col(prefix, "scope"))


# ---- stacks


def _items(stack: str) -> Column:
    """The symbols or scopes of a stack column, by its type's first field."""
    return F.col(f"{stack}.{'scopes' if stack.startswith('sco') else 'symbols'}")


def stack_length(stack: str) -> Column:
    return F.size(_items(stack))


def has_variable(stack: str) -> Column:
    return F.col(f"{stack}.variable").isNotNull()


def contains_items(stack: str) -> Column:
    return stack_length(stack) > 0


def can_match_empty(stack: str) -> Column:
    """No symbols or scopes of its own."""
    return stack_length(stack) == 0


def can_only_match_empty(stack: str) -> Column:
    """Neither symbols or scopes nor a variable that could bring some."""
    return can_match_empty(stack) & ~has_variable(stack)


def stacks_match(a: str, b: str) -> Column:
    """Same length, equal elements, the same variable."""
    return F.col(a).eqNullSafe(F.col(b))


# ---- paths


def with_ends(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with the flags of their start (``s_``) and end (``e_``)."""
    out = paths
    for p, end in (("s_", "start_nid"), ("e_", "end_nid")):
        n = nodes.select(F.col("nid").alias(f"{p}nid"), *[F.col(c).alias(f"{p}{c}") for c in _FLAGS])
        out = out.join(n, F.col(end) == F.col(f"{p}nid")).drop(f"{p}nid")
    return out


def starts_at_reference() -> Column:
    return F.col("s_is_reference") & can_match_empty("sym_pre") & can_match_empty("sco_pre")


def ends_at_definition() -> Column:
    return F.col("e_is_definition") & can_match_empty("sym_post")


def is_complete() -> Column:
    return starts_at_reference() & ends_at_definition()


def starts_at_endpoint() -> Column:
    return is_endpoint("s_")


def ends_at_endpoint() -> Column:
    return is_endpoint("e_")


def ends_in_jump() -> Column:
    return is_jump_to("e_")


def as_complete_as_necessary() -> Column:
    """A path that a file's summary keeps: the search within the file stops here."""
    return starts_at_endpoint() & (ends_at_endpoint() | ends_in_jump())


#: The columns that make two paths the same; edges are not among them.
STATE = ["start_nid", "end_nid", "sym_pre", "sym_post", "sco_pre", "sco_post"]


def same_path(a: str, b: str) -> Column:
    """Whether two paths, as columns under two prefixes, are equal in all but their edges."""
    out = F.lit(True)
    for c in STATE:
        out &= F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    return out


def list_order(items: Column, tail: Column | None = None) -> Column:
    """A sort key of a list: element by element, a longer list after its prefixes; then the tail, none first."""
    return F.struct(items.alias("items"), *([] if tail is None else [F.coalesce(tail, F.lit(-1)).alias("tail")]))


def path_order() -> list[Column]:
    """A total order of paths: start, end, then the stacks, symbols before scopes, before the path and after it."""
    symbols = lambda c: list_order(F.transform(F.col(f"{c}.symbols"), lambda x: F.struct(x["symbol"].alias("symbol"), F.coalesce(x["scopes"]["scopes"], F.array().cast("array<string>")).alias("scopes"))), F.col(f"{c}.variable"))
    scopes = lambda c: list_order(F.col(f"{c}.scopes"), F.col(f"{c}.variable"))
    return [F.col("start_nid"), F.col("end_nid"), symbols("sym_pre"), symbols("sym_post"), scopes("sco_pre"), scopes("sco_post")]


def edge_list_order(edges: str = "edges") -> Column:
    return list_order(F.transform(F.col(edges), lambda e: F.struct(e["source"].alias("source"), e["precedence"].alias("precedence"))))


# ---- filters


@dataclass
class Filter:
    """What is shown: a condition on files (column ``file``), nodes, edges and paths each; all of them by default."""

    files: Column | None = None
    nodes: Column | None = None
    edges: Column | None = None
    paths: Column | None = None

    def apply(self, nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The tables as far as they are shown, closed: a node needs its file, an edge both nodes, a path all its edges."""
        files = nodes.where(F.col("file").isNotNull()).select("file").distinct()
        shown = nodes if self.nodes is None else nodes.where(self.nodes)
        kept = edges if self.edges is None else edges.where(self.edges)
        left = paths if self.paths is None else paths.where(self.paths)
        return graph.close_filter(shown, kept, left, files if self.files is None else files.where(self.files))


def no_filter() -> Filter:
    return Filter()


def file_filter(file: str) -> Filter:
    return Filter(files=F.col("file") == file)


def visualization_filter(inner: Filter | None = None) -> Filter:
    """Only paths worth a line in a picture: with edges, from a reference to a definition or an open jump. Paths need the flags
    of their ends (``with_ends``)."""
    worth = (F.size("edges") > 0) & starts_at_reference() & (ends_at_definition() | (F.col("end_nid") == JUMP))
    inner = inner or Filter()
    return Filter(inner.files, inner.nodes, inner.edges, worth if inner.paths is None else worth & inner.paths)
