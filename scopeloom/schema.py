"""Schemas of the graph and path tables (DDL), and a compact text form for small graphs."""

SCOPES = "struct<scopes:array<string>,variable:int>"
SYMBOL = f"struct<symbol:string,scopes:{SCOPES}>"
SYMBOLS = f"struct<symbols:array<{SYMBOL}>,variable:int>"
EDGES = "array<struct<source:string,precedence:int>>"
POINT = "struct<line:int,utf8:int,utf16:int,grapheme:int>"
SPAN = f"struct<start:{POINT},end:{POINT}>"
DEBUG = "array<struct<key:string,value:string>>"

NODES_DDL = f"nid string, file string, local_id int, kind string, symbol string, scope string, is_definition boolean, is_reference boolean, is_exported boolean, ord bigint, span {SPAN}, syntax_type string, containing_line string, definiens_span {SPAN}, fully_qualified_name string, debug_info {DEBUG}"
EDGES_DDL = f"source string, sink string, precedence int, ord bigint, debug_info {DEBUG}"
PATHS_DDL = f"file string, start_nid string, end_nid string, sym_pre {SYMBOLS}, sco_pre {SCOPES}, sym_post {SYMBOLS}, sco_post {SCOPES}, edges {EDGES}"

ROOT, JUMP = "[root]", "[jump]"
KINDS = ("root", "jump_to", "scope", "drop_scopes", "push_symbol", "push_scoped_symbol", "pop_symbol", "pop_scoped_symbol")


def nid(file: str, local_id: int) -> str:
    return f"{file}({local_id})"


def node_row(file: str, local_id: int, kind: str, symbol: str | None = None, scope: str | None = None, flag: bool = False, ord: int = 0) -> dict:
    """A node as a row. ``flag`` is is_definition, is_reference or is_exported, by the kind."""
    return {
        "nid": nid(file, local_id), "file": file, "local_id": local_id, "kind": kind, "symbol": symbol, "scope": scope,
        "is_definition": flag and kind.startswith("pop"), "is_reference": flag and kind.startswith("push"), "is_exported": flag and kind == "scope",
        "ord": ord, "span": None, "syntax_type": None, "containing_line": None, "definiens_span": None, "fully_qualified_name": None, "debug_info": [],
    }


def singletons() -> list[dict]:
    """The two nodes that belong to no file."""
    rows = []
    for k, (name, kind) in enumerate(((ROOT, "root"), (JUMP, "jump_to"))):
        rows.append(node_row("", 0, kind) | {"nid": name, "file": None, "local_id": None, "ord": k - 2})
    return rows
