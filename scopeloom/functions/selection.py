"""Choosing input files: globs, the order of a walk, and taking it up again."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import path_fileext


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a component; ``**/`` spans any number of components, also none."""
    piece = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(piece.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|.", glob)) + "$"


def fits(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def input_files(paths: DataFrame, path: str, files: list[str], include: list[str], exclude: list[str], extensions: list[str]) -> DataFrame:
    """Files named one by one, and those that an include pattern fits and no exclude pattern does; all of the given extensions."""
    p = F.col(path)
    chosen = p.isin(*files) | (fits(p, include) & ~fits(p, exclude))
    return paths.where(chosen & path_fileext(p).isin(*extensions))


def walk_key(path: Column) -> Column:
    """Sorts as a depth-first walk with siblings by name does."""
    return F.split(path, "/")


def resume(paths: DataFrame, path: str, at: str) -> DataFrame:
    """Files from ``at`` on, in the order of the walk; none if ``at`` is not among them."""
    if paths.where(F.col(path) == at).isEmpty():
        return paths.where(F.lit(False))
    return paths.where(walk_key(F.col(path)) >= walk_key(F.lit(at)))
