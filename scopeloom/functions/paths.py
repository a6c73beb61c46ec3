"""Path and tag functions as column expressions, with the component rules of POSIX paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, f) -> Column:
    """``f`` of a value that is written once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def path_split(p: Column) -> Column:
    """Components; a leading ``/`` is one of its own, ``.`` inside is none."""
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.when(F.startswith(p, F.lit("/")), F.concat(F.array(F.lit("/")), parts)).when(p.rlike(r"^\./|^\.$"), F.concat(F.array(F.lit(".")), parts)).otherwise(parts)


def join_components(parts: Column) -> Column:
    rooted = lambda x: F.concat(F.lit("/"), F.array_join(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), "/"))
    return _let(parts, lambda x: F.when(F.get(x, F.lit(0)) == "/", rooted(x)).otherwise(F.array_join(x, "/")))


def path_filename(p: Column) -> Column:
    last = lambda s: F.get(s, F.size(s) - 1)
    return _let(path_split(p), lambda s: F.when(~last(s).isin("/", "..", "."), last(s)))


def path_dir(p: Column) -> Column:
    has = lambda s: (F.size(s) > 1) | ((F.size(s) == 1) & (F.get(s, F.lit(0)) != "/"))
    return _let(path_split(p), lambda s: F.when(has(s), join_components(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))))


def path_fileext(p: Column) -> Column:
    return _let(path_filename(p), lambda n: F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_extract(n, r"\.([^.]*)$", 1)))


def path_filestem(p: Column) -> Column:
    return _let(path_filename(p), lambda n: F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_extract(n, r"^(.+)\.[^.]*$", 1)).otherwise(n))


def path_join(*parts: Column) -> Column:
    """Joined with ``/``; an absolute part starts anew."""
    return F.aggregate(F.array(*parts), F.lit(""), lambda a, x: F.when(F.startswith(x, F.lit("/")) | (a == ""), x).when(x == "", F.concat(F.rtrim(a, F.lit("/")), F.lit("/"))).otherwise(F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), x)))


def path_normalize(p: Column) -> Column:
    """Without ``.`` and ``..``; null where that leaves the root; a relative path keeps leading ``..``."""
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    root = F.startswith(p, F.lit("/"))
    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(True).alias("ok"))

    def step(a, x):
        s = a["s"]
        up = (F.size(s) > 0) & (F.get(s, F.size(s) - 1) != "..")
        new = F.when(x != "..", F.array_append(s, x)).when(up, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(root, s).otherwise(F.array_append(s, x))
        return F.struct(new.alias("s"), (a["ok"] & ~((x == "..") & ~up & root)).alias("ok"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.concat(F.when(root, "/").otherwise(""), F.array_join(a["s"], "/"))))


def path_descendant_of(p: Column, parent: Column) -> Column:
    """Component-wise prefix."""
    return _let(F.struct(path_split(p).alias("a"), path_split(parent).alias("b")), lambda x: F.slice(x["a"], 1, F.size(x["b"])) == x["b"])


def longest_common_prefix(a: Column, b: Column) -> Column:
    """Of two paths, by components; null without one."""

    def common(x):
        ks = F.sequence(F.lit(1), F.greatest(F.least(F.size(x["a"]), F.size(x["b"])), F.lit(1)))
        n = F.size(F.filter(ks, lambda k: F.slice(x["a"], 1, k) == F.slice(x["b"], 1, k)))
        return F.when(n > 0, join_components(F.slice(x["a"], 1, n)))

    return _let(F.struct(path_split(a).alias("a"), path_split(b).alias("b")), common)


def content_tag(text: Column) -> Column:
    """Base64 SHA-1 of the content, without padding: the tag under which a file is indexed."""
    return F.rtrim(F.base64(F.unhex(F.sha1(text))), F.lit("="))


def matches_file(path: Column, content: Column, extensions: list[str], content_regex: str | None = None) -> Column:
    """Score of a language for a file: length of the first match of its content regex, 0 without one, null if it isn't its."""
    score = F.lit(0) if content_regex is None else F.when(content.rlike(content_regex), F.length(F.regexp_extract(content, content_regex, 0)))
    return F.when(path_fileext(path).isin(*extensions), score)


def relative_normalize(p: Column) -> Column:
    """A relative path without ``.`` and, after a name, ``..``; null for an absolute one."""
    return F.when(~F.startswith(p, F.lit("/")), path_normalize(p))


def escapes(p: Column) -> Column:
    """Whether a normalized relative path leads out of where it starts."""
    return F.get(F.split(p, "/"), F.lit(0)) == ".."


def without_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"([^/])\.[^./]*$", "$1")


def format_path(spec: str, root: Column, full: Column) -> Column:
    """A path by a pattern: %r the root, %d the directories below it, %n the name, %e the extension with its dot, %% a percent
    sign. Null for a path outside of the root; any other placeholder is an error."""
    made = {
        "r": lambda x: _dot(root), "d": lambda x: _dot(path_dir(x)), "n": path_filestem,
        "e": lambda x: F.concat(F.lit("."), path_fileext(x)), "%": lambda x: F.lit("%"),
    }
    pieces, k = [], 0
    while k < len(spec):
        if spec[k] == "%":
            k += 1
            if k == len(spec) or spec[k] not in made:
                raise ValueError(f"unsupported placeholder in {spec!r}")
            pieces.append(made[spec[k]])
        else:
            pieces.append(lambda x, c=spec[k]: F.lit(c))
        k += 1

    def written(relative):
        return F.concat(F.lit(""), *[F.coalesce(piece(relative), F.lit("")) for piece in pieces])

    def inside(parts):  # (components of the root, of the path)
        a, b = parts["root"], parts["full"]
        below = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
        return F.when(F.slice(b, 1, F.size(a)) == a, _let(join_components(below), written))

    return _let(F.struct(path_split(root).alias("root"), path_split(full).alias("full")), inside)


def _dot(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", ".").otherwise(x)


def seconds(s: Column) -> Column:
    """A whole number of seconds as text, as a duration; null if it is none."""
    return F.when(s.rlike(r"^\+?[0-9]+$"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.regexp_replace(s, r"^\+", "").cast("decimal(18,6)")))


def milliseconds(s: Column) -> Column:
    return F.when(s.rlike(r"^\+?[0-9]+$"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.regexp_replace(s, r"^\+", "").cast("decimal(18,3)") / 1000).cast("decimal(18,6)")))
