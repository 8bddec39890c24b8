"""Table-name rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: longest generated name of each database backend; none for sqlite
BACKENDS = (("sqlite", None), ("postgresql", 63), ("mysql", 64), ("oracle", 30))


def snake_case(name: Column) -> Column:
    """An underscore before each upper-case letter that ends a run or follows a small letter or digit; all lowered, no underscore in front."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"((?<=[a-z0-9])[A-Z]|(?!^)[A-Z](?=[a-z]))", "_$1")), "^_+", "")


def snake_case_runs(name: Column) -> Column:
    """The older rule: only runs of upper-case letters before a small letter or digit are lowered, the last letter of a longer run apart."""
    long = F.regexp_replace(name, r"([A-Z]+)([A-Z])(?=[a-z0-9])", "_\u0001$1\u0002_\u0001$2\u0002")
    short = F.regexp_replace(long, r"(?<![\u0001A-Z])([A-Z])(?=[a-z0-9])", "_\u0001$1\u0002")
    pieces = F.split(short, "(?=\u0001)|(?<=\u0002)")
    lowered = F.transform(pieces, lambda p: F.when(p.startswith("\u0001"), F.lower(p)).otherwise(p))
    return F.regexp_replace(F.regexp_replace(F.array_join(lowered, ""), "[\u0001\u0002]", ""), "^_+", "")


def truncate_name(identifier: Column, length: int | None, hash_length: int = 4) -> Column:
    """A name longer than ``length`` is cut and ends in the start of its md5; a name space before ``"."`` stays."""
    if length is None:
        return identifier
    parts = F.split(identifier, r'"\."')
    two = F.size(parts) == 2
    strip = lambda c: F.regexp_replace(c, r'^"+|"+$', "")
    name = F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(strip(identifier))
    space = F.when(two, strip(F.get(parts, F.lit(0)))).otherwise(F.lit(""))
    cut = F.concat(F.when(space != "", F.concat(space, F.lit('"."'))).otherwise(F.lit("")), F.substring(name, 1, length - hash_length), F.substring(F.md5(F.encode(name, "UTF-8")), 1, hash_length))
    return F.when(F.length(name) <= length, identifier).otherwise(cut)


def backend_name(identifier: Column, backend: str) -> Column:
    """The name in a backend's catalogue of a name given as is; null where it can't be told."""
    length = dict(BACKENDS)[backend]
    if backend == "oracle":
        plain = ~identifier.startswith('"') & ~identifier.endswith('"')
        quoted = F.when(plain, F.concat(F.lit('"'), truncate_name(identifier, length), F.lit('"'))).otherwise(identifier)
        mark = '"'
    else:
        mark = "`" if backend == "mysql" else '"'
        whole = (F.length(identifier) >= 2) & identifier.startswith(mark) & identifier.endswith(mark)
        quoted = F.when(whole, identifier).otherwise(F.concat(F.lit(mark), identifier, F.lit(mark)))
    inner = F.when((F.length(quoted) >= 2) & quoted.endswith(mark), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    segments = F.split(inner, rf"{mark}\.{mark}")
    long = F.lit(False)
    if backend == "postgresql":
        long = F.exists(segments, lambda s: F.octet_length(s) > 63)
    if backend == "mysql":
        long = F.exists(segments, lambda s: F.length(s) > 64)
    return F.when(~long, F.array_join(F.transform(segments, escape_name), "."))


def escape_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))


def agreed_name(identifier: Column, generated: bool = False) -> Column:
    """The name that all backends give; null where they differ or one can't tell."""
    named = [backend_name(truncate_name(identifier, n) if generated else identifier, b) for b, n in BACKENDS]
    same = named[0].isNotNull()
    for n in named[1:]:
        same = same & F.coalesce(n == named[0], F.lit(False))
    return F.when(same, named[0])
