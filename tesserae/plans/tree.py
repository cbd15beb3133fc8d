"""A source tree made of the driver's tables, one file a row, and its text in SQL.

Parts are Python modules, each calling the one before it; parts whose number is
divisible by ten have a test module as well.  Suppliers are Markdown pages, customers
TOML files, nations Go files, regions generated modules.  Both engines fill the same templates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as tree
from .tables import read

MODULE = '''"""Keeps the {name} of {brand}.

Raises: ValueError
"""
import json
from stock.part_{before} import make_{before}

LIMIT_{k} = {size}


class Part{k}(Base{size}):
    """A {name}."""

    def make_{k}(self, size: int) -> str:
        # the size must never pass the limit
        if size > LIMIT_{k}:
            raise ValueError("too large")
        return make_{before}(size)


def check_{k}(value, depth=1):
    assert value
    return json.dumps(value)
'''
TEST = '''from stock.part_{k} import check_{k}


def test_check_{k}(bench):
    assert check_{k}("{brand}")
'''
PAGE = '''# Supplier {k}

{name} delivers to nation {nation}, see [its part](src/stock/part_{k}.py).

## Terms

Orders must be paid in full, and `check_{k}()` says so.

```sh
$ deliver --supplier {k}
```
'''
SETTINGS = '''[customer]
key = {k}
segment = "{segment}"
tags = ["a", "b{nation}"]

[customer.limits]
nation = {nation}
open = true
'''
GO = '''package nations

type Nation{k} struct {
	Name string
}

func (n *Nation{k}) Region() int {
	return {region}
}

func New{k}() *Nation{k} {
	return os.Getenv("NATION_{k}")
}
'''
#: table: (where, path, template, {field: (Spark's expression, DuckDB's)})
_TEXT = lambda c: (c, c)
_NUMBER = lambda c: (f"cast({c} as string)", f"({c})::VARCHAR")
_PART = {"k": _NUMBER("p_partkey + 1"), "before": _NUMBER("p_partkey"), "name": _TEXT("p_name"), "brand": _TEXT("p_brand"), "size": _NUMBER("p_size")}
FILES: dict[str, tuple[str, str, str, str, dict[str, tuple[str, str]]]] = {
    "module": ("part", "true", "src/stock/part_{k}.py", MODULE, _PART),
    "test": ("part", "p_partkey % 10 = 0", "tests/test_part_{k}.py", TEST, _PART),
    "page": ("supplier", "true", "docs/supplier_{k}.md", PAGE, {"k": _NUMBER("s_suppkey"), "name": _TEXT("s_name"), "nation": _NUMBER("s_nationkey")}),
    "settings": ("customer", "true", "conf/customer_{k}.toml", SETTINGS, {"k": _NUMBER("c_custkey"), "segment": _TEXT("c_mktsegment"), "nation": _NUMBER("c_nationkey")}),
    "go": ("nation", "true", "lib/nation_{k}.go", GO, {"k": _NUMBER("n_nationkey"), "region": _NUMBER("n_regionkey")}),
    "generated": ("region", "true", "gen/region_{k}_pb2.py", "value = {k}\n", {"k": _NUMBER("r_regionkey")}),
}
_FIELD = re.compile(r"\{([a-z]+)\}")


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(whether it is a field, field or text) in order."""
    return [(k % 2 == 1, x) for k, x in enumerate(_FIELD.split(template)) if x]


def spark_text(template: str, fields: dict[str, tuple[str, str]]) -> Column:
    return F.concat(*(F.expr(fields[x][0]) if field else F.lit(x) for field, x in _pieces(template)))


def sql_text(template: str, kind: str) -> str:
    """The template as an expression over the kind's table."""
    fields = FILES[kind][4]
    return " || ".join(fields[x][1] if field else "'" + x.replace("'", "''") + "'" for field, x in _pieces(template))


def files(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(FILES)) -> DataFrame:
    """(path, content, byte_size) of all files of these kinds: what a scan of the tree would give."""
    out = None
    for kind in kinds:
        table, where, path, template, fields = FILES[kind]
        content = spark_text(template, fields).cast("binary")
        some = read(spark, sf_dir, table, heavy=True).where(where).select(spark_text(path, fields).alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("byte_size"))
        out = some if out is None else out.unionByName(some)
    return out


def described(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(FILES)) -> DataFrame:
    return tree.described(tree.discover(files(spark, sf_dir, kinds)))


def rows_sql(kind: str, columns: dict[str, str]) -> str:
    """SELECT of the columns (templates of text, or SQL after an equals sign) from the kind's rows."""
    table, where = FILES[kind][:2]
    made = ", ".join(f"{v[1:] if v.startswith('=') else sql_text(v, kind) if v else chr(39) * 2} AS {name}" for name, v in columns.items())
    return f"SELECT {made} FROM {table} WHERE {where}"


def union_sql(rows: list[tuple[str, dict[str, str]]]) -> str:
    return " UNION ALL ".join(rows_sql(kind, columns) for kind, columns in rows)
