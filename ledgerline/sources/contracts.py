"""What an extract must look like, as Spark schemas: a field's metadata holds the rules that its cells are judged by."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import DataType, DateType, DecimalType, IntegerType, StringType, StructField, StructType

#: The kinds of cells and the types that they are staged as. Fixed values.
TYPES: dict[str, DataType] = {"text": StringType(), "integer": IntegerType(), "decimal": DecimalType(18, 4), "date": DateType()}
_UNSET = {"formats": (), "domain": (), "pattern": None, "key": False}


class ContractViolation(ValueError):
    """An extract's header names other columns than were promised."""


class Column(StructField):
    """A field of the staged table. Rules: formats (of dates, the first that reads a cell counts), domain, pattern, key.

    A pattern tells how cells should be spelt; profiling reports departures and staging accepts them.
    """

    def __init__(self, name: str, type: str = "text", required: bool = False, **rules):
        if unknown := set(rules) - set(_UNSET):
            raise TypeError(f"{name}: no rule is called {sorted(unknown)}")
        kept = {k: list(v) if isinstance(v, tuple) else v for k, v in rules.items()}
        super().__init__(name, TYPES[type], not required, {"type": type, **kept})

    type = property(lambda self: self.metadata["type"])
    required = property(lambda self: not self.nullable)

    def __getattr__(self, rule: str):
        if rule not in _UNSET:
            raise AttributeError(rule)
        value = self.metadata.get(rule, _UNSET[rule])
        return tuple(value) if isinstance(value, list) else value


class TableContract(StructType):
    """A system's table: the schema that its rows have once they are staged, in the file's order of columns."""

    def __init__(self, system: str, table: str, columns: Iterable[Column]):
        super().__init__(list(columns))
        self.system, self.table = system, table

    columns = property(lambda self: tuple(self.fields))
    key = property(lambda self: [c.name for c in self.fields if c.key])
